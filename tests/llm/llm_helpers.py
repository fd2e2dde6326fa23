"""Plain-Python counterparts shared by the tests of the training-data operators."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(ascii_lower(text))


def without_spaces(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def rows(df, *columns):
    """The rows as a sorted list of tuples (NULL first)."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: [(x is not None, str(type(x)), x) for x in t])


def unordered(values):
    return sorted(values, key=lambda t: [(x is not None, str(type(x)), x) for x in t])
