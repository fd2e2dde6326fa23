"""Fill-in-the-middle: sentinels and in-place block rotation in a byte buffer, undone the same way.

The text's UTF-8 bytes go into one bytearray.  A scan finds the two cuts, the
sentinels are inserted there (``<P>prefix<M>middle<S>suffix``), and neighbouring
segments change places by a rotation made of three reversals.  Reading a
formed text back finds the sentinels, turns the rotation round and takes them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from demandkit.llm.text import ship_package

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMED_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
SEED = 1

NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange buffer[start:cut] and buffer[cut:end] in place: reverse each, then both together."""
    for lo, hi in ((start, cut), (cut, end), (start, end)):
        part = buffer[lo:hi]
        part.reverse()
        buffer[lo:hi] = part


def byte_offsets(data: bytes, n: int, cuts: tuple[int, int]) -> tuple[int, int]:
    """Where code points number ``cuts`` of ``n`` begin among the UTF-8 bytes."""
    if len(data) == n:
        return cuts
    begins = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    first, second = (int(begins[c]) if c < n else len(data) for c in cuts)
    return first, second


def form_text(data: bytes, n: int, form: str, cuts: tuple[int, int]) -> bytearray:
    """The bytes of the formed text; ``cuts`` are where prefix and middle end, in code points."""
    buffer = bytearray(data)
    if form == "plain":
        return buffer
    first, second = byte_offsets(data, n, cuts)
    for at, marker in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = marker
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    if form == "psm":
        rotate(buffer, middle, suffix, len(buffer))
    else:
        rotate(buffer, 0, suffix, len(buffer))
    return buffer


def restore_text(data: bytes, form: str) -> bytearray:
    """The original text's bytes from a formed text and its form."""
    buffer = bytearray(data)
    if form == "plain":
        return buffer
    size = len(buffer)
    if form == "psm":
        suffix = buffer.index(SUFFIX)
        middle = buffer.index(MIDDLE, suffix)
        rotate(buffer, suffix, middle, size)
        middle, suffix = suffix, suffix + size - middle
    else:
        prefix = buffer.index(PREFIX)
        rotate(buffer, 0, prefix, size)
        middle, suffix = buffer.index(MIDDLE), size - prefix
    for at, marker in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del buffer[at : at + len(marker)]
    return buffer


def plan(doc_id: str, data: bytes, n: int, formed_percent: int, suffix_first_percent: int, seed: int) -> tuple[str, tuple[int, int]]:
    """Form and cuts of a document, from the digest of its id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    if not n or h[2] % 100 >= formed_percent or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", (0, 0)
    return ("spm" if h[3] % 100 < suffix_first_percent else "psm"), (min(a, b), max(a, b))


def transform(
    docs: DataFrame, formed_percent: int = FORMED_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, seed: int = SEED
) -> DataFrame:
    """Per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    ``n`` counts the text's code points.  ``form`` is plain (output is the text,
    the two lengths are NULL), psm or spm.  NULL and empty texts, and texts that
    already hold a sentinel, stay plain; a NULL doc_id is planned like an empty
    one.  Equal doc_ids share their draws, so repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                data, n = text.encode(), len(text)
                form, cuts = plan("" if doc_id is None else str(doc_id), data, n, formed_percent, suffix_first_percent, seed)
                lengths = (None, None) if form == "plain" else (cuts[0], cuts[1] - cuts[0])
                found.append((doc_id, n, form, *lengths, form_text(data, n, form, cuts).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), KINDS)], names=NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def restore(formed: DataFrame) -> DataFrame:
    """``formed`` (with output and form) with ``output`` replaced by ``restored``, the text it was made from.

    Other columns travel along; one called restored is replaced.  A NULL output gives an empty text.
    """
    ship_package(formed.sparkSession)
    formed = formed.drop("restored")
    others = [f.name for f in formed.schema.fields if f.name != "output"]
    schema = StructType([f for f in formed.schema.fields if f.name != "output"] + [StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())
            found = pa.array([restore_text((t or "").encode(), f).decode() for t, f in both], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), found], names=[*others, "restored"])

    return formed.mapInArrow(run, schema)
