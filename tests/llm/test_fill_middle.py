import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import rows
from pyspark.sql import functions as F

from demandkit.llm import fill_middle as fim


def brute(doc_id, text, percent=90, first=20, seed=1):
    """Form, lengths and output by plain slicing."""
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (doc_id, n, "plain", None, None, text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "<P>" + text[:lo], "<M>" + text[lo:hi], "<S>" + text[hi:]
    form = "spm" if h[3] % 100 < first else "psm"
    return (doc_id, n, form, lo, hi - lo, s + p + m if form == "spm" else p + s + m)


COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def sort(found):
    return sorted(found, key=lambda t: [(x is not None, str(type(x)), x) for x in t])


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(2)
    alphabet = "ab <>PSM\n日é😀/"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += ["<P>", "a<S>b", "x<M>", "<", "<P", "P>", "<<P", "😀" * 5000, "a" * 100_000]
    return spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")


def test_against_slicing(mixed, odd_docs, clashing, no_docs):
    for docs in (mixed, odd_docs):
        want = sort(brute(r.doc_id, r.text) for r in docs.collect())
        assert rows(fim.transform(docs), *COLUMNS) == want
    forms = {r[2] for r in want}
    assert forms == {"plain", "psm", "spm"}
    assert rows(fim.transform(clashing), *COLUMNS) == want
    assert fim.transform(no_docs).count() == 0 and fim.restore(fim.transform(no_docs)).count() == 0


def test_round_trip_is_exact(mixed, odd_docs):
    for docs in (mixed, odd_docs):
        back = fim.restore(fim.transform(docs).withColumn("extra", F.lit(1)))
        assert "extra" in back.columns and "output" not in back.columns
        want = sort((r.doc_id, r.text or "") for r in docs.collect())
        assert rows(back, "doc_id", "restored") == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a<>PSMé日😀", max_size=12), st.integers(0, 12), st.integers(0, 12), st.sampled_from(["psm", "spm"]))
def test_rotation_and_back(text, a, b, form):
    cuts = tuple(sorted((min(a, len(text)), min(b, len(text)))))
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    formed = fim.form_text(text.encode(), len(text), form, cuts)
    lo, hi = cuts
    p, m, s = "<P>" + text[:lo], "<M>" + text[lo:hi], "<S>" + text[hi:]
    assert formed.decode() == (p + s + m if form == "psm" else s + p + m)
    assert fim.restore_text(bytes(formed), form).decode() == text


def test_rates_and_seed(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text to cut").alias("text"))
    share = {r.form: r["count"] / 4000 for r in fim.transform(docs).groupBy("form").count().collect()}
    assert abs(share["plain"] - 0.1) < 0.03 and abs(share["spm"] - 0.18) < 0.03
    assert {r.form for r in fim.transform(docs, formed_percent=0).select("form").distinct().collect()} == {"plain"}
    assert {r.form for r in fim.transform(docs, 100, 100).select("form").distinct().collect()} == {"spm"}
    assert rows(fim.transform(docs, seed=2), *COLUMNS) != rows(fim.transform(docs), *COLUMNS)
