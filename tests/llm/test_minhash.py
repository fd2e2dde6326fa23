import random

import numpy as np
import pytest
from llm_helpers import ascii_lower, rows
from pyspark.sql import functions as F

from demandkit.llm import minhash


def brute_set(text, k=2):
    spaced = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in ascii_lower(text))
    words = [w for w in spaced.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(docs, k=2, percent=80):
    """(doc_id, n_shingles, component_id) of every row, all pairs compared."""
    sets = [brute_set(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and common * 100 >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return sorted(out, key=lambda t: [(x is not None, str(type(x)), x) for x in t])


def family(rng, n, length, edits):
    """Texts that differ from one another in up to ``edits`` words of a common base."""
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(length)] = f"e{rng.randrange(30)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def near_docs():
    rng = random.Random(11)
    texts = [t for _ in range(30) for t in family(rng, rng.randrange(1, 6), rng.randrange(8, 80), 6)]
    texts += family(rng, 150, 60, 7)  # one hot group, many of whose members are over the threshold apart
    texts += [f"short {i % 4}" for i in range(20)] + ["one", "One", "one two", "ONE  two\n"]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


@pytest.mark.parametrize("k,percent", [(2, 80), (5, 80), (1, 60)])
def test_components_against_brute_force(spark, near_docs, k, percent):
    docs = spark.createDataFrame(near_docs, "doc_id long, text string")
    got = minhash.near_duplicates(docs, shingle=k, threshold_percent=percent)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute(near_docs, k, percent)


def test_links_that_miss_the_centre(spark):
    """Chains of cut and edited copies, few of them linked with the group's centre, come out whole."""
    rng = random.Random(2)
    texts = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(90)]
        texts += [" ".join(base)] * 2
        texts += [" ".join(base[lo:hi]) for lo, hi in ((0, 60), (0, 66), (5, 62), (30, 90), (26, 90), (20, 80), (22, 83), (0, 40), (0, 45))]
        for _ in range(8):
            own = list(base)
            spots = rng.sample(range(90), 9)
            for k in spots:
                own[k] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(own))
            own[rng.randrange(90)] = "again"
            texts.append(" ".join(own))
            texts.append(" ".join(own[: rng.randrange(70, 90)]))
    docs = list(enumerate(texts, 1))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for percent in (80, 70):
        want = brute(docs, 2, percent)
        assert rows(minhash.near_duplicates(frame, shingle=2, threshold_percent=percent), "doc_id", "n_shingles", "component_id") == want
    assert len({c for _, _, c in want}) > 12


def test_odd_rows(odd_docs, clashing, no_docs):
    plain = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute(plain)
    assert rows(minhash.near_duplicates(odd_docs, shingle=2), "doc_id", "n_shingles", "component_id") == want
    assert rows(minhash.near_duplicates(clashing, shingle=2), "doc_id", "n_shingles", "component_id") == want
    assert minhash.near_duplicates(no_docs).count() == 0
    # Empty sets are linked with nothing.
    assert all(c == i for i, n, c in want if n == 0)
    with pytest.raises(ValueError):
        minhash.near_duplicates(odd_docs, bands=3, rows=5)


def test_estimate_corrects_for_chance(spark):
    """Known similarities come back within sampling error; unrelated sets come out near zero."""
    rng = np.random.default_rng(1)
    sketch = minhash.Sketcher(minhash.BANDS, minhash.ROWS)
    got = []
    for overlap in (0, 500, 800, 1000):
        for _ in range(20):
            pool = rng.integers(0, 1 << 63, 2000 - overlap, dtype=np.uint64)
            a, b = pool[:1000], pool[1000 - overlap :]
            got.append((overlap / (2000 - overlap), sketch(a)[1].tolist(), sketch(b)[1].tolist()))
    frame = spark.createDataFrame(got, "truth double, bits_a array<long>, bits_b array<long>")
    means = frame.groupBy("truth").agg(F.avg(minhash.estimate("bits_a", "bits_b", 8)).alias("e")).collect()
    assert len(means) == 4 and all(abs(r.e - r.truth) < 0.04 for r in means), means
    exact = [sum((x >> s & 15) == (y >> s & 15) for x, y in zip(a, b) for s in range(0, 64, 4)) for _, a, b in got]
    assert [r.n for r in frame.select(minhash.agreeing("bits_a", "bits_b", 8).alias("n")).collect()] == exact


def test_bounds_of_what_may_be_missed():
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-7
    assert 60 < minhash.least_agreeing(80, 128) < 90 and minhash.least_agreeing(100, 128) == 128
