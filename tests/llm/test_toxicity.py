import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import rows
from pyspark.sql import functions as F

from demandkit.llm import toxicity as tox

SF = "/root/testdata/sf0.1"


def test_block_max_search_is_exact():
    rng = random.Random(8)
    terms = [f"t{i:02d}" for i in range(40)]
    idf = np.array([rng.uniform(0.2, 5) for _ in terms])
    examples = [
        (100 + n, n % 2, 1.0 + n % 3, Counter({rng.randrange(40): rng.randrange(1, 9) for _ in range(rng.randrange(0, 7))})) for n in range(700)
    ]
    index = tox.build_index(terms, idf, examples, 0.1, 0.01)
    held = [e for e in examples if e[3]]

    def vector(counts):
        v = np.zeros(40)
        for t, n in counts.items():
            v[t] = (1 + np.log(n)) * idf[t]
        return v / np.sqrt((v * v).sum())

    dense = np.array([vector(e[3]) for e in held])
    for _ in range(60):
        query = Counter({rng.randrange(40): rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))})
        near, sims = index.nearest(*index.vector(list(query), list(query.values())), 10)
        cosine = dense @ vector(query)
        order = np.lexsort((np.arange(len(cosine)), -cosine.round(12)))[:10]
        order = order[cosine[order] > 0]
        assert sims == pytest.approx(cosine[order])
        assert set(near[sims > sims[-1] + 1e-9]) == set(order[cosine[order] > sims[-1] + 1e-9])


def scored(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = tox.score(docs, tox.fit(docs, labels)).collect()
    return [(r, truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]


def test_held_out_accuracy(spark):
    held = scored(spark, SF)
    caught = sum(r.predicted and y for r, y in held)
    assert caught / sum(y for _, y in held) > 0.8 and caught / sum(r.predicted for r, _ in held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= tox.THRESHOLD) for r, _ in held)


def tables(spark):
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(300)]
    data, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            w[3] = w[20] = "horrid"
        data.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def rare_language(spark, common=1500, rare=15):
    """Toxic rows: ``rare`` of a second language beside ``common``, and clean rows of both."""
    rng = random.Random(3)
    plain, other = ([f"{x}{i:03d}" for i in range(300)] for x in "wm")
    data = [(i, [rng.choice(plain) for _ in range(12)], int(i < common), "horrid") for i in range(4 * common)]
    data += [(10_000 + i, [rng.choice(other) for _ in range(12)], int(i < rare), "abject") for i in range(20 * rare)]
    for _, w, y, marker in data:
        if y:
            w[3] = w[7] = marker
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w, _, _ in data], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y, _ in data], "doc_id long, toxic int")


def test_markers_of_a_rare_language(spark):
    docs, labels = rare_language(spark)
    index = tox.fit(docs, labels)
    assert {t[:4] for t in index.terms} >= {"horr", "abje"}
    want = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(p == want[i] for i, p in rows(tox.score(docs, index), "doc_id", "predicted"))


def test_every_marker_is_a_term_once(spark):
    rng = random.Random(5)
    plain, bad = ([f"{x}{i:03d}" for i in range(400)] for x in "wx")

    def markers(i):
        return [f"{bad[(i + k) % 400]}abcdefgh" for k in (0, 133, 266)]

    data = [(i, " ".join([rng.choice(plain) for _ in range(10)] + markers(i) * (i < 4000)), int(i < 4000)) for i in range(8000)]
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    index = tox.fit(spark.createDataFrame([d[:2] for d in data], "doc_id long, text string"), labels)
    held = Counter(m[:4] for i in range(4000) if zlib.crc32(str(i).encode()) % 3 != 1 for m in markers(i))
    proven = {m for m, n in held.items() if n >= 15}
    assert len(proven) > 300 and {t for t in index.terms if " " not in t} >= proven
    assert not [t for t in index.terms if len(t.split(" ")[0]) > 4]


def test_chance_is_exact():
    got = tox.chance(np.array([3, 0, 2]), np.array([0, 4, 1]), 10, 20)
    assert got == pytest.approx([120 / 4060, 1.0, (45 * 20 + 120) / 4060])


def test_held_out_labels_change_nothing(spark):
    docs, labels = tables(spark)
    other = labels.withColumn("toxic", F.when(tox.training_row(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (rows(tox.score(docs, tox.fit(docs, x)), "doc_id", "score") for x in (labels, other))
    assert a == b
    assert all((s >= tox.THRESHOLD) == (i % 5 == 0) for i, s in a)


def test_bounded_sample_still_separates(spark):
    docs, labels = tables(spark)
    index = tox.fit(docs, labels, fit_per_class=50, examples_per_class=8, max_terms=10)
    assert len(index.label) <= 16 and len(index.terms) <= 10
    got = rows(tox.score(docs, index), "doc_id", "predicted")
    assert all(p == int(i % 5 == 0) for i, p in got)


def test_odd_rows(spark, odd_docs, clashing, no_docs):
    docs, labels = tables(spark)
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1), (7, None), (8, 5), (10, 0)], "doc_id long, toxic int"))
    index = tox.fit(docs.unionByName(docs.limit(50)), odd_labels)
    got = tox.score(clashing, index)
    assert rows(got, "doc_id") == rows(odd_docs, "doc_id")
    assert got.filter("score is null or score < 0 or score > 1 or predicted = 1").count() == 0
    assert tox.score(no_docs, index).count() == 0
    none = tox.fit(odd_docs, labels.limit(0))
    assert {r.score for r in tox.score(odd_docs, none).collect()} == {0.0}
    assert tox.fit(no_docs, labels).terms == []


def test_drop_toxic(spark, clashing):
    docs, labels = tables(spark)
    extra = docs.withColumn("row_key", F.lit(1)).withColumn("score", F.lit(2.0))
    kept = tox.drop_toxic(extra, labels)
    assert kept.columns == extra.columns
    assert rows(kept, "doc_id") == [(i,) for i in range(400) if i % 5]
    assert tox.drop_toxic(clashing, labels).count() == clashing.count()


def test_a_slight_difference_is_no_marker(spark):
    """A word that toxic rows hold 1.3 times as often is proven by many rows, and is still no term."""
    rng = random.Random(4)
    plain = [f"w{i:03d}" for i in range(300)]
    data = []
    for i in range(9000):
        toxic = i % 3 == 0
        w = [rng.choice(plain) for _ in range(8)] + ["common"] * (rng.random() < (0.52 if toxic else 0.4)) + ["horrid"] * (toxic and rng.random() < 0.9)
        data.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([d[:2] for d in data], "doc_id long, text string")
    chosen = tox.choose_terms(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))
    assert {t.split(" ")[0] for t in chosen.terms} == {"horr"}


def test_terms_weights_votes_and_scores_against_brute_force(spark):
    """Term choice, document frequencies, weights, neighbours, votes and scores of a small table, by plain loops."""
    docs, labels = tables(spark)
    docs = docs.unionByName(docs.filter("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1000)).cache()
    text = {r.doc_id: r.text for r in docs.collect()}
    label = {r.doc_id: r.toxic for r in labels.collect()}
    train = {i: y for i, y in label.items() if zlib.crc32(str(i).encode()) % 3 != 1}

    def terms(t):
        held = Counter()
        for w in t.lower().split():
            for s in {w[:k] for k in tox.STEMS}:
                held[s] += 1
        return {**held, **{f"{s} {k}x": n for s, n in held.items() for k in tox.TIMES if n >= k}}

    rows = [(i, y, terms(text[i])) for i, y in sorted(train.items())]
    n1, n0 = sum(y for _, y, _ in rows), sum(1 - y for _, y, _ in rows)
    chosen, strength, marks = [], {}, {}
    for term in {t for _, _, c in rows for t in c}:
        a, b = (sum(term in c for _, y, c in rows if y == side) for side in (1, 0))
        chi2 = (a * (n0 - b) - b * (n1 - a)) ** 2 * (n0 + n1) / ((a + b) * (n0 + n1 - a - b) * n1 * n0) if 0 < a + b < n0 + n1 else 0
        if a >= tox.MIN_ROWS and a * n0 >= tox.MIN_LIFT * b * n1 and chi2 >= tox.MIN_CHI2 and tox.chance(np.array([a]), np.array([b]), n1, n0)[0] <= tox.MAX_CHANCE:
            chosen.append(term)
            strength[term], marks[term] = chi2, frozenset(i for i, _, c in rows if term in c)
    kept = sorted(t for t in chosen if not any(o != t and marks[o] == marks[t] and t.partition(" ")[2] == o.partition(" ")[2] and t.startswith(o.partition(" ")[0]) and len(o) < len(t) for o in chosen))
    index = tox.fit(docs, labels)
    assert index.terms == kept
    df = {t: sum(t in terms(x) for x in text.values()) for t in kept}
    weight = {t: np.log((1 + len(text)) / (1 + df[t])) * np.sqrt(strength[t] / (n1 + n0)) for t in kept}
    assert index.idf == pytest.approx([weight[t] for t in kept])

    def vector(t):
        v = {k: (1 + np.log(n)) * weight[k] for k, n in terms(t).items() if k in weight}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {k: x / size for k, x in v.items()}

    examples = [(i, y, vector(text[i])) for i, y, _ in rows]
    heard = [e for e in examples if e[2]]
    base = n1 / (n1 + n0)
    silent = sum(y for _, y, v in examples if not v)
    got = {r.doc_id: r.score for r in tox.fit_score(docs, labels).collect()}
    assert got == pytest.approx({r.doc_id: r.score for r in tox.score(docs, index).collect()})
    for i, t in text.items():
        own = vector(t)
        if not own:
            assert got[i] == pytest.approx((silent + base) / (len(examples) - len(heard) + 1))
            continue
        sims = sorted(((sum(x * v.get(k, 0.0) for k, x in own.items()), y) for _, y, v in heard), key=lambda s: -s[0])
        near = [s for s in sims[: tox.NEIGHBOURS] if s[0] > 0]
        if len(sims) > tox.NEIGHBOURS and sims[tox.NEIGHBOURS][0] > sims[tox.NEIGHBOURS - 1][0] - 1e-9:
            tied = {y for s, y in sims if abs(s - sims[tox.NEIGHBOURS - 1][0]) < 1e-9}
            if len(tied) > 1:
                continue  # which of equal neighbours of both classes vote is the index's choice
        total = sum(s for s, _ in near)
        assert got[i] == pytest.approx((sum(s * y for s, y in near) + tox.PRIOR_VOTES * base) / (total + tox.PRIOR_VOTES))
