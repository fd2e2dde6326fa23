import random
import zlib
from collections import defaultdict
from math import exp, log

import pytest
from pyspark.sql import functions as F

from demandkit.llm import quality

SF = "/root/testdata/sf0.1"


def test_site_levels(spark):
    urls = [
        ("http://User@Blog.Example.com:80/En/7#top", "blog.example.com", "blog.example.com/En"),
        ("https://a.org", "a.org", "a.org/"),
        ("https://a.org/?q=/x", "a.org", "a.org/"),
        ("nonsense", "", "/"),
        (None, "", "/"),
    ]
    host, path = quality.site_levels(F.col("url"))
    got = spark.createDataFrame([(u,) for u, _, _ in urls], "url string").select(host, path).collect()
    assert [tuple(r) for r in got] == [u[1:] for u in urls]


def brute(rows, prior):
    """(host, path, evidence) -> scores, by the formulas in plain Python."""
    p = [1 / (1 + exp(-(e + prior))) for _, _, e in rows]

    def strength(keys):
        groups = defaultdict(list)
        for k, x in zip(keys, p):
            groups[k].append(x)
        n = len(p)
        mean = sum(p) / n
        within = max(sum((x - sum(g) / len(g)) ** 2 for g in groups.values() for x in g) / max(n - len(groups), 1), quality.EPS)
        between = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups.values())
        spread = (between - (len(groups) - 1) * within) / max(n - sum(len(g) ** 2 for g in groups.values()) / n, quality.EPS)
        return groups, mean, min(max(within / max(spread, quality.EPS), 1.0), 1e6)

    hosts, mean, k1 = strength([h for h, _, _ in rows])
    paths, _, k2 = strength([(h, q) for h, q, _ in rows])
    out = []
    for (h, q, e), x in zip(rows, p):
        host = (sum(hosts[h]) + k1 * mean) / (len(hosts[h]) + k1)
        path = (sum(paths[h, q]) - x + k2 * host) / (len(paths[h, q]) - 1 + k2)
        out.append((host, path, 1 / (1 + exp(-(e + log(path / (1 - path)))))))
    return out


def test_posteriors_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for h in range(12):
        level = rng.gauss(0, 1.5)
        for _ in range(1 if h < 3 else rng.randrange(2, 60)):
            rows.append((f"h{h}", f"p{rng.randrange(3)}", rng.gauss(level, 1)))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, evidence double")
    got = {r.doc_id: (r.host_posterior, r.path_posterior, r.score) for r in quality.posteriors(frame, 0.4).collect()}
    for i, want in enumerate(brute(rows, 0.4)):
        assert got[i] == pytest.approx(want, rel=1e-6), rows[i]


def test_sparse_sites_shrink_more(spark):
    data = [("big", "p", 3.0 + i % 2 / 10) for i in range(200)] + [("small", "p", 3.0)] + [("bad", "p", -3.0 - i % 2 / 10) for i in range(200)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "doc_id long, host string, path string, evidence double")
    got = {r.doc_id: r for r in quality.posteriors(frame, 0.0).collect()}
    assert got[0].path_posterior > got[200].path_posterior > got[300].path_posterior


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    path = F.concat_ws("/", "source", "lang")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.classify(docs, labels, F.col("source"), path).collect()
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum(r.keep == bool(truth[r.doc_id]) for r in held) / len(held)
    clean = [r for r in held if truth[r.doc_id]]
    assert right > 0.97 and sum(r.keep for r in clean) / len(clean) > 0.99


def test_held_out_labels_change_nothing(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when(quality.training_row(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (
        sorted((r.doc_id or -1, r.evidence, r.score) for r in quality.classify(odd_docs, x, F.col("source"), F.col("lang")).collect())
        for x in (labels, other)
    )
    assert a == b


def test_odd_tables(spark, odd_docs, clashing, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(3, 0), (None, 1), (4, None), (5, 7)], "doc_id long, quality int")
    got = quality.classify(clashing, labels, F.col("source"), F.col("lang"))
    assert got.count() == odd_docs.count()
    assert got.filter("score is null or score < 0 or score > 1 or keep is null").count() == 0
    assert quality.classify(no_docs, labels, F.col("source"), F.col("lang")).count() == 0
    blind = quality.classify(odd_docs, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert len(blind) == odd_docs.count() and all(r.evidence == 0 and abs(r.score - 0.5) < 1e-6 for r in blind)
