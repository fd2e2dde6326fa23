import random

from llm_helpers import rows, unordered, words

from demandkit.llm import decontam

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")


def brute(docs, items, window=10):
    wins = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(0, len(w) - window) + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(item_id)
    out = []
    for r in docs:
        w, hit, found = words(r.text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                ids = wins.get(tuple(w[i : i + n]))
                if ids:
                    hit |= set(range(i, i + n))
                    found |= ids
        ids = sorted(str(i) for i in found if i is not None)
        out.append((r.doc_id, len(w), len(hit), len(ids), ids, bool(hit)))
    return unordered(out)


ITEMS = [
    (1, "alpha beta"),
    (2, "the the the"),
    (3, None),
    (4, "?!"),
    (5, " ".join(f"w{i}" for i in range(25))),
    (6, "W3 w4, w5 w6 w7 w8 w9 w10 w11 w12 w13"),
    (6, "zeta eta theta"),
    (None, "no id at all"),
    (7, "Ünïcode ÉTÉ x1"),
]


def make(spark, rng):
    vocabulary = ["the", "alpha", "beta", "zeta", "eta", "theta", "filler"] + [f"w{i}" for i in range(25)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 25), (2, 14), (2, 11), (0, 10), (15, 25), (14, 25), (16, 25))]
    texts += ["alpha, BETA! alpha-beta", "the the the the the", "pre " + " ".join(f"w{i}" for i in range(25)) * 2, "ünïcode ÉTÉ X1", "Ünïcode ÉTÉ X1"]
    return spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")


def test_against_brute_force(spark, odd_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make(spark, random.Random(2)).unionByName(odd_docs.select("doc_id", "text"))
    got = decontam.contamination(docs, bench)
    want = brute(docs.collect(), ITEMS)
    assert rows(got, *COLUMNS) == want
    assert any(r[2] for r in want)
    for window in (1, 3):
        assert rows(decontam.contamination(docs, bench, window), *COLUMNS) == brute(docs.collect(), ITEMS, window)


def test_without_broadcast_no_text_is_carried(spark, odd_docs):
    """Beyond the bound words are shuffled with the words around them, and the result is the same."""
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make(spark, random.Random(2)).unionByName(odd_docs.select("doc_id", "text"))
    windows = decontam.benchmark_windows(bench).select("win", "tokens").distinct()
    columns = ("doc_id", "start", "length", "win")
    want = rows(decontam.occurrences(docs, windows), *columns)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for limit in (0, decontam.BROADCAST_WORDS):
            found = decontam.occurrences(docs, windows, broadcast_words=limit)
            assert rows(found, *columns) == want
            plan = found._jdf.queryExecution().sparkPlan().toString()
            physical = found._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (limit > 0)
            lines = physical.split("\n")
            for i, line in enumerate(lines):
                if "Exchange hashpartitioning(word" in line:
                    below = next(x for x in lines[i + 1 :] if "Project" in x or "HashAggregate" in x or "Scan" in x)
                    assert "words#" not in below.split("AS")[0], below
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_drop_contaminated(spark, clashing):
    bench = spark.createDataFrame([(1, "no id at all"), (2, "word word word")], "item_id long, text string")
    kept = decontam.drop_contaminated(clashing, bench)
    assert kept.columns == clashing.columns
    gone = set(rows(clashing, "doc_id", "text")) - set(rows(kept, "doc_id", "text"))
    assert {d for d, _ in gone} == {None, 28, 29} and kept.count() == clashing.count() - 3


def test_empty_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contamination(no_docs, bench).count() == 0
    clean = decontam.contamination(odd_docs, bench.filter("item_id < 0"))
    assert clean.count() == odd_docs.count() and clean.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert decontam.drop_contaminated(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_no_python_in_the_plan(spark, odd_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontam.contamination(odd_docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
