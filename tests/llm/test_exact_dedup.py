from collections import defaultdict
from hashlib import sha256

from llm_helpers import rows, unordered, without_spaces

from demandkit.llm import exact_dedup

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(docs):
    groups = defaultdict(list)
    for r in docs:
        groups[without_spaces(r.text)].append(r)
    out = []
    for norm, members in groups.items():
        most = max(len(r.text or "") for r in members)
        top = [r for r in members if len(r.text or "") == most]
        known = [r.doc_id for r in top if r.doc_id is not None]
        keep = min(known) if known else None
        kept = 0
        for r in members:
            first = r.doc_id == keep and len(r.text or "") == most and not kept
            kept += first
            out.append((r.doc_id, keep, len(members), first, sha256(norm.encode()).hexdigest()))
    return unordered(out)


def test_against_brute_force(odd_docs):
    assert rows(exact_dedup.decisions(odd_docs, hash_unique=True), *COLUMNS) == brute(odd_docs.collect())


def test_bitmap_of_any_size_gives_the_same(odd_docs):
    want = brute(odd_docs.collect())
    for options in ({"prefix_chars": 1}, {"prefix_chars": 10_000}, {"max_pages": 1}):
        assert rows(exact_dedup.decisions(odd_docs, hash_unique=True, **options), *COLUMNS) == want


def test_large_groups_are_joined_by_broadcast(odd_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", 1)
    got = exact_dedup.decisions(odd_docs, hash_unique=True)
    assert rows(got, *COLUMNS) == brute(odd_docs.collect())
    # Groups of two and more are heavy here, so none is left for the shuffle by text.
    assert "BroadcastHashJoin [text_sha256" in got._jdf.queryExecution().toString()


def test_extreme_ids(spark):
    low, high = -(2**63), 2**63 - 1
    docs = spark.createDataFrame([(high, "a"), (low, "a "), (None, "a "), (5, "a"), (low, "b"), (high, "b")], "doc_id long, text string")
    assert rows(exact_dedup.decisions(docs, hash_unique=True), *COLUMNS) == brute(docs.collect())
    assert {(r.doc_id, r.text) for r in exact_dedup.drop_copies(docs).collect()} == {(low, "a "), (low, "b")}


def test_input_columns_named_like_helpers(odd_docs):
    from pyspark.sql import functions as F

    own = odd_docs.withColumn("__row_key", F.lit("mine")).withColumn("__row_key_", F.lit(1))
    kept = exact_dedup.drop_copies(own)
    assert kept.columns == own.columns and {r[0] for r in kept.select("__row_key").collect()} == {"mine"}
    assert kept.count() == exact_dedup.drop_copies(odd_docs).count()


def test_unique_texts_are_not_hashed(odd_docs):
    got = {(r.doc_id, r.group_size): r.text_sha256 for r in exact_dedup.decisions(odd_docs).collect()}
    assert got[0, 1] is None and got[24, 5] is not None


def test_drop_copies_keeps_one_row_of_each_text(odd_docs, clashing):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [without_spaces(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({without_spaces(r.text) for r in odd_docs.collect()})
    again = exact_dedup.drop_copies(clashing)
    assert again.columns == clashing.columns
    assert rows(again, "doc_id", "text") == rows(kept, "doc_id", "text")


def test_large_group_and_empty_table(spark, no_docs):
    many = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) as text")
    got = exact_dedup.decisions(many)
    assert got.filter("kept").count() == 2001 and got.agg({"group_size": "max"}).first()[0] == 1000
    assert exact_dedup.decisions(no_docs).count() == 0 and exact_dedup.drop_copies(no_docs).count() == 0
