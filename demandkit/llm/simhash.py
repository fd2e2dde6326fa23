"""SimHash near-duplicates: pigeonhole blocks, Hamming check, connected components.

Fingerprints are made document by document (xxHash64 of word shingles, one vote
per bit).  Two fingerprints at most ``max_distance`` bits apart agree on at
least ``blocks - max_distance`` of ``blocks`` equal blocks, so joining on every
such choice of blocks finds every close pair.  Only distinct fingerprints are
joined.  A block key shared by more than ``hot_bucket`` fingerprints is not
joined with itself: its fingerprints meet at a midpoint instead (see
``_meet_in_the_middle``), which is exact and linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandkit.llm.components import connected_components
from demandkit.llm.text import few_at_a_time, once_each, only, pin, ship_package, without

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
BLOCKS = 4
HOT_BUCKET = 32
SLICE = 1 << 15  # hashes whose bits are counted at once


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text as an unsigned integer.

    Words are runs without ASCII white space after lower-casing A-Z; shingles
    repeat as often as they occur.  A text with fewer words than a shingle is
    one shingle; a text without words has fingerprint 0.  A bit is set when over
    half of the hashes have it set.
    """
    if not text:
        return 0
    words = text.encode().lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, SLICE):
        part = [digest(b" ".join(words[i : i + shingle]), 42) for i in range(lo, min(n, lo + SLICE))]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, row_key (hash of the text), fp (the fingerprint as a signed long), per input row."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.pop("text")], dtype=np.uint64)
            batch["fp"] = fps.view(np.int64)
            yield batch

    ship_package(docs.sparkSession)
    few_at_a_time(docs.sparkSession)
    text = F.col("text")
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("row_key"), "text")
    # A NULL doc_id would turn the column into floats in pandas; it travels as text.
    out = keyed.select(F.col("doc_id").cast("string").alias("doc_id"), "row_key", "text").mapInPandas(
        compute, "doc_id string, row_key long, fp long"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _block_keys(fps: DataFrame, max_distance: int, blocks: int) -> DataFrame:
    """(k, key, fp) for every choice k of the blocks that close pairs must share."""
    edges = [64 * i // blocks for i in range(blocks + 1)]

    def mask(chosen: tuple[int, ...]) -> int:
        bits = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        return bits - (1 << 64) if bits >= 1 << 63 else bits

    keys = [
        F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask(chosen))).alias("key"))
        for k, chosen in enumerate(combinations(range(blocks), blocks - max_distance))
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("b")).select("b.k", "b.key", "fp")


def _meet_in_the_middle(fps: DataFrame, max_distance: int) -> DataFrame:
    """Links among ``fps`` that connect exactly what pairs within ``max_distance`` connect.

    Every fingerprint names all points at most ceil(d/2) bits away.  Two
    fingerprints within d bits share a point that is at most floor(d/2) bits
    from one of them; fingerprints that share such a point are within d bits of
    it, so the smallest near one can stand for all links of the point.
    """
    near, far = max_distance // 2, (max_distance + 1) // 2

    def flip(positions: tuple[int, ...]) -> int:
        bits = reduce(lambda a, i: a | 1 << i, positions, 0)
        return bits - (1 << 64) if bits >= 1 << 63 else bits

    ball = [(flip(p), r <= near) for r in range(far + 1) for p in combinations(range(64), r)]
    masks = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(c).alias("close")) for m, c in ball]))
    points = fps.select("fp", masks.alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x.m")).alias("point"), "x.close")
    centre = (
        points.groupBy("point")
        .agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("centre"), F.count("*").alias("n"))
        .filter("n > 1 and centre is not null")
        .select("point", "centre")
    )
    return points.join(centre, "point").filter("fp != centre").select(F.col("centre").alias("a"), F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, blocks: int = BLOCKS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within ``max_distance`` bits."""
    if not 0 <= max_distance < blocks <= 64:
        raise ValueError(f"need 0 <= max_distance < blocks <= 64, got {max_distance} and {blocks}")
    keys = _block_keys(fps, max_distance, blocks)  # a projection of the written nodes, made again where it is read
    sizes = pin(
        keys.groupBy("k", "key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
        .filter("n > 1"),
        "simhash-buckets",
        few_files=True,
    )

    def close(a: str, b: str):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_distance

    # A bucket of two is its own pair and needs no join.
    twos = sizes.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    small = keys.join(sizes.filter(f"n > 2 and n <= {hot_bucket}").select("k", "key"), ["k", "key"], "left_semi")
    pairs = small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), ["k", "key"]).filter("a < b").select("a", "b")
    near = twos.unionByName(pairs).filter(close("a", "b")).distinct()
    hot = keys.join(sizes.filter(f"n > {hot_bucket}").select("k", "key"), ["k", "key"], "left_semi").select("fp").distinct()
    return near.unionByName(_meet_in_the_middle(hot, max_distance)).distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    blocks: int = BLOCKS,
    hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """doc_id, row_key, fingerprint (16 hex digits), component_id, n_linked, root, per input row.

    ``component_id`` is the smallest doc_id that links of at most
    ``max_distance`` bits reach, the row's own included; NULL only if every
    doc_id reached is NULL.  ``root`` is the component's smallest fingerprint, as a
    long; ``n_linked`` counts distinct fingerprints in the
    component.  NULL and empty texts have fingerprint 0 and link like any other.
    Repeated rows give repeated results; other columns are ignored; an empty
    table gives an empty result.
    """
    rows = pin(fingerprints(docs, shingle), "simhash-fingerprints")
    nodes = pin(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes", few_files=True)
    edges = pin(links(nodes.select("fp"), max_distance, blocks, hot_bucket), "simhash-links", few_files=True)
    roots = connected_components(edges)
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    whole = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_linked"))
    classes = linked.join(whole, "root").select("fp", "component_id", "n_linked", "root")
    alone = nodes.join(classes, "fp", "left_anti").select(
        "fp", F.col("first_id").alias("component_id"), F.lit(1).cast("long").alias("n_linked"), F.col("fp").alias("root")
    )
    found = classes.unionByName(alone)
    return rows.join(found, "fp").select(
        "doc_id", "row_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_linked", "root"
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Rows that repeat that document are reduced to one; a NULL doc_id is kept
    only if its component has no other.
    """
    near = pin(near_duplicates(docs, **options).select("doc_id", "row_key", "component_id", "root"), "simhash-plan", few_files=True)
    # Several texts can share one doc_id; of the id that stays, the smallest row_key does.
    firsts = near.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "row_key").agg(F.count("*").alias("n"))
    best = firsts.groupBy("root").agg(F.min(F.struct("row_key", "doc_id", "n")).alias("b"))
    keep = pin(best.select("b.doc_id", "b.row_key", "b.n"), "simhash-kept", few_files=True)
    gone = near.select("doc_id", "row_key").distinct().join(
        keep.select(F.col("doc_id").alias("k_id"), F.col("row_key").alias("k_key")),
        F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("row_key") == F.col("k_key")),
        "left_anti",
    )
    # Written, so that its size is known: a short list is broadcast and no text moves.
    gone = pin(gone, "simhash-gone", few_files=True)
    out = without(docs, gone)
    repeated = keep.filter("n > 1").select("doc_id", "row_key").distinct()
    if repeated.isEmpty():
        return out
    return without(out, repeated).unionByName(once_each(only(out, repeated)))
