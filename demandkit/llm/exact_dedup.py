"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Two texts are equal when they are identical without their ASCII white space.
Only documents whose length occurs twice get their prefix compared, and only
documents whose (length, prefix hash) occurs twice get their whole text hashed.
Every grouping is a partial + final aggregate over keys of a few bytes, so a
group that holds a third of all rows is folded before the shuffle and no text
is ever collected per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandkit.llm.text import once_each, only, pin, without, without_spaces

PREFIX_CHARS = 64
PAGE_BITS = 32768  # of one bitmap made by bitmap_construct_agg (4 KB)
MAX_PAGES = 4096  # at most 16 MB are broadcast
HEAVY_ROWS = 512  # distinct documents of one text; larger groups may be joined by broadcast
HEAVY_GROUPS = 10_000  # at most so many of them


def _key_slot(slots: int):
    """Where (length, prefix hash) falls in a bitmap of ``slots`` bits."""
    return F.pmod(F.xxhash64("n_bytes", "prefix"), F.lit(slots))


def decisions(docs: DataFrame, hash_unique: bool = False, prefix_chars: int = PREFIX_CHARS, max_pages: int = MAX_PAGES) -> DataFrame:
    """One row per input row: doc_id, row_key, copy, n_points, keep_id, group_size, kept, text_sha256.

    The row with the most code points in its original text stays, then the one
    with the smallest doc_id (a NULL doc_id loses to any other).  NULL text
    counts as empty; all empty texts are one group.  Rows that repeat both
    doc_id and text are numbered by ``copy`` and only copy 0 can be kept.
    ``row_key`` is a hash of the original text, so (doc_id, row_key) identifies
    a document even if a doc_id is used twice.  ``text_sha256`` is NULL for
    documents that the earlier steps prove unique, unless ``hash_unique``.
    Other columns of ``docs`` are ignored, whatever their names; an empty table
    gives an empty result.

    The surviving (length, prefix hash) pairs reach the second scan as a bitmap
    of about 16 bits a pair, never over ``max_pages`` pages.  A bit can be
    shared, so a unique text may be hashed in vain, but none is missed; past the
    bound more texts are hashed and the result is the same.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), without_spaces(F.col("text")).alias("norm")
    ).select(
        "doc_id",
        F.xxhash64("text").alias("row_key"),
        F.length("text").cast("long").alias("n_points"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"),
        "norm",
    )
    lengths = rows.groupBy("n_bytes").agg(F.count("*").alias("n")).filter("n > 1").select("n_bytes")
    prefixes = rows.groupBy("n_bytes", "prefix").agg(F.count("*").alias("n"))
    suspects = pin(prefixes.join(lengths, "n_bytes", "left_semi").filter("n > 1").select("n_bytes", "prefix"), "dedup-suspects", few_files=True)
    pages = min(max_pages, max(1, -(-16 * suspects.count() // PAGE_BITS)))
    slot = _key_slot(pages * PAGE_BITS)
    bitmap = (
        suspects.select(slot.alias("slot"))
        .groupBy((F.col("slot") / PAGE_BITS).cast("int").alias("page"))
        .agg(F.bitmap_construct_agg(F.col("slot") % PAGE_BITS).alias("bits"))
    )
    byte = F.substring("bits", ((F.col("slot") % PAGE_BITS) / 8).cast("int") + 1, F.lit(1))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("slot") % 8).cast("int")) == 1
    probed = (
        rows.withColumn("slot", slot)
        .withColumn("page", (F.col("slot") / PAGE_BITS).cast("int"))
        .join(F.broadcast(bitmap), "page", "left")
        .withColumn("suspect", F.coalesce(hit, F.lit(False)))
    )
    digest = F.sha2("norm", 256)
    full = pin(
        probed.select(
            "doc_id", "row_key", "n_points", "suspect", (digest if hash_unique else F.when(F.col("suspect"), digest)).alias("text_sha256")
        ),
        "dedup-hashes",
    )
    alone = full.filter(~F.col("suspect")).select(
        "doc_id",
        "row_key",
        F.lit(0).alias("copy"),
        "n_points",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    members = full.filter("suspect").groupBy("text_sha256", "doc_id", "row_key", "n_points").agg(F.count("*").alias("copies"))
    # Most code points, then a doc_id that is there, then the smallest.
    order = F.struct((-F.col("n_points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    best = members.groupBy("text_sha256").agg(
        F.min(order).alias("best"), F.sum("copies").alias("group_size"), F.count("*").alias("n_members")
    )
    best = pin(best, "dedup-groups", few_files=True)
    # Groups of over 1 / HEAVY_GROUPS of all rows are at most so many; their members stay where they are.
    heavy = best.filter(F.col("n_members") > max(HEAVY_ROWS, full.count() // HEAVY_GROUPS))
    spread = members.join(F.broadcast(heavy), "text_sha256").unionByName(
        members.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti").join(best, "text_sha256")
    )
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_key") == F.col("best.row_key")) & (F.col("copy") == 0)
    grouped = (
        spread.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
        .select(
            "doc_id",
            "row_key",
            "copy",
            "n_points",
            F.col("best.doc_id").alias("keep_id"),
            "group_size",
            first.alias("kept"),
            "text_sha256",
        )
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of equal texts, all columns kept.

    Only the dropped documents' keys are joined to the texts.  Rows that repeat
    a whole document are reduced to one afterwards, over just those documents.
    """
    plan = pin(decisions(docs).filter("group_size > 1").select("doc_id", "row_key", "copy", "kept"), "dedup-plan", few_files=True)
    out = plan.filter("kept").select("doc_id", "row_key")
    gone = plan.select("doc_id", "row_key").distinct().alias("p")
    gone = gone.join(
        out.alias("k"), F.col("p.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("p.row_key") == F.col("k.row_key")), "left_anti"
    )
    kept = without(docs, gone)
    repeated = out.alias("k").join(
        plan.filter("copy > 0").select("doc_id", "row_key").distinct().alias("c"),
        F.col("k.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("k.row_key") == F.col("c.row_key")),
        "left_semi",
    )
    if repeated.isEmpty():
        return kept
    return without(kept, repeated).unionByName(once_each(only(kept, repeated)))
