"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandkit.llm import (
    chat_format,
    decontam,
    exact_dedup,
    fill_middle,
    license_scan,
    merkle,
    minhash,
    packing,
    quality,
    sharding,
    simhash,
    token_count,
    toxicity,
)
from demandkit.llm.text import ascii_lower

PACKING_TOKENIZER = "word_bpe_49k.json"
COUNTING_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.fit_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("held_out", F.coalesce(~toxicity.training_row(F.col("doc_id")), F.lit(False)))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.place(rows, "doc_id").select(
        "*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    )


def _spans(name: str):
    return F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(name)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_format.neighbour_pairs(table(spark, sf_dir, "conversations"))
    return chat_format.format_pairs(pairs).select(
        "conv_id", "n_common", "prompt", "chosen", "rejected", _spans("chosen_spans"), _spans("rejected_spans")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(PACKING_TOKENIZER))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no URL: the source is the host, the source's language the path."""
    path = F.concat_ws("/", "source", "lang")
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), path)
    return out.withColumn("held_out", F.coalesce(~quality.training_row(F.col("doc_id")), F.lit(False)))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(COUNTING_MODEL))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("row_key", "root")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.decisions(table(spark, sf_dir, "documents"), hash_unique=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("row_key")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, threshold_percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves per language, and every leaf proven again after texts of some documents were lower-cased."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    shown = F.when(touched, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    leaf, claim = merkle.leaf_digest(*fields, F.col("text")), merkle.leaf_digest(*fields, shown)
    leaves = docs.select(
        "doc_id", F.col("lang").alias("group"), F.col("doc_id").alias("position"), leaf.alias("leaf"), F.when(touched, claim).alias("claim")
    )
    proven = merkle.manifest(leaves, ["doc_id", "claim"])
    folded = merkle.fold(F.coalesce("claim", "leaf"), F.col("path"))
    out = proven.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fill_middle.transform(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    back = fill_middle.restore(formed).withColumn("restored_sha256", F.sha2("restored", 256))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


REGISTRY = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_chat_format": op3_chat_format,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_token_count": op6_token_count,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_decontamination": op10_decontamination,
    "op11_minhash": op11_minhash,
    "op12_merkle": op12_merkle,
    "op13_fill_middle": op13_fill_middle,
}
