"""Quality by hierarchical empirical Bayes over documents, paths and hosts.

A document's own evidence is the log-likelihood ratio of a naive Bayes
classifier on a few binned text features.  Hosts shrink toward the global mean
and paths toward their host, each by a strength estimated from all groups of
the level (method of moments), so a sparse site says little and a large one
speaks for itself.  A document's score is its evidence on top of the prior odds
of its path, its own contribution left out.  Levels are plain grouped
aggregates: a hot host is folded before the shuffle, and host and path tables
are joined back on narrow rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandkit.llm.text import pin

BINS = 16
KEEP = 0.5
EPS = 1e-6
FEATURES = ("symbols", "capitals", "digits", "repeated_lines", "repeated_words", "words")


def training_row(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def site_levels(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and host with the first path segment of a URL; '' where there is none."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    first = F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1), F.lit(""))
    return host, F.concat(host, F.lit("/"), first)


def _log_bin(share: Column, scale: int) -> Column:
    return F.least(F.floor(F.log2(1 + share * scale)), F.lit(BINS - 1)).cast("int")


def features(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and a bin (0 to 15) per feature; NULL texts count as empty, NULL sites as ''."""
    rows = docs.select(
        "doc_id",
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    n = F.greatest(F.length("text"), F.lit(1))

    def share(kept: str) -> Column:
        return (F.length("text") - F.length(F.regexp_replace("text", kept, ""))) / n

    counted = rows.select(
        "doc_id",
        "host",
        "path",
        share(r"[^\p{L}\p{N}\s.,]").alias("symbols"),
        share("[A-Z]").alias("capitals"),
        share("[0-9]").alias("digits"),
        F.split("text", "\n").alias("l"),
        F.split(F.btrim(F.lower("text"), F.lit(" \n\t\r")), r"[ \n\t\r]+").alias("w"),
    )
    return counted.select(
        "doc_id",
        "host",
        "path",
        _log_bin(F.col("symbols"), 1024).alias("symbols"),
        _log_bin(F.col("capitals"), 1024).alias("capitals"),
        _log_bin(F.col("digits"), 1024).alias("digits"),
        _log_bin(1 - F.size(F.array_distinct("l")) / F.size("l"), 1024).alias("repeated_lines"),
        F.floor((1 - F.size(F.array_distinct("w")) / F.size("w")) * (BINS - 1)).cast("int").alias("repeated_words"),
        _log_bin(F.size("w"), 1).alias("words"),
    )


@dataclass
class Evidence:
    """Log-likelihood ratios per feature and bin, and the log odds of good quality among training rows."""

    ratios: dict[str, list[float]]
    prior: float

    def column(self) -> Column:
        total = F.lit(0.0)
        for name, values in self.ratios.items():
            total = total + F.element_at(F.array(*[F.lit(v) for v in values]), F.col(name) + 1)
        return total


def fit_evidence(bins: DataFrame, labels: DataFrame) -> Evidence:
    """Counts of every feature bin by label over all labelled training rows.

    A doc_id labelled twice counts as bad if any label says so.  Without labels
    every ratio is 0 and the prior even.
    """
    known = (
        labels.select("doc_id", F.col("quality").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(training_row(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("y").cast("int").alias("y"))
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in FEATURES])).alias("p")
    table = bins.join(known, "doc_id").select("y", pairs).groupBy("p.f", "p.bin", "y").agg(F.count("*").alias("n"))
    # At most features x bins x labels rows.
    counts = {(r.f, r.bin, r.y): r.n for r in table.collect()}
    size = {y: sum(n for (f, _, label), n in counts.items() if f == FEATURES[0] and label == y) for y in (0, 1)}

    def ratio(f: str, b: int) -> float:
        return log((counts.get((f, b, 1), 0) + 1) / (size[1] + BINS)) - log((counts.get((f, b, 0), 0) + 1) / (size[0] + BINS))

    ratios = {f: [ratio(f, b) for b in range(BINS)] for f in FEATURES}
    return Evidence(ratios, log((size[1] + 1) / (size[0] + 1)))


def shrinkage(groups: DataFrame) -> tuple[float, float]:
    """Global mean and prior strength of a level, from per-group n, s1 (sum) and s2 (sum of squares)."""
    r = groups.agg(
        F.count("*").alias("g"),
        F.sum("n").alias("n"),
        F.sum("s1").alias("s1"),
        F.sum(F.col("s1") * F.col("s1") / F.col("n")).alias("between"),
        F.sum("s2").alias("s2"),
        F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"),
    ).first()
    if not r.n:
        return 0.5, 1.0
    mean = r.s1 / r.n
    within = max((r.s2 - r.between) / max(r.n - r.g, 1), EPS)
    spread = (r.between - r.n * mean * mean - (r.g - 1) * within) / max(r.n - r.nn / r.n, EPS)
    return mean, min(max(within / max(spread, EPS), 1.0), 1e6)


def posteriors(evidence: DataFrame, prior: float) -> DataFrame:
    """Scores from rows (doc_id, host, path, evidence): host_posterior, path_posterior, score.

    ``path_posterior`` leaves the row itself out; a path with one row has its
    host's value.  Rows with equal paths but other hosts are separate groups.
    """
    p = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    rows = evidence.withColumn("p", p)
    paths = pin(
        rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s1"), F.sum(F.col("p") * F.col("p")).alias("s2")),
        "quality-paths",
        few_files=True,
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    mean, host_strength = shrinkage(hosts)
    _, path_strength = shrinkage(paths)
    host_level = hosts.select("host", ((F.col("s1") + host_strength * mean) / (F.col("n") + host_strength)).alias("host_posterior"))
    levels = paths.join(host_level, "host").select("host", "path", "n", "s1", "host_posterior")
    own = rows.join(levels, ["host", "path"])
    path_level = (F.greatest(F.col("s1") - F.col("p"), F.lit(0.0)) + path_strength * F.col("host_posterior")) / (F.col("n") - 1 + path_strength)
    bounded = F.least(F.greatest("path_posterior", F.lit(EPS)), F.lit(1 - EPS))
    return own.withColumn("path_posterior", path_level).select(
        "doc_id",
        "evidence",
        "host_posterior",
        "path_posterior",
        (1 / (1 + F.exp(-(F.col("evidence") + F.log(bounded / (1 - bounded)))))).alias("score"),
    )


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: float = KEEP) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score, keep, per input row.

    Learns from labelled training rows only (crc32 of the doc_id).  NULL and
    empty texts get the evidence of an empty text; NULL sites are one site.
    Repeated rows give repeated results; other columns are ignored; an empty
    table gives an empty result.
    """
    bins = pin(features(docs, host, path), "quality-features")
    model = fit_evidence(bins, labels)
    rows = bins.select("doc_id", "host", "path", model.column().alias("evidence"))
    return posteriors(rows, model.prior).withColumn("keep", F.col("score") >= keep)
