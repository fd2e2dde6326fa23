"""Benchmark decontamination: a prefix-filtered join of item windows with document words.

A window is ``window`` consecutive words of a benchmark item (a shorter item is
one window).  A document holds a window only if it holds all of its words, so
the necessary prefix is a single token: the window's rarest word, by counts over
all documents.  Only document words that are some window's rarest are joined;
the window's length and the word's position in it fix where it would have to
start, and the words there are compared exactly (by hash where they are read,
then word for word).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandkit.llm.text import pin, without, words

WINDOW = 10
BROADCAST_WORDS = 1 << 20  # distinct benchmark words; tables of up to so many are broadcast (some 50 MB)


def _tokenised(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_key"), words(F.col("text")).alias("words"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win, tokens), distinct: the items' windows; ``win`` is the tokens joined by spaces."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = items.select("item_id", "words", F.explode(starts).alias("i")).select(
        "item_id", F.slice("words", F.col("i") + 1, F.lit(window)).alias("tokens")
    )
    return cut.select("item_id", F.array_join("tokens", " ").alias("win"), "tokens").distinct()


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, row_key, start, length, win): every place where a window's words stand in a document.

    ``windows`` holds (win, tokens), distinct.  Tables with one row per
    benchmark word are broadcast up to ``broadcast_words`` (counted first), so a
    common word is no hot key; beyond that they are shuffled.  Either way a word
    moves with the few words around it, never with its whole text.
    """
    spots = windows.select("win", "tokens", F.posexplode("tokens").alias("at", "word"))
    vocabulary = pin(spots.select("word").distinct(), "decontam-vocabulary", few_files=True)
    small = vocabulary.count() <= broadcast_words

    def per_word(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if small else table

    seen = (
        docs.select(F.explode(words(F.col("text"))).alias("word"))
        .join(per_word(vocabulary), "word", "left_semi")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    ranked = spots.join(per_word(seen), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("win").agg(F.min(F.struct("n", "word", "at")).alias("r"), F.first("tokens").alias("tokens"))
    # A window with a word that no document holds cannot occur.
    anchors = pin(
        rarest.filter("r.n > 0").select(
            F.col("r.word").alias("word"), F.col("r.at").alias("at"), F.size("tokens").alias("length"), F.xxhash64("win").alias("hash")
        ),
        "decontam-anchors",
        few_files=True,
    )
    keys = anchors.select("word").distinct()
    around = window - 1
    pos = F.col("pos")
    low = F.greatest(pos - around, F.lit(0))
    # The words around are cut out below the join; generated code does that only for words that the join finds.
    near = (
        _tokenised(docs)
        .select("doc_id", "row_key", "words", F.posexplode("words").alias("pos", "word"))
        .select(
            "doc_id",
            "row_key",
            "word",
            "pos",
            (pos - low).alias("before"),
            (F.size("words") - pos).alias("after"),
            F.slice("words", low + 1, pos - low + window).alias("context"),
        )
        .join(per_word(keys), "word", "left_semi")
    )
    fits = (F.col("before") >= F.col("at")) & (F.col("after") >= F.col("length") - F.col("at"))
    # Filters may run after the slice, whose start must be positive.
    there = F.array_join(F.slice("context", F.greatest(F.col("before") - F.col("at") + 1, F.lit(1)), F.col("length")), " ")
    likely = (
        near.join(anchors, "word")
        .filter(fits)
        .withColumn("win", there)
        .filter(F.xxhash64("win") == F.col("hash"))
        .select("doc_id", "row_key", (pos - F.col("at")).alias("start"), "length", "win")
    )
    # The hash only spares moving words that differ; this compares them.
    return likely.join(windows.select("win"), "win", "left_semi").select("doc_id", "row_key", "start", "length", "win")


def _covered(spans):
    """Words under spans (start, end) sorted by start."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))

    def add(acc, span):
        return F.struct(
            (acc["n"] + F.greatest(span["end"] - F.greatest(span["start"], acc["to"]), F.lit(0))).alias("n"),
            F.greatest(acc["to"], span["end"]).alias("to"),
        )

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, row_key, n_words, n_hit, n_items, items (sorted ids as text), contaminated, per input row.

    NULL and empty texts have no words and are never contaminated; items without
    words have no window; an item without an id counts its hits but is not
    listed.  Repeated rows give repeated results; rows of one item_id are one
    item.  Spans are gathered per document, at most one per start and length.
    Other columns are ignored; an empty documents table gives an empty result,
    an empty benchmark no hits.
    """
    links = benchmark_windows(benchmark, window)
    hits = occurrences(docs, links.select("win", "tokens").distinct(), window)
    key = ["doc_id", "row_key"]
    spans = hits.groupBy(*key).agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
        F.collect_set("win").alias("wins"),
    )
    covered = spans.select(*key, _covered(F.col("spans")).cast("long").alias("n_hit"), F.explode("wins").alias("win"))
    found = (
        covered.join(links.select("win", "item_id"), "win")
        .groupBy(*key, "n_hit")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .alias("h")
    )
    rows = _tokenised(docs).select(*key, F.size("words").cast("long").alias("n_words")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.row_key") == F.col("h.row_key"))
    none = F.array().cast("array<string>")
    return rows.join(found, same, "left").select(
        "d.doc_id",
        "d.row_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark, all columns kept."""
    found = contamination(docs, benchmark, window).filter("contaminated")
    return without(docs, pin(found.select("doc_id", "row_key").distinct(), "decontam-dropped", few_files=True))
