"""License scans: an exact set-similarity join of text blocks with license templates.

A block is any ``block_words`` consecutive words of a document, wherever they
start.  A block matches a template when it holds at least ``threshold`` of the
template's distinct words, all of its deciding words, and none of its excluded
ones (words that make it another license).  Template words are ordered by how
many documents hold them, rarest first; then

* prefix: a block that matches holds one of the template's first words, so only
  the blocks around these words' places are looked at (each place brings the
  words around it once);
* length: those words must hold as many template words as the match needs;
* position: what is left after the first shared word must still reach the needed
  overlap;

and of the places that are left, the overlap of every block is counted exactly.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandkit.llm.text import words

# Phrases whose consecutive words name a license outright.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# Notice wordings, as (label, words, deciding words, excluded words).  The one-line MIT notice is a
# phrase above and no template: "mit" is a German word, and four of its five words stand in other notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "", ""),
    ("apache-2", "licensed under the apache license version 2 0", "apache", ""),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc", ""),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "commons noncommercial", ""),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc sa", ""),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "commons sharealike", ""),
    ("cc-by", "licensed under cc by 4 0", "cc by", "nc sa nd"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "commons attribution", "noncommercial sharealike noderivatives"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived", ""),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu", "lesser affero"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution", ""),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", ""),
]

Template = tuple[str, str, str, str]
THRESHOLD = 0.8
BLOCK_WORDS = 64


def _text_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _places(found: Column, n: Column, phrase: list[str]) -> Column:
    """Starts (0-based) of the phrase among the words; looked for only where its words occur at all."""
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(n - len(phrase), F.lit(0))),
        lambda i: reduce(and_, [F.get(found, i + k) == w for k, w in enumerate(phrase)]),
    )
    # The least common words of a phrase tend to be its longer ones.
    present = reduce(and_, [F.array_contains(found, w) for w in sorted(set(phrase), key=len, reverse=True)])
    return F.when(present & (n >= len(phrase)), starts).otherwise(F.array().cast("array<int>"))


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """``vocabulary`` by the number of documents that hold each word, rarest first (then by word).

    Counted over all documents; the result is as long as the vocabulary.
    """
    held = docs.select(F.explode(F.array_intersect(words(F.col("text")), _text_array(vocabulary))).alias("w"))
    counts = {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).limit(len(vocabulary)).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _prefixes(spark: SparkSession, templates: list[Template], order: list[str], threshold: float) -> tuple[DataFrame, list[str]]:
    """One row per template and prefix word (word, at, n, need, label, tokens, deciding, excluded), and the distinct prefix words."""
    rank = {w: i for i, w in enumerate(order)}
    rows, first = [], set()
    for label, wording, deciding, excluded in templates:
        tokens = sorted(set(wording.split()), key=rank.__getitem__)
        need = ceil(threshold * len(tokens) - 1e-9)
        for at, word in enumerate(tokens[: len(tokens) - need + 1]):
            first.add(word)
            rows.append(
                F.struct(
                    F.lit(word).alias("word"),
                    F.lit(at).alias("at"),
                    F.lit(len(tokens)).alias("n"),
                    F.lit(need).alias("need"),
                    F.lit(label).alias("label"),
                    _text_array(tokens).alias("tokens"),
                    _text_array(deciding.split()).alias("deciding"),
                    _text_array(excluded.split()).alias("excluded"),
                )
            )
    return spark.range(1).select(F.inline(F.array(*rows))), sorted(first)


def matches(
    docs: DataFrame,
    templates: list[Template] = TEMPLATES,
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, row_key, place, start, label, overlap, n): places of prefix words in blocks that meet the threshold.

    Of the blocks around a place, the best one (then the first) is told:
    ``start`` is its first word in the document.  A document has a row for a
    template if and only if any of its blocks matches.  NULL and empty texts
    have no blocks.  The template side is broadcast: its size comes from the
    templates alone.
    """
    if any(len(wording.split()) > block_words for _, wording, _, _ in templates):
        raise ValueError("a block must be at least as long as any template")
    order = word_order(docs, sorted({w for _, wording, _, _ in templates for w in wording.split()}))
    prefixes, first = _prefixes(docs.sparkSession, templates, order, threshold)
    place = F.col("place")
    low = F.greatest(place - (block_words - 1), F.lit(0))
    near = (
        docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_key"), words(F.col("text")).alias("words"))
        .filter(F.arrays_overlap("words", _text_array(first)))
        .select("doc_id", "row_key", "words", F.posexplode("words").alias("place", "word"))
        .filter(F.col("word").isin(first))
        .select("doc_id", "row_key", "word", "place", low.alias("low"), F.slice("words", low + 1, place - low + block_words).alias("around"))
    )
    # Template words around the place in global order; array_intersect keeps the order of its first argument.
    able = near.withColumn("held", F.array_intersect(_text_array(order), "around"))
    size, here = F.size("held"), F.array_position("held", F.col("word")) - 1
    left = F.least(F.col("n") - F.col("at"), size - here)
    need = F.col("need")
    pairs = able.join(F.broadcast(prefixes), "word").filter((size >= need) & (left >= need) & (F.size(F.array_intersect("held", "tokens")) >= need))

    def overlap(offset: Column) -> Column:
        block = F.slice("around", offset + 1, F.lit(block_words))
        fits = (F.size(F.array_except("deciding", block)) == 0) & ~F.arrays_overlap(block, F.col("excluded"))
        return F.when(fits, F.size(F.array_intersect("tokens", block))).otherwise(0)

    found = pairs.withColumn("overlaps", F.transform(F.sequence(F.lit(0), place - F.col("low")), overlap))
    found = found.withColumn("overlap", F.array_max("overlaps")).filter(F.col("overlap") >= need)
    start = (F.col("low") + F.array_position("overlaps", F.col("overlap")) - 1).cast("int")
    return found.select("doc_id", "row_key", "place", start.alias("start"), "label", "overlap", "n")


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: list[Template] = TEMPLATES,
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, row_key, n_words, n_base, first_word, last_word, base_labels, labels, score, per input row.

    ``base_labels`` come from phrases whose words stand consecutively, anywhere
    in the text; ``labels`` adds those of matching blocks.  ``score`` is 1 with
    a phrase, else the best block's share of its template, else 0.  NULL and
    empty texts have no words and no labels.  Repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_key"), words(F.col("text")).alias("words"))
    n = F.size("words")
    places = [_places(F.col("words"), n, wording.split()) for wording in phrases.values()]
    named = base.select(
        "doc_id", "row_key", n.cast("long").alias("n_words"), *[p.alias(f"p{i}") for i, p in enumerate(places)]
    )
    starts = [F.col(f"p{i}") for i in range(len(places))]
    label_list = F.filter(
        F.array(*[F.when(F.size(p) > 0, F.lit(label)) for label, p in zip(phrases, starts)]), lambda x: x.isNotNull()
    )
    all_starts = F.flatten(F.array(*starts))
    named = named.select(
        "doc_id",
        "row_key",
        "n_words",
        F.size(all_starts).cast("long").alias("n_base"),
        F.array_min(all_starts).cast("long").alias("first_word"),
        F.array_max(all_starts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(label_list)).alias("base_list"),
    )
    blocks = (
        matches(docs, templates, threshold, block_words)
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.col("n")).alias("share"))
    )
    a, b = named.alias("a"), blocks.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row_key") == F.col("b.row_key"))
    none = F.array().cast("array<string>")
    return a.join(b, same, "left").select(
        "a.doc_id",
        "a.row_key",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
