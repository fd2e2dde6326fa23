"""Forecast rules as a table (X2, R8): first match of thousands of keywords.

A CASE chain tests every keyword on every row and grows the plan with the
rules.  Here each keyword is filed under one of its grams, the rarest one among
the keywords; a text can hold the keyword only if it holds that gram, so an
equi-join of the texts' grams with the filed ones finds all candidates, and
``contains`` settles them.  Of the keywords found, the first rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3  # characters; shorter keywords are filed whole


def _grams(text: Column, size: Column) -> Column:
    """All distinct substrings of ``size`` characters; the empty one of any text; none if the text is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    cut = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def file_rules(rules: DataFrame, gram: int = GRAM) -> DataFrame:
    """``rules`` (with rule_order and keyword) and the ``gram`` each is filed under; keywords are upper-cased."""
    named = rules.filter(F.col("keyword").isNotNull()).withColumn("keyword", F.upper("keyword"))
    spread = named.select("rule_order", "keyword", F.explode(_grams(F.col("keyword"), F.least(F.length("keyword"), F.lit(gram)))).alias("gram"))
    frequency = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = spread.join(frequency, "gram").groupBy("rule_order", "keyword").agg(F.min(F.struct("n", "gram")).alias("g"))
    return named.join(rarest, ["rule_order", "keyword"]).select(*[f"`{c}`" for c in named.columns], F.col("g.gram").alias("gram"))


def match_rules(texts: DataFrame, rules: DataFrame, column: str = "item", gram: int = GRAM) -> DataFrame:
    """One row per distinct text: ``column`` and the columns of its first rule (NULL where no keyword is in it).

    ``rules`` has rule_order (smaller first, unique), keyword (any case) and any
    further columns.  An empty keyword matches every text; a NULL keyword or
    text matches nothing."""
    values = [c for c in rules.columns if c not in ("rule_order", "keyword")]
    distinct = texts.select(F.col(f"`{column}`").alias(column)).distinct()
    upper = F.upper(F.col(f"`{column}`"))
    own = F.flatten(F.array(*[_grams(upper, F.lit(k)) for k in range(gram + 1)]))
    grams = distinct.filter(F.col(f"`{column}`").isNotNull()).select(column, upper.alias("_upper"), F.explode(F.array_distinct(own)).alias("gram"))
    found = grams.join(file_rules(rules, gram), "gram").filter(F.contains("_upper", "keyword"))
    first = found.groupBy(column).agg(F.min_by(F.struct("rule_order", "keyword", *values), "rule_order").alias("_r"))
    matched = first.select(F.col(f"`{column}`").alias("_text"), "_r.*")
    out = distinct.join(matched, F.col(f"`{column}`") == F.col("_text"), "left")
    return out.select(f"`{column}`", "rule_order", "keyword", *[f"`{c}`" for c in values])
