"""Sales facts derived from the TPC-H-like test tables.

Role mapping: DATE = l_shipdate, CENTER = region name (via supplier ->
nation -> region) or nation name, ITEM = part type or brand, target =
l_quantity, AMOUNT = l_extendedprice, RATE = price / quantity,
BOX = l_linenumber.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandkit.spec import PanelSpec

# Column names used by every registered query on the test tables.
SALES_SPEC = PanelSpec(
    date="date",
    center="center",
    item="item",
    target="pay_weight",
    measures=(("amount", "sum"), ("rate", "mean"), ("box", "sum")),
)

CENTER_LEVELS = {"region": "r_name", "nation": "n_name"}
ITEM_LEVELS = {"type": "p_type", "brand": "p_brand"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# A dimension beyond this many rows is not broadcast: its file size, which Spark goes by, says little about its
# size as a hash table (up to 64 bytes a row), and the driver holds that.
BROADCAST_ROWS = 1 << 18


def _dimension(rows: DataFrame) -> DataFrame:
    """``rows`` to be joined with a fact: left to Spark, or shuffled if there are more than ``BROADCAST_ROWS``."""
    return rows.hint("merge") if rows.count() > BROADCAST_ROWS else rows


def _with_roles(spark: SparkSession, sf_dir: str, facts: DataFrame, center_level: str, item_level: str, roles) -> DataFrame:
    """``facts`` with the ``center`` and ``item`` columns that ``roles`` asks for.

    An inner join cannot be pruned, so a role that no one reads is not joined.
    Dimensions join the fact one after another; Spark broadcasts each small one
    by its real file size or shuffles, and shuffles the others."""
    if "item" in roles:
        part = table(spark, sf_dir, "part").select("p_partkey", F.col(ITEM_LEVELS[item_level]).alias("item"))
        facts = facts.join(_dimension(part), facts.l_partkey == part.p_partkey)
    if "center" in roles:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
        facts = facts.join(_dimension(supplier), facts.l_suppkey == supplier.s_suppkey)
        facts = facts.join(nation, facts.s_nationkey == nation.n_nationkey)
        if center_level == "region":
            region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
            facts = facts.join(region, facts.n_regionkey == region.r_regionkey)
        facts = facts.withColumn("center", F.col(CENTER_LEVELS[center_level]))
    return facts


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )


def sales(
    spark: SparkSession, sf_dir: str, center_level: str = "region", item_level: str = "type", roles=("center", "item")
) -> DataFrame:
    """Typed sales fact: date, center, item, pay_weight, amount, rate, box.

    ``roles`` names the series keys to join (both by default); only the columns
    used are read (column pruning reaches the Parquet scan)."""
    joined = _with_roles(spark, sf_dir, _lineitem(spark, sf_dir), center_level, item_level, roles)
    return joined.select(
        F.to_date("l_shipdate").alias("date"),
        *[r for r in ("center", "item") if r in roles],
        F.col("l_quantity").alias("pay_weight"),
        F.col("l_extendedprice").alias("amount"),
        F.try_divide("l_extendedprice", "l_quantity").alias("rate"),
        F.col("l_linenumber").cast("double").alias("box"),
    )


def raw_sales(
    spark: SparkSession, sf_dir: str, center_level: str = "region", item_level: str = "type", roles=("center", "item")
) -> DataFrame:
    """The same fact as it would arrive in a CSV: every column a STRING,
    reference-style names, timestamps with time of day kept as text."""
    joined = _with_roles(spark, sf_dir, _lineitem(spark, sf_dir), center_level, item_level, roles)
    names = {"center": "CENTER NAME", "item": "ITEM"}
    return joined.select(
        F.col("l_shipdate").cast("string").alias("DATE"),
        *[F.col(r).alias(names[r]) for r in ("center", "item") if r in roles],
        F.col("l_quantity").cast("string").alias("PAY WEIGHT"),
        F.col("l_extendedprice").cast("string").alias("AMOUNT"),
        F.try_divide("l_extendedprice", "l_quantity").cast("string").alias("RATE"),
        F.col("l_linenumber").cast("string").alias("BOX"),
    )


def _pick(key: Column, cases: list[Column], otherwise: Column) -> Column:
    out = F.when(key == 0, cases[0])
    for i, c in enumerate(cases[1:], 1):
        out = out.when(key == i, c)
    return out.otherwise(otherwise)


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a careless export would write it: order_key, DATE, PARTY NAME, PAY WEIGHT as text.

    The order key decides (modulo a prime) which fault a value has: NULLs,
    missing tokens, blanks, several date layouts, impossible dates, numbers
    that are none."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate", "l_returnflag")
    day = F.to_date("l_shipdate")

    def shown(pattern: str) -> Column:
        return F.date_format(day, pattern)

    null = F.lit(None).cast("string")
    dates = [
        shown("M/d/yyyy"), shown("MM-dd-yyyy"), shown("dd.MM.yyyy"), shown("yyyyMMdd"), shown("MMM d, yyyy"),
        F.concat(shown("yyyy-MM-dd"), F.lit("T23:30:00+05:30")), F.concat(shown("yyyy/M/d"), F.lit(" 07:05")),
        F.lit(""), F.lit("not a date"), null, shown("MM/dd/yy"), F.lit("2024-02-30"),
    ]
    numbers = [F.lit(v) for v in ("", "nan", "1,000", "1.0d", " 12 ", "-3.5e2", ".5", "abc")] + [null]
    labels = [null] + [F.lit(v) for v in ("N/A", "null", "", "nan")]
    return li.select(
        F.col("l_orderkey").alias("order_key"),
        _pick(F.col("l_orderkey") % 13, dates, shown("yyyy-MM-dd")).alias("DATE"),
        _pick(F.col("l_orderkey") % 7, labels, F.col("l_returnflag")).alias("PARTY NAME"),
        _pick(F.col("l_orderkey") % 11, numbers, F.col("l_quantity").cast("string")).alias("PAY WEIGHT"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
