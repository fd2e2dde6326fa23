"""CSV / Parquet / JSON scans and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from demandkit.functions.cleaning import missing_to_null

CORRUPT = "_corrupt_record"


def _csv(spark: SparkSession, sep: str, multi_line: bool):
    """Reader for RFC 4180 text: a doubled quote inside quotes is one quote."""
    return spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", str(multi_line).lower())


def _header(spark: SparkSession, path: str, sep: str, multi_line: bool) -> list[str]:
    """Column names from the header line only (reads one line, no inference)."""
    first = _csv(spark, sep, multi_line).option("header", "false").csv(path).limit(1).collect()
    if not first:
        return []
    return [str(v) if v is not None else f"_c{i}" for i, v in enumerate(first[0])]


def _scan(spark: SparkSession, path: str, columns: list[str] | None, sep: str, multi_line: bool) -> DataFrame:
    """All columns as text and ``_corrupt_record``; a file whose header differs in names or order fails the read."""
    try:
        names = columns or _header(spark, path, sep, multi_line)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"No sales file at {path}") from exc
        raise
    schema = StructType([StructField(n, StringType(), True) for n in [*names, CORRUPT]])
    return (
        _csv(spark, sep, multi_line)
        .schema(schema)
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("enforceSchema", "false")
        .option("columnPruning", "false")  # else surplus fields go unseen
        .csv(path)
    )


def _record_text(raw: DataFrame) -> Column:
    """The corrupt record's text.  Spark refuses a scan of that column alone, so the first one is read with it."""
    first = F.coalesce(F.col(f"`{raw.columns[0]}`"), F.lit(""))
    return F.concat(F.col(CORRUPT), F.substring(first, 1, 0))


def read_sales_csv(
    spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", multi_line: bool = False
) -> DataFrame:
    """Read a sales CSV with a header and an explicit all-STRING schema.

    Typing happens in the cleaning step, never by inference, so the scan is a
    single deterministic pass.  Values in ``MISSING_TOKENS`` become NULL.  Rows
    whose number of fields differs from the header are left out here and are
    what ``csv_rejects`` returns; every file under ``path`` must have the same
    header.  ``multi_line`` allows line breaks inside quotes, at the price that
    a file cannot be split among tasks.  A missing path raises
    ``FileNotFoundError``.
    """
    raw = _scan(spark, path, columns, sep, multi_line)
    names = [c for c in raw.columns if c != CORRUPT]
    return raw.filter(_record_text(raw).isNull()).select(*[missing_to_null(F.col(f"`{c}`")).alias(c) for c in names])


def csv_rejects(
    spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", multi_line: bool = False
) -> DataFrame:
    """(record): the raw text of the rows that ``read_sales_csv`` leaves out."""
    raw = _scan(spark, path, columns, sep, multi_line)
    return raw.select(_record_text(raw).alias("record")).filter(F.col("record").isNotNull())


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"Parquet data not found at {path}") from exc
        raise


def write_parquet(
    df: DataFrame, path: str, partition_by: list[str] | None = None, sort_within=None, lookup: list[str] | None = None
) -> None:
    """Overwrite ``path``; optional Hive-style partition columns, a
    partition-local sort (no global sort) so files come out ordered, and Bloom
    filters on the ``lookup`` columns."""
    if sort_within:
        # The partition columns come first: the writer needs rows by partition, and would sort again without the rest.
        df = df.sortWithinPartitions(*(partition_by or []), *sort_within)
    writer = _bloom(df.write.mode("overwrite"), lookup or [])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_partitions(df: DataFrame, path: str, partition_by: list[str], lookup: list[str] | None = None) -> None:
    """Overwrite only the Hive-style partitions that ``df`` has rows for.

    ``lookup`` names columns that are searched by value: they get Bloom filters,
    so a row group without the value is skipped (sort by them as well, so that
    few row groups have it)."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    _bloom(writer, lookup or []).parquet(path)


# Distinct values that a row group's Bloom filter is made for: 12 KB a column.  Sorted row groups have few; with more
# values the filter lets more row groups through.
BLOOM_VALUES = 10_000


def _bloom(writer, columns: list[str]):
    for name in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{name}", str(BLOOM_VALUES))
    return writer


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Write a (forecast) DataFrame as CSV part files with a header.

    Quotes are doubled, as ``read_sales_csv`` expects, and blanks around a value stay."""
    writer = df.write.mode("overwrite").option("header", str(header).lower()).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
