"""Column expressions shared by the training-data operators, and lineage cuts."""

from __future__ import annotations

import shutil
import string
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandkit.session import ensure_checkpoint_dir

# ASCII characters that separate words; every other character belongs to one.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR_CHARS = "".join(chr(i) for i in range(128) if chr(i) not in string.digits + string.ascii_lowercase)
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; any other character stays as it is.

    ``lower`` is right (and faster) where the text is ASCII throughout.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """Words of the A-Z-lower-cased text, in order; NULL or no word gives an empty array."""
    core = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SEPARATOR_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SEPARATORS))


def without_spaces(text: Column) -> Column:
    """The text without the six ASCII white-space characters; NULL gives ''."""
    out = F.coalesce(text, F.lit(""))
    for ch in SPACES:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


_PINNED: list[str] = []


def release_pins(spark: SparkSession) -> int:
    """Delete the tables that ``pin`` has written in this process, and tell how many.

    For long-lived sessions, once the results are written elsewhere: a DataFrame
    that still reads a pinned table fails from then on.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths, _PINNED[:] = list(_PINNED), []
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def pin(df: DataFrame, name: str, few_files: bool = False) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts lineage with files every executor can read, so a lost executor costs a
    re-read and not a recomputation; later joins also see real table sizes.
    ``few_files`` is for what comes out of a shuffle and is much smaller than
    the documents: at most one file per core, however many shuffle partitions.
    ``release_pins`` deletes what is no longer read.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.coalesce(max(1, spark.sparkContext.defaultParallelism)) if few_files else df
    out.write.parquet(path)
    _PINNED.append(path)
    return spark.read.schema(df.schema).parquet(path)


PAGE_BITS = 32768  # of one bitmap made by bitmap_construct_agg (4 KB)
MAX_PAGES = 4096  # at most 16 MB are broadcast


def row_key() -> Column:
    """Hash of the whole original text (NULL counts as empty); with doc_id it names a document."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _fresh(docs: DataFrame, name: str = "__row_key") -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _listed(docs: DataFrame, documents: DataFrame, how: str) -> DataFrame:
    key = _fresh(docs)
    keyed = docs.withColumn(key, row_key()).alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{key}") == F.col("b.row_key"))
    return keyed.join(documents.alias("b"), same, how).drop(key)


def _flagged(rows: DataFrame, keys: DataFrame, key: str, of_keys: str) -> tuple[DataFrame, str]:
    """``rows`` with a boolean column (its name is returned): whether ``key`` may be among ``of_keys`` of ``keys``."""
    pages = min(MAX_PAGES, max(1, -(-16 * keys.count() // PAGE_BITS)))
    page, bits, flag = (_fresh(rows, name) for name in ("__page", "__bits", "__flag"))

    def place(name: str) -> Column:
        return F.pmod(F.col(name), F.lit(pages * PAGE_BITS))

    bitmap = (
        keys.select(place(of_keys).alias("slot"))
        .groupBy((F.col("slot") / PAGE_BITS).cast("int").alias(page))
        .agg(F.bitmap_construct_agg(F.col("slot") % PAGE_BITS).alias(bits))
    )
    bit = place(key) % PAGE_BITS
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    paged = rows.withColumn(page, (place(key) / PAGE_BITS).cast("int")).join(F.broadcast(bitmap), page, "left")
    return paged.withColumn(flag, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop(page, bits), flag


def perhaps_in(rows: DataFrame, keys: DataFrame, key: str = "row_key") -> DataFrame:
    """``rows`` whose ``key`` (a hash, as a long) may be among those of ``keys``; none that is gets lost.

    The keys are broadcast as a bitmap of about 16 bits each, never over 16 MB:
    some rows pass in vain, more of them if there are very many keys.  Put before
    a join, it keeps most rows that would find nothing from being shuffled.
    """
    flagged, flag = _flagged(rows, keys, key, key)
    return flagged.filter(flag).drop(flag)


def _listed(docs: DataFrame, documents: DataFrame, how: str) -> DataFrame:
    """Rows that ``documents`` names, or does not; only texts that it may name take part in the join."""
    key = _fresh(docs)
    flagged, flag = _flagged(docs.withColumn(key, row_key()), documents, key, "row_key")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{key}") == F.col("b.row_key"))
    joined = flagged.filter(flag).alias("a").join(documents.alias("b"), same, how).select("a.*")
    out = joined.unionByName(flagged.filter(~F.col(flag))) if how == "left_anti" else joined
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def without(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``documents`` (doc_id, row_key) does not name; all columns kept, whatever their names."""
    return _listed(docs, documents, "left_anti")


def only(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``documents`` (doc_id, row_key) names."""
    return _listed(docs, documents, "left_semi")


def once_each(docs: DataFrame) -> DataFrame:
    """One row of each document (doc_id and text)."""
    key = _fresh(docs)
    return docs.withColumn(key, row_key()).dropDuplicates(["doc_id", key]).drop(key)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_TEXTS = 1024  # Spark's 10 000 are tens of MB of text for each task, in the JVM and in Python, some of it twice


def few_at_a_time(spark: SparkSession) -> None:
    """From now on, Python workers get at most ``BATCH_TEXTS`` rows at once (fewer if the session says so)."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= BATCH_TEXTS:
        spark.conf.set(BATCH_ROWS, BATCH_TEXTS)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application (as --py-files would)."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix=f"{package.name}-py-")
        sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _SHIPPED.add(sc.applicationId)
