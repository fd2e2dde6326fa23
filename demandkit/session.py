"""Session construction and cluster-wide settings the operators rely on."""

from __future__ import annotations


import tempfile

from pyspark.sql import SparkSession

# Settings every session should carry.  ANSI mode is Spark 4's default and is
# kept on: operators use try_cast / try_divide where pandas would coerce.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets the panel join on (date, center, item) reuse the hash(center, item)
    # layout that the grid and the feature window share (no extra Exchange).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "demandkit",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine's base settings.

    ``master`` / ``shuffle_partitions`` are only set when given, so a
    cluster-submitted job keeps whatever the launcher configured.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the reliable checkpoint directory, setting one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is
    always used as is.  Only when nothing is configured (local tests) a
    fresh folder under the system temp dir is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = fallback or tempfile.mkdtemp(prefix="demandkit-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/ABFS) "
        "so lineage can be cut reliably"
    )


def default_parallelism(spark: SparkSession) -> int:
    """Number of partitions to use for shuffles the engine shapes itself."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


__all__ = ["BASE_CONF", "build_session", "default_parallelism", "ensure_checkpoint_dir"]
