"""Incremental versions of two batch operators.

* ``daily_aggregate_stream``: the daily aggregate (A1) over an unbounded
  sales stream, as an event-time ``window('1 day')`` aggregation with a
  watermark so state for closed days is dropped.
* ``drift_monitor``: the drift report (K4) of every micro-batch against a
  static reference table (profiled once), through ``foreachBatch``.

Progress lives under a location that the caller names, so a query started again
with the same location and name goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from demandkit.operators.drift import drift_report_from_profile, reference_profile
from demandkit.spec import PanelSpec


def _c(name: str):
    return F.col(f"`{name}`")


def daily_aggregate_stream(stream: DataFrame, watermark: str, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Streaming A1: per (day, center, item) sums / means; ``spec.date`` must
    be a timestamp.  Rows with a NULL key form no group, as in the batch form.

    ``watermark`` (such as '2 days') is how late a sale may come.  A later one
    is dropped for good, so it must cover the longest delay of the source."""
    ts = _c(spec.date).cast("timestamp")
    aggs = [F.sum(_c(spec.target)).alias(spec.target)]
    for name, how in spec.measures:
        aggs.append((F.sum if how == "sum" else F.avg)(_c(name)).alias(name))
    keyed = stream.filter(ts.isNotNull() & _c(spec.center).isNotNull() & _c(spec.item).isNotNull())
    out = (
        keyed.withColumn("_event_ts", ts)
        .withWatermark("_event_ts", watermark)
        .groupBy(F.window("_event_ts", "1 day").alias("_day"), _c(spec.center).alias(spec.center), _c(spec.item).alias(spec.item))
        .agg(*aggs)
    )
    return out.select(F.to_date(F.col("_day.start")).alias(spec.date), spec.center, spec.item, spec.target, *spec.measure_names)


def checkpoint_location(stream: DataFrame, name: str, base: str | None = None) -> str:
    """``base``/streams/``name``; without ``base`` under the configured ``spark.checkpoint.dir``.

    ``SparkContext.getCheckpointDir`` has a new folder for every application and
    so cannot serve a restart."""
    base = base or stream.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("name a folder for the stream's progress, or set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/streams/{name}"


def drift_monitor(
    stream: DataFrame,
    reference: DataFrame,
    on_report: Callable[[DataFrame, int], None],
    threshold: float = 0.05,
    name: str = "drift_monitor",
    trigger: dict | None = None,
    location: str | None = None,
) -> StreamingQuery:
    """Start a query computing the drift report of every micro-batch against
    ``reference`` and handing it to ``on_report(report_df, batch_id)``.

    The reference's value counts and moments are computed once, before the
    stream starts (``reference_profile``, checkpointed), so a micro-batch
    scans only its own rows."""
    profile = reference_profile(reference)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        on_report(drift_report_from_profile(profile, batch, threshold), batch_id)

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location(stream, name, location))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
