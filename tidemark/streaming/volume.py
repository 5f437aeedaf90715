"""Metrics of a stream: the batch's buckets, delay and backfill as windows, watermark and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.config import CheckConfig, RunContext
from tidemark.operators.metrics import stamp
from tidemark.operators.monitors import aggregate
from tidemark.sources.store import MetricStore


def stream_metrics(stream: DataFrame, config: CheckConfig, ctx: RunContext, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Row count (and column metrics) per tumbling bucket and dimension values of a stream of rows.

    detection_delay is the watermark: rows later than that are dropped, and in append mode a bucket
    comes out once it is past. Buckets of months have no fixed length and are not for streams.
    """
    if config.time_bucket.period == "month":
        raise ValueError("month buckets have no fixed length; use the batch metrics")
    rows = stream.where(config.where_expression) if config.where_expression else stream
    rows = rows.withColumn("_ts", F.expr(config.timestamp_column).cast("timestamp")).withWatermark("_ts", f"{config.detection_delay_hours} hours")
    size = f"{config.time_bucket.count} {config.time_bucket.period}"
    offset = "4 days" if config.time_bucket.period == "week" else "0 seconds"
    keys = [F.window("_ts", size, size, offset).alias("_w")]
    if config.dimensions:
        keys.append(F.concat_ws("; ", *[F.coalesce(F.expr(d).cast("string"), F.lit("NULL")) for d in config.dimensions]).alias("_dimension_value"))
    wanted = [(None, "row_count")] + [(c, m) for c, ms in (columns or {}).items() for m in ms]
    values = [(F.count(F.lit(1)).cast("double") if c is None else aggregate(m, F.col(c))).alias(f"_{i}") for i, (c, m) in enumerate(wanted)]
    grouped = rows.groupBy(*keys).agg(*values)
    cells = F.array(*[F.struct(F.lit(c).cast("string").alias("column_name"), F.lit(m).alias("metric_name"), F.col(f"_{i}").alias("metric_value")) for i, (c, m) in enumerate(wanted)])
    dimension = F.col("_dimension_value") if config.dimensions else F.lit(None).cast("string")
    long = grouped.withColumn("_m", F.explode(cells)).select(
        "_m.column_name",
        "_m.metric_name",
        F.col("_m.metric_name").alias("metric_type"),
        "_m.metric_value",
        F.lit(None).cast("string").alias("source_value"),
        F.col("_w.start").cast("timestamp_ntz").alias("bucket_start"),
        F.col("_w.end").cast("timestamp_ntz").alias("bucket_end"),
        dimension.alias("dimension_value"),
    )
    return stamp(long, config, ctx)


def into_store(metrics: DataFrame, store: MetricStore, ctx: RunContext, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Write a stream of metrics to history; in update mode a bucket's row replaces its earlier one, which is
    how buckets are recomputed while late rows come in, and only the days touched are written. In append mode a bucket
    comes once and is appended. A repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        stamped = batch.withColumn("created_at", F.lit(ctx.now).cast("timestamp_ntz")).withColumn("bucket_date", F.to_date("bucket_end"))
        if mode == "append":
            store.append(stamped, f"{checkpoint}:{number}")
        else:
            store.upsert(stamped, "id", "updated_at")

    return metrics.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_once(stream: DataFrame, identifier: str, event_time: str, delay: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """A stream of messages with each identifier once, as long as its copies come within the delay."""
    once = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([identifier])
    return once.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
