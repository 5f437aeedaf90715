"""Half-open time buckets: grids, the bucket of a row, and which buckets a run has to compute."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import CheckConfig, RunContext, TimeBucket

_SECONDS = {"hour": 3600, "day": 86400, "week": 604800}


def midnight(t: datetime) -> datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def truncate(t: datetime, period: str) -> datetime:
    """Start of the hour, day, week (Monday) or month."""
    if period == "hour":
        return t.replace(minute=0, second=0, microsecond=0)
    day = midnight(t)
    if period == "week":
        return day - timedelta(days=day.weekday())
    return day.replace(day=1) if period == "month" else day


def add(t: datetime, bucket: TimeBucket, n: int = 1) -> datetime:
    """t moved by n buckets; month starts stay on the first."""
    if bucket.period == "month":
        months = t.year * 12 + t.month - 1 + n * bucket.count
        return t.replace(year=months // 12, month=months % 12 + 1)
    return t + timedelta(seconds=_SECONDS[bucket.period] * bucket.count * n)


def full_buckets(start: datetime, end: datetime, bucket: TimeBucket) -> int:
    """How many whole buckets fit from start to end."""
    if bucket.period == "month":
        months = (end.year - start.year) * 12 + end.month - start.month
        if add(start, TimeBucket("month", 1), months) > end:
            months -= 1
        return max(0, months // bucket.count)
    return max(0, int((end - start).total_seconds()) // (_SECONDS[bucket.period] * bucket.count))


def detection_end(config: CheckConfig, ctx: RunContext) -> datetime:
    return ctx.run_started_at - timedelta(hours=config.detection_delay_hours)


def regular_range(config: CheckConfig, ctx: RunContext) -> tuple[datetime, datetime]:
    """(first bucket start, last full bucket's end) of the training and detection periods."""
    end = detection_end(config, ctx)
    start = truncate(midnight(end - timedelta(days=config.days_back)), config.time_bucket.period)
    return start, add(start, config.time_bucket, full_buckets(start, end, config.time_bucket))


def backfill_start(config: CheckConfig, ctx: RunContext) -> datetime:
    return midnight(detection_end(config, ctx) - timedelta(days=config.backfill_days))


def incremental_range(config: CheckConfig, ctx: RunContext, known_ends: DataFrame | None) -> tuple[datetime, datetime]:
    """The buckets to compute when known_ends (bucket_end) are stored: from the first missing one or the
    backfill start, whichever is earlier, moved down onto the grid. All of them without a store."""
    start, end = regular_range(config, ctx)
    if known_ends is None or config.force_metrics_backfill:
        return start, end
    grid = bucket_grid(known_ends.sparkSession, start, end, config.time_bucket)
    missing = grid.join(known_ends.select("bucket_end").distinct(), "bucket_end", "left_anti").agg(F.min("bucket_start")).first()[0]
    first = min(filter(None, (missing, backfill_start(config, ctx))))
    down = full_buckets(start, max(first, start), config.time_bucket)
    return add(start, config.time_bucket, down), end


def bucket_grid(spark: SparkSession, start: datetime, end: datetime, bucket: TimeBucket) -> DataFrame:
    """(bucket_start, bucket_end) of every full bucket from start, up to end."""
    n = full_buckets(start, end, bucket)
    step = F.expr(f"INTERVAL {bucket.count} {bucket.period.upper()}")
    first = F.lit(start).cast("timestamp_ntz")
    starts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: first + step * k) if n else F.array(first)
    grid = spark.range(1).select(F.explode(starts).alias("bucket_start"))
    grid = grid.select("bucket_start", (F.col("bucket_start") + step).alias("bucket_end"))
    return grid if n else grid.limit(0)


def bucket_start(ts: Column, origin: datetime, bucket: TimeBucket) -> Column:
    """Start of the bucket that holds ts, on the grid from origin; plain arithmetic, no join."""
    first = F.lit(origin).cast("timestamp_ntz")
    ts = ts.cast("timestamp_ntz")
    if bucket.period == "month":
        month = F.year(ts) * 12 + F.month(ts) - F.lit(origin.year * 12 + origin.month)
        return F.add_months(first.cast("date"), (F.floor(month / bucket.count) * bucket.count).cast("int")).cast("timestamp_ntz")
    size = _SECONDS[bucket.period] * bucket.count
    # Both as instants of the session's zone, so that their distance is that of the clock readings.
    seconds = F.floor((F.unix_micros(ts.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / (size * 1_000_000)) * size
    return first + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def bucket_end(start: Column, bucket: TimeBucket) -> Column:
    return start + F.expr(f"INTERVAL {bucket.count} {bucket.period.upper()}")


def in_range(df: DataFrame, ts: Column, start: datetime, end: datetime) -> DataFrame:
    """Rows from start up to end; literals, so that the scan can skip row groups."""
    return df.where((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz")))
