"""Metrics of tables, columns and dimensions per time bucket: one scan and one aggregate each."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import CheckConfig, ConfigError, RunContext
from tidemark.operators import buckets, monitors


METRIC_SCHEMA = (
    "id string, full_table_name string, column_name string, metric_name string, metric_type string, metric_value double, "
    "source_value string, bucket_start timestamp_ntz, bucket_end timestamp_ntz, bucket_duration_hours int, updated_at timestamp_ntz, "
    "dimension string, dimension_value string, metric_properties string"
)
#: How far before the first bucket updates are read, to know how old the data was there.
FRESHNESS_LOOKBACK = timedelta(days=7)


def surrogate_key(*parts: Column) -> Column:
    """md5 of the parts as text, null as empty, joined by '-'."""
    return F.md5(F.concat_ws("-", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def instant_string(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def dimension_value(dimensions: tuple[str, ...]) -> Column:
    """Values joined by '; ', null as the text NULL."""
    return F.concat_ws("; ", *[F.coalesce(F.expr(d).cast("string"), F.lit("NULL")) for d in dimensions])


def scan(df: DataFrame, config: CheckConfig) -> DataFrame:
    return df.where(config.where_expression) if config.where_expression else df


def stamp(df: DataFrame, config: CheckConfig, ctx: RunContext) -> DataFrame:
    """Rows (column_name, metric_name, metric_type, metric_value, source_value, bucket_start, bucket_end,
    dimension_value) to metric rows; values of max_int and above are not kept."""
    hours = F.expr("CAST(timestampdiff(HOUR, bucket_start, bucket_end) AS int)")
    dimension = F.lit(config.dimension).cast("string")
    rows = df.where(F.col("metric_value").isNull() | (F.col("metric_value") < config.max_int))
    key = [F.lit(config.table.full_name), F.col("column_name"), F.col("metric_name"), F.col("metric_type")]
    if config.dimensions:
        key += [dimension, F.col("dimension_value")]
    key += [instant_string(F.col("bucket_end")), F.lit(config.metric_properties)]
    return rows.select(
        surrogate_key(*key).alias("id"),
        F.lit(config.table.full_name).alias("full_table_name"),
        "column_name",
        "metric_name",
        "metric_type",
        F.col("metric_value").cast("double").alias("metric_value"),
        F.col("source_value").cast("string").alias("source_value"),
        "bucket_start",
        "bucket_end",
        hours.alias("bucket_duration_hours"),
        F.lit(ctx.run_started_at).cast("timestamp_ntz").alias("updated_at"),
        dimension.alias("dimension"),
        "dimension_value",
        F.lit(config.metric_properties).alias("metric_properties"),
    )


def _shape(df: DataFrame, name: str, kind: str, value: Column, source: Column | None = None, column: str | None = None, dim: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(column).cast("string").alias("column_name"),
        F.lit(name).alias("metric_name"),
        F.lit(kind).alias("metric_type"),
        value.cast("double").alias("metric_value"),
        (none if source is None else source.cast("string")).alias("source_value"),
        "bucket_start",
        "bucket_end",
        (none if dim is None else dim).alias("dimension_value"),
    )


def row_count(df: DataFrame, config: CheckConfig, start: datetime, end: datetime, name: str = "row_count") -> DataFrame:
    """Rows per full bucket, 0 for empty ones."""
    ts = F.expr(config.timestamp_column).cast("timestamp_ntz")
    rows = buckets.in_range(scan(df, config), ts, start, end)
    counts = rows.groupBy(buckets.bucket_start(ts, start, config.time_bucket).alias("bucket_start")).agg(F.count(F.lit(1)).alias("n"))
    grid = buckets.bucket_grid(df.sparkSession, start, end, config.time_bucket)
    joined = grid.join(counts, "bucket_start", "left")
    return _shape(joined, name, "row_count", F.coalesce("n", F.lit(0)))


def row_count_now(df: DataFrame, config: CheckConfig, ctx: RunContext, name: str = "row_count") -> DataFrame:
    """The whole table's rows, at the run's time, for tables without a timestamp."""
    one = scan(df, config).agg(F.count(F.lit(1)).alias("n"))
    return _shape(_at_run(one, ctx), name, "row_count", F.col("n"))


def _at_run(df: DataFrame, ctx: RunContext) -> DataFrame:
    return df.select("*", F.lit(None).cast("timestamp_ntz").alias("bucket_start"), F.lit(ctx.run_started_at).cast("timestamp_ntz").alias("bucket_end"))


def freshness(df: DataFrame, config: CheckConfig, ctx: RunContext, start: datetime, end: datetime, name: str = "freshness") -> DataFrame:
    """Per bucket the longest time without an update: gaps between updates that end in it, and the age of the
    last update at the bucket's end (or now, if that is earlier). source_value is that update's time.

    Distinct update times are put into minutes and buckets by arithmetic. Gaps are taken within a minute,
    between the minutes of a bucket, and between a bucket's first update and the last one of the bucket
    before that has any, each over the summaries of the level below: no cross join, no global order.
    """
    ts = F.expr(config.freshness_column or config.timestamp_column).cast("timestamp_ntz")
    low = start - FRESHNESS_LOOKBACK
    early = buckets.full_buckets(low, start, config.time_bucket) + 1
    origin = buckets.add(start, config.time_bucket, -early)
    updates = buckets.in_range(scan(df, config), ts, low, end).select(ts.alias("ts")).distinct()
    age = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
    longest = lambda *gaps: F.max(F.array_max(F.filter(F.array(*gaps), lambda g: g["age"].isNotNull())))
    gap_to = lambda earlier, at: F.struct(age(earlier, at).alias("age"), at.alias("ts"))
    # Within a minute, then between the minutes of a bucket: a bucket's updates are never in one window.
    minutes = updates.withColumn("minute", F.date_trunc("MINUTE", "ts").cast("timestamp_ntz")).withColumn(
        "before", F.lag("ts").over(W.partitionBy("minute").orderBy("ts"))
    )
    per_minute = minutes.groupBy("minute").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), longest(gap_to(F.col("before"), F.col("ts"))).alias("inner"))
    placed = per_minute.withColumn("bucket_start", buckets.bucket_start(F.col("minute"), origin, config.time_bucket))
    stitched = placed.withColumn("before", F.lag("last").over(W.partitionBy("bucket_start").orderBy("minute")))
    per = stitched.groupBy("bucket_start").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), longest(F.col("inner"), gap_to(F.col("before"), F.col("first"))).alias("inner")
    )
    grid = buckets.bucket_grid(df.sparkSession, origin, end, config.time_bucket)
    # One row per bucket: the number of buckets bounds what this window sees.
    every = W.orderBy("bucket_start")
    joined = grid.join(per, "bucket_start", "left").withColumn(
        "earlier", F.last("last", ignorenulls=True).over(every.rowsBetween(W.unboundedPreceding, -1))
    )
    until = F.least(F.col("bucket_end"), F.lit(ctx.now).cast("timestamp_ntz"))
    last = F.coalesce("last", "earlier")
    candidates = F.array(F.col("inner"), gap_to(F.col("earlier"), F.col("first")), F.struct(age(last, until).alias("age"), last.alias("ts")))
    best = F.array_max(F.filter(candidates, lambda c: c["age"].isNotNull()))
    out = joined.where(F.col("bucket_start") >= F.lit(start).cast("timestamp_ntz")).withColumn("best", best)
    return _shape(out.where("best IS NOT NULL"), name, "freshness", F.col("best.age"), instant_string(F.col("best.ts")))


def event_freshness(df: DataFrame, config: CheckConfig, ctx: RunContext, start: datetime | None, end: datetime | None, name: str = "event_freshness") -> DataFrame:
    """The longest delay of an update behind its event, per bucket of the update time (empty buckets: their
    length); without update times the age of the latest event at the run."""
    event = F.expr(config.event_timestamp_column).cast("timestamp_ntz")
    rows = scan(df, config)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    if config.update_timestamp_column is None:
        one = _at_run(rows.agg(F.max(event).alias("event")), ctx)
        age = (micros(F.col("bucket_end")) - micros(F.col("event"))) / 1e6
        return _shape(one, name, "event_freshness", age, instant_string(F.col("event")))
    update = F.expr(config.update_timestamp_column).cast("timestamp_ntz")
    ranged = buckets.in_range(rows, update, start, end)
    per = ranged.groupBy(buckets.bucket_start(update, start, config.time_bucket).alias("bucket_start")).agg(
        F.max((micros(update) - micros(event)) / 1e6).alias("lag"), F.max(event).alias("event")
    )
    grid = buckets.bucket_grid(df.sparkSession, start, end, config.time_bucket).join(per, "bucket_start", "left")
    length = (micros(F.col("bucket_end")) - micros(F.col("bucket_start"))) / 1e6
    return _shape(grid, name, "event_freshness", F.coalesce("lag", length), instant_string(F.col("event")))


def table_metrics(df: DataFrame, config: CheckConfig, ctx: RunContext, kinds: list[str], start: datetime, end: datetime) -> DataFrame:
    """Metric rows of the table monitors asked for; none gives an empty table of metrics."""
    parts = []
    for k in kinds:
        if k not in monitors.TABLE_MONITORS:
            continue
        if k == "row_count":
            parts.append(row_count(df, config, start, end) if config.timestamp_column else row_count_now(df, config, ctx))
        elif k == "freshness" and config.timestamp_column:
            parts.append(freshness(df, config, ctx, start, end))
        elif k == "event_freshness" and config.event_timestamp_column:
            parts.append(event_freshness(df, config, ctx, start, end))
    if not parts:
        return df.sparkSession.createDataFrame([], METRIC_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stamp(out, config, ctx)


def column_metrics(
    df: DataFrame, config: CheckConfig, ctx: RunContext, columns: dict[str, list[str] | None], start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Metric rows of all asked columns from one scan: one aggregate, then an unpivot; null metrics are dropped.

    columns: name -> monitors (None: the defaults of its kind). With dimensions the groups are bucket
    and dimension values. Buckets without rows give no rows.
    """
    rows = scan(df, config)
    group: list[Column] = []
    if config.timestamp_column:
        ts = F.expr(config.timestamp_column).cast("timestamp_ntz")
        rows = buckets.in_range(rows, ts, start, end)
        group.append(buckets.bucket_start(ts, start, config.time_bucket).alias("_bucket_start"))
    if config.dimensions:
        group.append(dimension_value(config.dimensions).alias("_dimension_value"))
    names = {c.lower(): c for c in df.columns}
    wanted = []
    for c, asked in columns.items():
        real = names.get(c.lower())
        if real is None:
            raise ConfigError(f"there is no column {c}")
        wanted += [(real, m) for m in monitors.for_column(df.schema[real].dataType, asked)]
    if not wanted:
        return df.sparkSession.createDataFrame([], METRIC_SCHEMA)
    grouped = rows.groupBy(*group).agg(*[monitors.aggregate(m, F.col(f"`{c}`")).alias(f"_{i}") for i, (c, m) in enumerate(wanted)])
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(m).alias("metric_name"), F.col(f"_{i}").alias("metric_value")) for i, (c, m) in enumerate(wanted)])
    long = grouped.withColumn("_m", F.explode(values)).where("_m.metric_value IS NOT NULL")
    if config.timestamp_column:
        long = long.withColumn("bucket_start", F.col("_bucket_start")).withColumn("bucket_end", buckets.bucket_end(F.col("_bucket_start"), config.time_bucket))
    else:
        long = _at_run(long, ctx)
    return stamp(
        long.select(
            "_m.column_name",
            "_m.metric_name",
            F.col("_m.metric_name").alias("metric_type"),
            "_m.metric_value",
            F.lit(None).cast("string").alias("source_value"),
            "bucket_start",
            "bucket_end",
            (F.col("_dimension_value") if config.dimensions else F.lit(None).cast("string")).alias("dimension_value"),
        ),
        config,
        ctx,
    )


def monitored_columns(df: DataFrame, exclude_prefix: str | None = None, exclude_regexp: str | None = None, skip: tuple[str, ...] = ()) -> list[str]:
    """The columns that an all-columns check looks at; both exclusions ignore case and match at the start."""
    out = []
    for c in df.columns:
        if c.lower() in {s.lower() for s in skip}:
            continue
        if exclude_prefix and c.lower().startswith(exclude_prefix.lower()):
            continue
        if exclude_regexp and re.match(exclude_regexp, c, re.IGNORECASE):
            continue
        out.append(c)
    return out


def dimension_metrics(
    df: DataFrame, config: CheckConfig, ctx: RunContext, start: datetime | None, end: datetime | None, history: DataFrame | None = None, name: str = "dimension"
) -> DataFrame:
    """Rows per dimension value and bucket; values known from history or from the data count 0 in the buckets
    from their first appearance on in which they have no rows. A bucket without any rows gives a row
    with a null value and 0.

    Counts are aggregated before anything else; values and buckets then meet per value by an explode
    of the value's remaining buckets, not by a join of all values with all buckets.
    """
    if not config.dimensions:
        raise ConfigError("dimensions are mandatory for this check")
    rows, value = scan(df, config), dimension_value(config.dimensions)
    spark = df.sparkSession
    if not config.timestamp_column:
        counts = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        if history is not None:
            gone = history.where("metric_value > 0 AND dimension_value IS NOT NULL").select(F.col("dimension_value").alias("value")).distinct()
            counts = counts.unionByName(gone.join(counts, "value", "left_anti").select("value", F.lit(0).cast("bigint").alias("n")))
        return stamp(_shape(_at_run(counts, ctx), name, "dimension", F.col("n"), dim=F.col("value")), config, ctx)
    ts = F.expr(config.timestamp_column).cast("timestamp_ntz")
    counts = (
        buckets.in_range(rows, ts, start, end)
        .groupBy(buckets.bucket_start(ts, start, config.time_bucket).alias("bucket_start"), value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ends = buckets.bucket_end(F.col("bucket_start"), config.time_bucket)
    known = counts.select("value", ends.alias("seen"))
    if history is not None:
        known = known.unionByName(history.where("metric_value > 0 AND dimension_value IS NOT NULL").select(F.col("dimension_value").alias("value"), F.col("bucket_end").alias("seen")))
    first = known.groupBy("value").agg(F.min("seen").alias("first_seen"))
    grid = buckets.bucket_grid(spark, start, end, config.time_bucket)
    n = buckets.full_buckets(start, end, config.time_bucket)
    step = F.expr(f"INTERVAL {config.time_bucket.count} {config.time_bucket.period.upper()}")
    origin = F.lit(start).cast("timestamp_ntz")
    all_starts = F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda k: origin + step * k)
    due = first.select("value", F.explode(F.filter(all_starts, lambda b: b + step >= F.col("first_seen"))).alias("bucket_start"))
    if not n:
        due = due.limit(0)
    filled = due.join(counts, ["value", "bucket_start"], "left").select("value", "bucket_start", F.coalesce("n", F.lit(0)).alias("n"))
    empty = grid.join(counts.select("bucket_start").distinct(), "bucket_start", "left_anti").select(F.lit(None).cast("string").alias("value"), "bucket_start", F.lit(0).cast("bigint").alias("n"))
    out = filled.unionByName(empty).withColumn("bucket_end", ends)
    return stamp(_shape(out, name, "dimension", F.col("n"), dim=F.col("value")), config, ctx)


def collected(
    df: DataFrame, config: CheckConfig, ctx: RunContext, wanted: list[dict], start: datetime | None, end: datetime | None, history: DataFrame | None = None
) -> DataFrame:
    """Named metrics to be stored without judging them: [{'name', 'type', 'columns'}].

    Names must be unique; table metrics take no columns, column metrics need some ('*' for all).
    """
    names = [m.get("name") or m["type"] for m in wanted]
    if len(set(names)) < len(names):
        raise ConfigError("metric names must be unique")
    out = None
    for m, label in zip(wanted, names):
        if m["type"] in monitors.TABLE_MONITORS or m["type"] == "dimension":
            if m.get("columns"):
                raise ConfigError(f"{m['type']} takes no columns")
            if config.dimensions:
                part = dimension_metrics(df, config, ctx, start, end, history)
            else:
                part = table_metrics(df, config, ctx, [m["type"]], start, end)
        elif m["type"] in monitors.ALL_COLUMN_MONITORS:
            columns = m.get("columns")
            if not columns:
                raise ConfigError(f"{m['type']} needs columns")
            columns = monitored_columns(df, skip=config.dimensions) if columns in ("*", ["*"]) else ([columns] if isinstance(columns, str) else columns)
            part = column_metrics(df, config, ctx, {c: [m["type"]] for c in columns}, start, end)
        else:
            raise ConfigError(f"there is no metric {m['type']}")
        part = part.withColumn("metric_name", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return df.sparkSession.createDataFrame([], METRIC_SCHEMA) if out is None else out


