"""Monitoring queries over the test tables with a fixed clock, and the same in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import CheckConfig, RunContext, TableRef, TimeBucket
from tidemark.operators import buckets, metrics, monitors, row_checks, schema_checks, scoring, sla, threshold
from tidemark.session import table

NOW = datetime(2024, 1, 31)
CTX = RunContext(NOW, "invocation", "execution")
EVENTS = CheckConfig(TableRef("events", "main"), timestamp_column="ts")
ORDERS_CTX = RunContext(datetime(2001, 8, 1), "invocation", "execution")
ORDERS = CheckConfig(TableRef("orders", "main"), timestamp_column="o_orderdate", days_back=14)
SHIPPED = CheckConfig(TableRef("lineitem", "main"), timestamp_column="l_shipdate", days_back=90, time_bucket=TimeBucket("week", 1), backfill_days=7)


def _change(config: CheckConfig, **changes) -> CheckConfig:
    from tidemark.config import with_changes

    return with_changes(config, **changes)


def _scored(df: DataFrame, config: CheckConfig, ctx: RunContext = CTX) -> DataFrame:
    start, end = buckets.regular_range(config, ctx)
    new = metrics.table_metrics(df, config, ctx, ["row_count"], start, end)
    return scoring.classify(scoring.anomaly_scores(new, config, ctx), config, ctx)


def _short(scores: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return scores.select(
        "bucket_start", "bucket_end", "metric_value", r("training_avg"), r("training_stddev"), "training_set_size", r("anomaly_score"), "is_anomalous"
    )


def _grid_sql(start: str, end: str, step: str) -> str:
    return (
        f"SELECT g AS bucket_start, g + INTERVAL {step} AS bucket_end FROM generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL {step}) t(g) "
        f"WHERE g + INTERVAL {step} <= TIMESTAMP '{end}'"
    )


def _counts_sql(name: str, ts: str, start: str, end: str, step: str, where: str = "TRUE") -> str:
    return (
        f"SELECT b.bucket_start, b.bucket_end, CAST(count(e.ts) AS DOUBLE) metric_value FROM ({_grid_sql(start, end, step)}) b "
        f"LEFT JOIN (SELECT {ts} ts FROM {name} WHERE {where}) e ON e.ts >= b.bucket_start AND e.ts < b.bucket_end GROUP BY 1, 2"
    )


def _score_sql(counts: str, season: str = "0", fail: str = "abs(anomaly_score) > 3", backfill: int = 2, train: str = "TRUE", exclude: str = "FALSE") -> str:
    return f"""
WITH c AS ({counts}),
w AS (SELECT bucket_start, bucket_end, metric_value,
  avg(CASE WHEN {train} THEN metric_value END) OVER f training_avg,
  stddev_samp(CASE WHEN {train} THEN metric_value END) OVER f training_stddev,
  count(CASE WHEN {train} THEN metric_value END) OVER f training_set_size
  FROM c WHERE NOT ({exclude}) WINDOW f AS (PARTITION BY {season} ORDER BY bucket_end ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN training_stddev IS NULL OR training_set_size = 1 THEN NULL WHEN training_stddev = 0 THEN 0
  ELSE (metric_value - training_avg) / training_stddev END anomaly_score FROM w WHERE training_avg IS NOT NULL)
SELECT bucket_start, bucket_end, metric_value, round(training_avg, 6) training_avg, round(training_stddev, 6) training_stddev,
  training_set_size, round(anomaly_score, 6) anomaly_score,
  coalesce(({fail}) AND bucket_end > (SELECT max(bucket_end) FROM s) - INTERVAL {backfill} DAY, FALSE) is_anomalous FROM s
"""


# Time buckets


def _grid(period: str, count: int, start: datetime, end: datetime):
    return lambda spark, d: buckets.bucket_grid(spark, start, end, TimeBucket(period, count))


_G0, _G1 = datetime(2024, 1, 1), datetime(2024, 1, 31, 12)
_YEAR = datetime(2023, 1, 1)


# Volume


def row_count_daily(spark: SparkSession, d: str) -> DataFrame:
    start, end = buckets.regular_range(EVENTS, CTX)
    return metrics.row_count(table(spark, d, "events"), EVENTS, start, end).select("bucket_start", "bucket_end", "metric_value")


def row_count_hourly(spark: SparkSession, d: str) -> DataFrame:
    config = _change(EVENTS, time_bucket=TimeBucket("hour", 1), where_expression="event_type = 'click'")
    start, end = buckets.regular_range(config, CTX)
    return metrics.row_count(table(spark, d, "events"), config, start, end).select("bucket_start", "bucket_end", "metric_value")


def row_count_monthly(spark: SparkSession, d: str) -> DataFrame:
    config = _change(ORDERS, time_bucket=TimeBucket("month", 1), days_back=730)
    start, end = buckets.regular_range(config, ORDERS_CTX)
    return metrics.row_count(table(spark, d, "orders"), config, start, end).select("bucket_start", "bucket_end", "metric_value")


def row_count_no_timestamp(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.row_count_now(table(spark, d, "orders"), _change(ORDERS, timestamp_column=None), CTX)
    return out.select("metric_name", "metric_value", "bucket_end")


def metric_ids(spark: SparkSession, d: str) -> DataFrame:
    start, end = buckets.regular_range(EVENTS, CTX)
    return metrics.table_metrics(table(spark, d, "events"), EVENTS, CTX, ["row_count"], start, end).select(
        "id", "full_table_name", "metric_name", "metric_value", "bucket_duration_hours"
    )


def volume_anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    return _short(_scored(table(spark, d, "events"), EVENTS))


def volume_anomaly_spike(spark: SparkSession, d: str) -> DataFrame:
    return _short(_scored(table(spark, d, "orders"), _change(ORDERS, anomaly_direction="spike", anomaly_sensitivity=1, backfill_days=14), ORDERS_CTX))


def volume_anomaly_drop(spark: SparkSession, d: str) -> DataFrame:
    return _short(_scored(table(spark, d, "orders"), _change(ORDERS, anomaly_direction="drop", anomaly_sensitivity=1, backfill_days=14), ORDERS_CTX))


def volume_anomaly_small_changes(spark: SparkSession, d: str) -> DataFrame:
    config = _change(EVENTS, spike_percent=2, drop_percent=2, anomaly_sensitivity=0.5, backfill_days=14)
    return _short(_scored(table(spark, d, "events"), config))


def volume_anomaly_one_threshold(spark: SparkSession, d: str) -> DataFrame:
    config = _change(EVENTS, spike_percent=2, anomaly_sensitivity=0.5, backfill_days=14)
    return _short(_scored(table(spark, d, "events"), config))


def volume_fail_on_zero(spark: SparkSession, d: str) -> DataFrame:
    config = _change(EVENTS, fail_on_zero=True, backfill_days=14, where_expression="event_type = 'click' AND ts < TIMESTAMP_NTZ'2024-01-29 00:00:00'")
    return _short(_scored(table(spark, d, "events"), config))


def volume_min_value(spark: SparkSession, d: str) -> DataFrame:
    config = _change(EVENTS, min_value=340, anomaly_sensitivity=0.5, backfill_days=14)
    return _short(_scored(table(spark, d, "events"), config))


def volume_seasonality_day_of_week(spark: SparkSession, d: str) -> DataFrame:
    return _short(_scored(table(spark, d, "orders"), _change(ORDERS, seasonality="day_of_week", days_back=98), ORDERS_CTX))


def volume_seasonality_hour_of_day(spark: SparkSession, d: str) -> DataFrame:
    return _short(_scored(table(spark, d, "events"), _change(EVENTS, seasonality="hour_of_day", time_bucket=TimeBucket("hour", 1))))


def volume_seasonality_hour_of_week(spark: SparkSession, d: str) -> DataFrame:
    return _short(_scored(table(spark, d, "events"), _change(EVENTS, seasonality="hour_of_week", time_bucket=TimeBucket("hour", 1), days_back=28)))


def anomaly_exclude_metrics(spark: SparkSession, d: str) -> DataFrame:
    config = _change(EVENTS, anomaly_exclude_metrics="metric_date >= DATE'2024-01-20' AND metric_date <= DATE'2024-01-22' OR metric_value > 350")
    return _short(_scored(table(spark, d, "events"), config))


def anomaly_exclude_detection(spark: SparkSession, d: str) -> DataFrame:
    return _short(_scored(table(spark, d, "events"), _change(EVENTS, exclude_detection_period_from_training=True)))


def anomaly_ranges(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    scored = _scored(table(spark, d, "events"), _change(EVENTS, anomaly_sensitivity=1, backfill_days=14))
    return scored.select("bucket_end", "value", "is_anomalous", r("min_value"), r("max_value"))


def threshold_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.threshold_sensitivity(_scored(table(spark, d, "events"), EVENTS))
    flags = [c for c in out.columns if c.startswith("is_anomaly_")]
    return out.select("bucket_end", "metric_value", *flags)


def volume_threshold(spark: SparkSession, d: str) -> DataFrame:
    return threshold.volume_threshold(row_count_monthly(spark, d), min_row_count=10)


# Freshness


def freshness_daily(spark: SparkSession, d: str) -> DataFrame:
    start, end = buckets.regular_range(EVENTS, CTX)
    out = metrics.freshness(table(spark, d, "events"), EVENTS, CTX, start, end)
    return out.select("bucket_start", "bucket_end", F.round("metric_value", 3).alias("metric_value"))


def freshness_hourly(spark: SparkSession, d: str) -> DataFrame:
    config = _change(EVENTS, time_bucket=TimeBucket("hour", 1), where_expression="event_type = 'click'")
    start, end = buckets.regular_range(config, CTX)
    out = metrics.freshness(table(spark, d, "events"), config, CTX, start, end)
    return out.select("bucket_start", "bucket_end", F.round("metric_value", 3).alias("metric_value"))


def _shipping(spark: SparkSession, d: str) -> DataFrame:
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select("l_shipdate", "o_orderdate")


SHIPPING = CheckConfig(
    TableRef("shipping", "main"),
    timestamp_column="l_shipdate",
    event_timestamp_column="o_orderdate",
    update_timestamp_column="l_shipdate",
    time_bucket=TimeBucket("week", 1),
    days_back=180,
)


def event_freshness_weekly(spark: SparkSession, d: str) -> DataFrame:
    start, end = buckets.regular_range(SHIPPING, ORDERS_CTX)
    out = metrics.event_freshness(_shipping(spark, d), SHIPPING, ORDERS_CTX, start, end)
    return out.select("bucket_start", "bucket_end", "metric_value", "source_value")


def event_freshness_now(spark: SparkSession, d: str) -> DataFrame:
    config = _change(SHIPPING, update_timestamp_column=None)
    return metrics.event_freshness(table(spark, d, "orders"), config, ORDERS_CTX, None, None).select("bucket_end", "metric_value", "source_value")


# Columns


def _column_metrics(spark: SparkSession, d: str, name: str, config: CheckConfig, columns: dict, ctx: RunContext = CTX) -> DataFrame:
    start, end = buckets.regular_range(config, ctx) if config.timestamp_column else (None, None)
    out = metrics.column_metrics(table(spark, d, name), config, ctx, columns, start, end)
    keep = ["column_name", "metric_name", F.round("metric_value", 3).alias("metric_value")]
    return out.select(*(["bucket_end"] if config.timestamp_column else []), *(["dimension_value"] if config.dimensions else []), *keep)


_NUMERIC_COLUMNS = ("l_quantity", "l_discount", "l_linenumber")
_ALL_NUMERIC = [*monitors.ANY_TYPE, *monitors.NUMERIC]
_ALL_STRING = [*monitors.ANY_TYPE, *monitors.STRING]


def column_metrics_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _column_metrics(spark, d, "lineitem", SHIPPED, dict.fromkeys(_NUMERIC_COLUMNS, _ALL_NUMERIC), ORDERS_CTX)


def column_metrics_string(spark: SparkSession, d: str) -> DataFrame:
    config = CheckConfig(TableRef("documents", "main"))
    return _column_metrics(spark, d, "documents", config, dict.fromkeys(("text", "lang", "title"), _ALL_STRING))


def column_metrics_any_type(spark: SparkSession, d: str) -> DataFrame:
    config = CheckConfig(TableRef("data_monitoring_metrics", "main"))
    return _column_metrics(spark, d, "data_monitoring_metrics", config, dict.fromkeys(("bucket_start", "updated_at"), list(monitors.ANY_TYPE)))


def column_metrics_boolean(spark: SparkSession, d: str) -> DataFrame:
    config = CheckConfig(TableRef("documents", "main"))
    return _column_metrics(spark, d, "documents", config, {"is_minor": [*monitors.BOOLEAN, "null_count"]})


def column_metrics_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    config = _change(SHIPPED, dimensions=("l_returnflag", "l_linestatus"))
    return _column_metrics(spark, d, "lineitem", config, {"l_extendedprice": ["sum", "average", "null_count"]}, ORDERS_CTX)


def all_columns_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Every column of a table with the monitors of its kind, in one scan."""
    rows = table(spark, d, "customer")
    config = CheckConfig(TableRef("customer", "main"))
    columns = dict.fromkeys(metrics.monitored_columns(rows, exclude_prefix="C_NATION"))
    return metrics.column_metrics(rows, config, CTX, columns).select("column_name", "metric_name", F.round("metric_value", 3).alias("metric_value"))


def column_anomalies(spark: SparkSession, d: str) -> DataFrame:
    config = _change(EVENTS, anomaly_sensitivity=1.5, backfill_days=14)
    start, end = buckets.regular_range(config, CTX)
    new = metrics.column_metrics(table(spark, d, "events"), config, CTX, {"value": ["average", "max"]}, start, end)
    scored = scoring.classify(scoring.anomaly_scores(new, config, CTX), config, CTX)
    return scored.select("metric_name", "bucket_end", F.round("metric_value", 6).alias("metric_value"), F.round("anomaly_score", 5).alias("anomaly_score"), "is_anomalous")


# Dimensions


def dimension_row_count(spark: SparkSession, d: str) -> DataFrame:
    config = _change(EVENTS, dimensions=("event_type",), where_expression="user_id < 100")
    start, end = buckets.regular_range(config, CTX)
    out = metrics.dimension_metrics(table(spark, d, "events"), config, CTX, start, end)
    return out.select("bucket_start", "bucket_end", "dimension", "dimension_value", "metric_value")


def dimension_no_timestamp(spark: SparkSession, d: str) -> DataFrame:
    config = CheckConfig(TableRef("orders", "main"), dimensions=("o_orderstatus", "o_orderpriority"))
    return metrics.dimension_metrics(table(spark, d, "orders"), config, CTX, None, None).select("dimension", "dimension_value", "metric_value")


def dimension_anomalies(spark: SparkSession, d: str) -> DataFrame:
    config = _change(EVENTS, dimensions=("event_type",), anomaly_sensitivity=1.5, backfill_days=14)
    start, end = buckets.regular_range(config, CTX)
    new = metrics.dimension_metrics(table(spark, d, "events"), config, CTX, start, end)
    scored = scoring.classify(scoring.anomaly_scores(new, config, CTX), config, CTX)
    return scored.select("dimension_value", "bucket_end", "metric_value", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomalous")


def collect_metrics(spark: SparkSession, d: str) -> DataFrame:
    start, end = buckets.regular_range(EVENTS, CTX)
    wanted = [{"name": "volume", "type": "row_count"}, {"name": "unknown_values", "type": "null_count", "columns": ["value", "event_type"]}]
    out = metrics.collected(table(spark, d, "events"), EVENTS, CTX, wanted, start, end)
    return out.select("column_name", "metric_name", "metric_type", "metric_value", "bucket_end")


# Stored history


def metrics_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Stored metrics once per id, as updated last."""
    rows = table(spark, d, "data_monitoring_metrics").where("id IS NOT NULL")
    return scoring.latest_by_id(rows).select("id", "updated_at")


def metrics_anomaly_score(spark: SparkSession, d: str) -> DataFrame:
    """Score and flag of each stored metric of the last days against its series' whole history."""
    out = scoring.stored_scores(table(spark, d, "data_monitoring_metrics"), CTX)
    series = ["id", "full_table_name", "column_name", "dimension", "dimension_value", "metric_name"]
    shown = lambda c: (F.round(F.col(c) + 1e-7, 3) + 0.0).alias(c)  # noqa: E731  digits that both ways of summing agree on
    training = [shown("training_avg"), shown("training_stddev"), "training_start", "training_end", "training_set_size"]
    return out.select(*series, shown("anomaly_score"), F.col("metric_value").alias("latest_metric_value"), "bucket_start", "bucket_end", *training, "updated_at", "is_anomaly")


def monitors_runs(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "data_monitoring_metrics")
        .groupBy("full_table_name", "column_name", "metric_name", "metric_properties")
        .agg(F.max("bucket_end").alias("last_bucket_end"), F.min("bucket_end").alias("first_bucket_end"))
    )


# Streams


def stream_volume(spark: SparkSession, d: str) -> DataFrame:
    """Daily rows of events by type, counted by a stream that updates a metric store, to its end."""
    import uuid

    from tidemark.session import checkpoint_dir
    from tidemark.sources.store import MetricStore
    from tidemark.streaming.volume import into_store, stream_metrics

    home = f"{checkpoint_dir(spark)}/tidemark-stream-{uuid.uuid4().hex}"
    path = f"{d}/events.parquet"
    # As a pattern: a stream takes a folder or a pattern, and the table may be one file.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    store = MetricStore(spark, f"{home}/store")
    config = _change(EVENTS, dimensions=("event_type",))
    into_store(stream_metrics(stream, config, CTX), store, CTX, f"{home}/progress", "update").awaitTermination()
    return store.read().select("bucket_start", "bucket_end", "dimension_value", "metric_value")


# Rows


def not_null(spark: SparkSession, d: str) -> DataFrame:
    return row_checks.not_null(table(spark, d, "documents"), "lang", ["doc_id", "source"])


def accepted_range(spark: SparkSession, d: str) -> DataFrame:
    return row_checks.accepted_range(table(spark, d, "part"), "p_size", 5, 45, columns=["p_partkey", "missing_column"])


def accepted_range_exclusive(spark: SparkSession, d: str) -> DataFrame:
    return row_checks.accepted_range(table(spark, d, "customer"), "c_acctbal", low=0, inclusive=False, columns=["c_custkey"])


def relationships(spark: SparkSession, d: str) -> DataFrame:
    return row_checks.relationships(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey", ["c_name"])


def unique(spark: SparkSession, d: str) -> DataFrame:
    return row_checks.unique(table(spark, d, "orders"), "o_custkey", ["o_orderkey"], row_condition="o_totalprice > 100000")


def match_regex(spark: SparkSession, d: str) -> DataFrame:
    return row_checks.match_regex(table(spark, d, "part"), "p_brand", "brand#[1-3]", flags="i", columns=["p_partkey"])


def json_valid(spark: SparkSession, d: str) -> DataFrame:
    schema = {"type": "object", "required": ["k"]}
    return row_checks.json_schema(table(spark, d, "events"), "props", schema).groupBy().agg(F.count(F.lit(1)).alias("failed"))


def python_check(spark: SparkSession, d: str) -> DataFrame:
    n = row_checks.python_check(table(spark, d, "orders"), lambda df, session, top: df.where(F.col("o_totalprice") > top), where="o_orderstatus = 'F'", top=300000)
    return spark.createDataFrame([(n,)], "failed bigint")


def failed_row_count(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 15")
    return spark.createDataFrame([(row_checks.failed_row_count(groups, "sum(n_records)"),)], "failed_rows bigint")


# Schemas


def _columns(spark: SparkSession, rows: list[tuple[str, str, str | None]]) -> DataFrame:
    return spark.createDataFrame(rows, "full_table_name string, column_name string, data_type string")


_NOW_COLUMNS = [("DB.T", "id", "STRING"), ("DB.T", "first_name", "STRING"), ("DB.T", "age", "INT"), ("DB.T", "nick", "STRING")]
_OLD_COLUMNS = [("DB.T", "id", "INT"), ("db.t", "NAME", "STRING"), ("DB.T", "nick", "string"), ("DB.GONE", "x", "INT")]


def schema_changes(spark: SparkSession, d: str) -> DataFrame:
    return schema_checks.changes(_columns(spark, _NOW_COLUMNS), _columns(spark, _OLD_COLUMNS)).select("column_name", "change", "description")


def schema_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The orders table against a declared list of columns."""
    columns = schema_checks.declared_columns(table(spark, d, "orders"), TableRef("orders", "main"))
    declared = [("MAIN.ORDERS", "o_orderkey", "BIGINT"), ("MAIN.ORDERS", "o_totalprice", "INT"), ("MAIN.ORDERS", "o_comment", None)]
    return schema_checks.changes_from_baseline(columns, declared, fail_on_added=True, enforce_types=True).select("column_name", "change")


def schema_changes_history(spark: SparkSession, d: str) -> DataFrame:
    """The latest stored snapshot of each table against the one before it; of several types of a day the greatest counts."""
    kind = F.upper(F.regexp_replace("data_type", r"\s", ""))
    stored = table(spark, d, "schema_columns_snapshot").where("full_table_name IS NOT NULL AND column_name IS NOT NULL")
    rows = stored.groupBy(F.upper("full_table_name").alias("full_table_name"), F.lower("column_name").alias("column_name"), F.to_date("detected_at").alias("day")).agg(F.max(kind).alias("data_type"))
    latest = rows.groupBy("full_table_name").agg(F.max("day").alias("last"))
    dated = rows.join(latest, "full_table_name")
    now = dated.where("day = last")
    before = dated.where("day < last").groupBy("full_table_name").agg(F.max("day").alias("previous"))
    old = dated.join(before, "full_table_name").where("day = previous")
    return schema_checks.changes(now, old).select("full_table_name", "column_name", "change")


# Deadlines


def data_freshness_sla(spark: SparkSession, d: str) -> DataFrame:
    due = sla.deadline(RunContext(datetime(2024, 1, 31, 15)), "7am", "Europe/Berlin")
    return sla.data_freshness(table(spark, d, "events"), "ts", due)


def execution_sla(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent model of the run results against a deadline on a day."""
    from tidemark.functions.text_time import clean_id, utc_instant

    due = sla.deadline(RunContext(datetime(2024, 1, 20, 23)), "10:00", "UTC")
    runs = table(spark, d, "dbt_run_results").select(clean_id("unique_id").alias("unique_id"), "status", utc_instant("generated_at").alias("completed_at"))
    top = runs.where("unique_id LIKE 'model.%'").groupBy("unique_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "unique_id")).alias("m")).first()["m"]["unique_id"]
    return sla.execution(runs, top, due)


_DAYS14 = ("2024-01-17 00:00:00", "2024-01-31 00:00:00", "1 DAY")
_ORDER_DAYS = ("2001-07-18 00:00:00", "2001-08-01 00:00:00", "1 DAY")
_DAILY = _counts_sql("events", "ts", *_DAYS14)
_HOURS14 = ("2024-01-17 00:00:00", "2024-01-31 00:00:00", "1 HOUR")


def _freshness_sql(where: str, step: str) -> str:
    return f"""
WITH b AS ({_grid_sql('2024-01-17 00:00:00', '2024-01-31 00:00:00', step)}),
u AS (SELECT DISTINCT ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' AND {where}),
g AS (SELECT ts, lag(ts) OVER (ORDER BY ts) p FROM u),
x AS (
  SELECT b.bucket_start, b.bucket_end, epoch_us(g.ts) - epoch_us(g.p) v FROM b JOIN g ON g.ts >= b.bucket_start AND g.ts < b.bucket_end WHERE g.p IS NOT NULL
  UNION ALL
  SELECT b.bucket_start, b.bucket_end, epoch_us(b.bucket_end) - epoch_us(max(u.ts)) FROM b JOIN u ON u.ts < b.bucket_end GROUP BY 1, 2)
SELECT bucket_start, bucket_end, round(max(v) / 1e6, 3) metric_value FROM x GROUP BY 1, 2
"""


def _percent_sql(part: str) -> str:
    return f"round(CAST({part} AS DOUBLE) * 100 / nullif(count(*), 0), 3)"


def _monitor_sql(m: str, c: str) -> str:
    null = f"coalesce(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0)"
    zero = f"coalesce(sum(CASE WHEN {c} IS NULL OR {c} = 0 THEN 1 ELSE 0 END), 0)"
    missing = f"coalesce(sum(CASE WHEN {c} IS NULL OR trim({c}, ' ') = '' OR lower({c}) = 'null' THEN 1 ELSE 0 END), 0)"
    return {
        "null_count": null,
        "null_percent": _percent_sql(null),
        "not_null_percent": f"round(100 - {_percent_sql(null)}, 3)",
        "zero_count": zero,
        "zero_percent": _percent_sql(zero),
        "not_zero_percent": f"round(100 - {_percent_sql(zero)}, 3)",
        "missing_count": missing,
        "missing_percent": _percent_sql(missing),
        "not_missing_percent": f"round(100 - {_percent_sql(missing)}, 3)",
        "min": f"min({c})",
        "max": f"max({c})",
        "average": f"avg({c})",
        "sum": f"sum({c})",
        "standard_deviation": f"stddev_samp({c})",
        "variance": f"var_samp({c})",
        "min_length": f"min(length({c}))",
        "max_length": f"max(length({c}))",
        "average_length": f"avg(length({c}))",
        "count_true": f"count(*) FILTER (WHERE {c})",
        "count_false": f"count(*) FILTER (WHERE NOT {c})",
    }[m]


def _columns_sql(name: str, columns: dict[str, list[str]], group: str = "", where: str = "TRUE") -> str:
    parts = []
    for c, asked in columns.items():
        for m in asked:
            parts.append(
                f"SELECT {group + ', ' if group else ''}'{c}' column_name, '{m}' metric_name, round(CAST({_monitor_sql(m, c)} AS DOUBLE), 3) metric_value "
                f"FROM {name} WHERE {where} {'GROUP BY ALL' if group else ''}"
            )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE metric_value IS NOT NULL"


_WEEK_END = "CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) + INTERVAL 7 DAY AS bucket_end"
_SHIP_WHERE = "l_shipdate >= TIMESTAMP '2001-04-30 00:00:00' AND l_shipdate < TIMESTAMP '2001-07-30 00:00:00'"

QUERIES = {
    "bucket_grid_hour": _grid("hour", 7, _G0, _G1),
    "bucket_grid_day": _grid("day", 1, _G0, _G1),
    "bucket_grid_week": _grid("week", 1, _G0, _G1),
    "bucket_grid_month": _grid("month", 2, _YEAR, _G1),
    **{
        f.__name__: f
        for f in (
            row_count_daily,
            row_count_hourly,
            row_count_monthly,
            row_count_no_timestamp,
            metric_ids,
            volume_anomaly_scores,
            volume_anomaly_spike,
            volume_anomaly_drop,
            volume_anomaly_small_changes,
            volume_anomaly_one_threshold,
            volume_fail_on_zero,
            volume_min_value,
            volume_seasonality_day_of_week,
            volume_seasonality_hour_of_day,
            volume_seasonality_hour_of_week,
            anomaly_exclude_metrics,
            anomaly_exclude_detection,
            anomaly_ranges,
            threshold_sensitivity,
            volume_threshold,
            freshness_daily,
            freshness_hourly,
            event_freshness_weekly,
            event_freshness_now,
            column_metrics_numeric,
            column_metrics_string,
            column_metrics_any_type,
            column_metrics_boolean,
            column_metrics_by_dimension,
            all_columns_defaults,
            column_anomalies,
            dimension_row_count,
            dimension_no_timestamp,
            dimension_anomalies,
            collect_metrics,
            metrics_dedup,
            metrics_anomaly_score,
            monitors_runs,
            stream_volume,
            not_null,
            accepted_range,
            accepted_range_exclusive,
            relationships,
            unique,
            match_regex,
            json_valid,
            python_check,
            failed_row_count,
            schema_changes,
            schema_baseline,
            schema_changes_history,
            data_freshness_sla,
            execution_sla,
        )
    },
}

_EVENT_COLUMN = """
WITH m AS (
  SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY bucket_end, unnest(['average', 'max']) metric_name, unnest([avg(value), max(value)]) v
  FROM events WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1),
w AS (SELECT *, avg(v) OVER f a, stddev_samp(v) OVER f s, count(v) OVER f n FROM m
  WINDOW f AS (PARTITION BY metric_name ORDER BY bucket_end ROWS UNBOUNDED PRECEDING))
SELECT metric_name, bucket_end, round(v, 6) metric_value,
  round(CASE WHEN s IS NULL OR n = 1 THEN NULL WHEN s = 0 THEN 0 ELSE (v - a) / s END, 5) anomaly_score,
  coalesce(abs((v - a) / nullif(s, 0)) > 1.5 AND bucket_end > TIMESTAMP '2024-01-17 00:00:00', FALSE) is_anomalous FROM w
"""
_DIMENSIONS = """
WITH b AS ({grid}),
c AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) bucket_start, event_type v, count(*) n FROM events
  WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' AND {where} GROUP BY 1, 2),
k AS (SELECT v, min(bucket_start) f FROM c GROUP BY v)
SELECT b.bucket_start, b.bucket_end, 'event_type' dimension, k.v dimension_value, CAST(coalesce(c.n, 0) AS DOUBLE) metric_value
FROM b JOIN k ON b.bucket_start >= k.f LEFT JOIN c ON c.bucket_start = b.bucket_start AND c.v = k.v
UNION ALL SELECT bucket_start, bucket_end, 'event_type', NULL, 0 FROM b WHERE bucket_start NOT IN (SELECT bucket_start FROM c)
"""
_GRID14 = _grid_sql(*_DAYS14)
_CONTEXT_ID = "md5('MAIN.EVENTS--row_count-row_count-' || strftime(bucket_end, '%Y-%m-%d %H:%M:%S') || '-' || '" + EVENTS.metric_properties + "')"

ORACLES = {
    "bucket_grid_hour": _grid_sql("2024-01-01 00:00:00", "2024-01-31 12:00:00", "7 HOUR"),
    "bucket_grid_day": _grid_sql("2024-01-01 00:00:00", "2024-01-31 12:00:00", "1 DAY"),
    "bucket_grid_week": _grid_sql("2024-01-01 00:00:00", "2024-01-31 12:00:00", "7 DAY"),
    "bucket_grid_month": _grid_sql("2023-01-01 00:00:00", "2024-01-31 12:00:00", "2 MONTH"),
    "row_count_daily": _DAILY,
    "row_count_hourly": _counts_sql("events", "ts", *_HOURS14, where="event_type = 'click'"),
    "row_count_monthly": _counts_sql("orders", "o_orderdate", "1999-08-01 00:00:00", "2001-08-01 00:00:00", "1 MONTH"),
    "row_count_no_timestamp": "SELECT 'row_count' metric_name, CAST(count(*) AS DOUBLE) metric_value, TIMESTAMP '2024-01-31 00:00:00' bucket_end FROM orders",
    "metric_ids": f"SELECT {_CONTEXT_ID} id, 'MAIN.EVENTS' full_table_name, 'row_count' metric_name, metric_value, 24 bucket_duration_hours FROM ({_DAILY})",
    "volume_anomaly_scores": _score_sql(_DAILY),
    "volume_anomaly_spike": _score_sql(_counts_sql("orders", "o_orderdate", *_ORDER_DAYS), fail="anomaly_score > 1", backfill=14),
    "volume_anomaly_drop": _score_sql(_counts_sql("orders", "o_orderdate", *_ORDER_DAYS), fail="anomaly_score < -1", backfill=14),
    "volume_anomaly_small_changes": _score_sql(
        _DAILY, fail="abs(anomaly_score) > 0.5 AND (metric_value > 1.02 * training_avg OR metric_value < 0.98 * training_avg)", backfill=14
    ),
    "volume_anomaly_one_threshold": _score_sql(_DAILY, fail="abs(anomaly_score) > 0.5 AND metric_value > 1.02 * training_avg", backfill=14),
    "volume_fail_on_zero": _score_sql(
        _counts_sql("events", "ts", *_DAYS14, where="event_type = 'click' AND ts < TIMESTAMP '2024-01-29 00:00:00'"),
        fail="abs(anomaly_score) > 3 OR (metric_value = 0 AND anomaly_score IS NOT NULL)",
        backfill=14,
    ),
    "volume_min_value": _score_sql(_DAILY, fail="abs(anomaly_score) > 0.5 AND metric_value >= 340", backfill=14),
    "volume_seasonality_day_of_week": _score_sql(_counts_sql("orders", "o_orderdate", "2001-04-25 00:00:00", "2001-08-01 00:00:00", "1 DAY"), season="dayname(bucket_end)"),
    "volume_seasonality_hour_of_day": _score_sql(_counts_sql("events", "ts", *_HOURS14), season="hour(bucket_end)"),
    "volume_seasonality_hour_of_week": _score_sql(
        _counts_sql("events", "ts", "2024-01-03 00:00:00", "2024-01-31 00:00:00", "1 HOUR"), season="dayname(bucket_end), hour(bucket_end)"
    ),
    "anomaly_exclude_metrics": _score_sql(
        _DAILY, exclude="CAST(bucket_end AS DATE) >= DATE '2024-01-20' AND CAST(bucket_end AS DATE) <= DATE '2024-01-22' OR metric_value > 350"
    ),
    "anomaly_exclude_detection": _score_sql(_DAILY, train="bucket_end <= TIMESTAMP '2024-01-29 00:00:00'"),
    "anomaly_ranges": f"""
WITH c AS ({_DAILY}),
w AS (SELECT *, avg(metric_value) OVER f a, stddev_samp(metric_value) OVER f s FROM c WINDOW f AS (ORDER BY bucket_end ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, greatest(a - s, 0) lo, a + s hi, coalesce(abs((metric_value - a) / nullif(s, 0)) > 1 AND bucket_end > TIMESTAMP '2024-01-17 00:00:00', FALSE) bad FROM w)
SELECT bucket_end, metric_value AS "value", bad is_anomalous,
  round(CASE WHEN bad THEN lag(lo) OVER o ELSE CASE WHEN s IS NULL THEN NULL ELSE lo END END, 6) min_value, round(CASE WHEN bad THEN lag(hi) OVER o ELSE hi END, 6) max_value
FROM (SELECT * REPLACE (CASE WHEN s IS NULL THEN NULL ELSE lo END AS lo) FROM x) WINDOW o AS (ORDER BY bucket_end)""",
    "threshold_sensitivity": "SELECT bucket_end, metric_value, "
    + ", ".join(f"coalesce(abs(anomaly_score) >= {x}, FALSE) is_anomaly_{str(x).replace('.', '_')}" for x in (1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5))
    + f" FROM ({_score_sql(_DAILY)})",
    "volume_threshold": f"""
WITH c AS ({_counts_sql("orders", "o_orderdate", "1999-08-01 00:00:00", "2001-08-01 00:00:00", "1 MONTH")}),
l AS (SELECT *, lag(metric_value) OVER (ORDER BY bucket_end) p FROM c),
x AS (SELECT *, CASE WHEN p >= 10 THEN (metric_value - p) / p * 100 END ch FROM l)
SELECT bucket_start, bucket_end, metric_value row_count, p previous_row_count, round(ch, 2) percent_change,
  CASE WHEN abs(ch) > 10 THEN 'error' WHEN abs(ch) > 5 THEN 'warn' ELSE 'pass' END severity,
  CASE WHEN abs(ch) > 10 THEN 2 WHEN abs(ch) > 5 THEN 1 ELSE 0 END severity_level FROM x""",
    "freshness_daily": _freshness_sql("TRUE", "1 DAY"),
    "freshness_hourly": _freshness_sql("event_type = 'click'", "1 HOUR"),
    "event_freshness_weekly": f"""
WITH b AS ({_grid_sql('2001-01-29 00:00:00', '2001-07-30 00:00:00', '7 DAY')}),
s AS (SELECT l_shipdate u, o_orderdate e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT b.bucket_start, b.bucket_end, coalesce(max(epoch_us(u) - epoch_us(e)) / 1e6, 604800.0) metric_value, strftime(max(e), '%Y-%m-%d %H:%M:%S') source_value
FROM b LEFT JOIN s ON s.u >= b.bucket_start AND s.u < b.bucket_end GROUP BY 1, 2""",
    "event_freshness_now": "SELECT TIMESTAMP '2001-08-01 00:00:00' bucket_end, (epoch_us(TIMESTAMP '2001-08-01 00:00:00') - epoch_us(max(o_orderdate))) / 1e6 metric_value, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') source_value FROM orders",
    "column_metrics_numeric": _columns_sql("lineitem", dict.fromkeys(_NUMERIC_COLUMNS, _ALL_NUMERIC), _WEEK_END, _SHIP_WHERE),
    "column_metrics_string": _columns_sql("documents", dict.fromkeys(("text", "lang", "title"), _ALL_STRING)),
    "column_metrics_any_type": _columns_sql("data_monitoring_metrics", dict.fromkeys(("bucket_start", "updated_at"), list(monitors.ANY_TYPE))),
    "column_metrics_boolean": _columns_sql("documents", {"is_minor": [*monitors.BOOLEAN, "null_count"]}),
    "column_metrics_by_dimension": _columns_sql(
        "lineitem", {"l_extendedprice": ["sum", "average", "null_count"]}, _WEEK_END + ", l_returnflag || '; ' || l_linestatus AS dimension_value", _SHIP_WHERE
    ),
    "all_columns_defaults": _columns_sql(
        "customer",
        {
            "c_custkey": [m for m in _ALL_NUMERIC if m not in monitors.NOT_BY_DEFAULT],
            "c_acctbal": [m for m in _ALL_NUMERIC if m not in monitors.NOT_BY_DEFAULT],
            "c_name": [m for m in _ALL_STRING if m not in monitors.NOT_BY_DEFAULT],
            "c_mktsegment": [m for m in _ALL_STRING if m not in monitors.NOT_BY_DEFAULT],
        },
    ),
    "column_anomalies": _EVENT_COLUMN,
    "dimension_row_count": _DIMENSIONS.format(grid=_GRID14, where="user_id < 100"),
    "dimension_no_timestamp": "SELECT 'o_orderstatus; o_orderpriority' dimension, o_orderstatus || '; ' || o_orderpriority dimension_value, CAST(count(*) AS DOUBLE) metric_value FROM orders GROUP BY 2",
    "dimension_anomalies": f"""
WITH m AS ({_DIMENSIONS.format(grid=_GRID14, where="TRUE")}),
w AS (SELECT *, avg(metric_value) OVER f a, stddev_samp(metric_value) OVER f s FROM m
  WINDOW f AS (PARTITION BY dimension_value ORDER BY bucket_end ROWS UNBOUNDED PRECEDING))
SELECT dimension_value, bucket_end, metric_value, round(CASE WHEN s IS NULL THEN NULL WHEN s = 0 THEN 0 ELSE (metric_value - a) / s END, 6) anomaly_score,
  coalesce(abs((metric_value - a) / nullif(s, 0)) > 1.5 AND bucket_end > TIMESTAMP '2024-01-17 00:00:00', FALSE) is_anomalous FROM w""",
    "collect_metrics": f"""
SELECT NULL column_name, 'volume' metric_name, 'row_count' metric_type, metric_value, bucket_end FROM ({_DAILY})
UNION ALL SELECT c, 'unknown_values', 'null_count', CAST(n AS DOUBLE), e FROM (
  SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY e, unnest(['value', 'event_type']) c, unnest([count(*) - count(value), count(*) - count(event_type)]) n
  FROM events WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1)""",
    "metrics_dedup": "SELECT id, max(updated_at) updated_at FROM data_monitoring_metrics WHERE id IS NOT NULL GROUP BY id",
    "metrics_anomaly_score": """
WITH r AS (SELECT DISTINCT id, full_table_name, column_name, dimension, dimension_value, metric_name, metric_value, source_value,
    bucket_start, bucket_end, bucket_duration_hours, updated_at FROM data_monitoring_metrics),
w AS (SELECT *, avg(metric_value) OVER f a, stddev_samp(metric_value) OVER f s0, count(metric_value) OVER f n, first_value(bucket_end) OVER f b
  FROM r WINDOW f AS (PARTITION BY metric_name, full_table_name, column_name
    ORDER BY bucket_start NULLS FIRST, id NULLS FIRST, updated_at NULLS FIRST, metric_value NULLS FIRST ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, CASE WHEN s0 < 1e-9 * abs(a) THEN 0 ELSE s0 END s FROM w
  WHERE metric_value IS NOT NULL AND a IS NOT NULL AND bucket_end >= TIMESTAMP '2024-01-24 00:00:00'),
y AS (SELECT *, CASE WHEN s IS NULL OR n = 1 THEN NULL WHEN s = 0 THEN 0 ELSE (metric_value - a) / s END z FROM x)
SELECT id, full_table_name, column_name, dimension, dimension_value, metric_name, round(z + 1e-7, 3) + 0 anomaly_score, metric_value latest_metric_value,
  bucket_start, bucket_end, round(a + 1e-7, 3) + 0 training_avg, round(s + 1e-7, 3) + 0 training_stddev, b training_start, bucket_end training_end,
  n training_set_size, updated_at, coalesce(abs(z) > 3, FALSE) is_anomaly FROM y""",
    "monitors_runs": "SELECT full_table_name, column_name, metric_name, metric_properties, max(bucket_end) last_bucket_end, min(bucket_end) first_bucket_end FROM data_monitoring_metrics GROUP BY 1, 2, 3, 4",
    "stream_volume": """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) bucket_start, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY bucket_end,
  event_type dimension_value, CAST(count(*) AS DOUBLE) metric_value FROM events GROUP BY 1, 2, 3""",
    "not_null": "SELECT lang, doc_id, source FROM documents WHERE lang IS NULL",
    "accepted_range": "SELECT p_size, p_partkey FROM part WHERE NOT (p_size >= 5) OR NOT (p_size <= 45)",
    "accepted_range_exclusive": "SELECT c_acctbal, c_custkey FROM customer WHERE NOT (c_acctbal > 0)",
    "relationships": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "unique": "SELECT o_custkey, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) n FROM orders WHERE o_totalprice > 100000) WHERE n > 1",
    "match_regex": "SELECT p_brand, p_partkey FROM part WHERE NOT regexp_matches(p_brand, 'brand#[1-3]', 'i')",
    "json_valid": "SELECT count(*) failed FROM events WHERE props IS NULL OR NOT json_valid(props) OR json_type(props) <> 'OBJECT' OR NOT json_exists(props, '$.k')",
    "python_check": "SELECT count(*) failed FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000",
    "failed_row_count": "SELECT CAST(sum(n) AS BIGINT) failed_rows FROM (SELECT o_custkey, count(*) n FROM orders GROUP BY 1 HAVING count(*) > 15)",
    "schema_changes": """SELECT * FROM (VALUES
  ('first_name', 'column_added', 'The column "first_name" was added'), ('age', 'column_added', 'The column "age" was added'),
  ('NAME', 'column_removed', 'The column "NAME" was removed'), ('id', 'type_changed', 'The type of "id" was changed from INT to STRING')) t(column_name, change, description)""",
    "schema_baseline": """SELECT column_name, change FROM (
  SELECT column_name, 'column_added' change FROM (DESCRIBE orders) WHERE column_name NOT IN ('o_orderkey', 'o_totalprice', 'o_comment')
  UNION ALL SELECT 'o_comment', 'column_removed' UNION ALL SELECT 'o_totalprice', 'type_changed')""",
    "schema_changes_history": """
WITH s AS (SELECT upper(full_table_name) t, lower(column_name) c, CAST(detected_at AS DATE) d, max(upper(regexp_replace(data_type, '\\s', '', 'g'))) k
  FROM schema_columns_snapshot WHERE full_table_name IS NOT NULL AND column_name IS NOT NULL GROUP BY 1, 2, 3),
l AS (SELECT t, max(d) d FROM s GROUP BY t), p AS (SELECT s.t, max(s.d) d FROM s JOIN l ON s.t = l.t AND s.d < l.d GROUP BY s.t),
n AS (SELECT s.* FROM s JOIN l USING (t, d) WHERE t IN (SELECT t FROM p)), o AS (SELECT s.* FROM s JOIN p USING (t, d))
SELECT coalesce(n.t, o.t) full_table_name, coalesce(n.c, o.c) column_name,
  CASE WHEN o.t IS NULL THEN 'column_added' WHEN n.t IS NULL THEN 'column_removed' ELSE 'type_changed' END "change"
FROM n FULL JOIN o ON n.t = o.t AND n.c = o.c WHERE n.t IS NULL OR o.t IS NULL OR n.k <> o.k""",
    "data_freshness_sla": "SELECT CASE WHEN max(ts) >= TIMESTAMP '2024-01-30 23:00:00' THEN 'DATA_FRESH' ELSE 'DATA_STALE' END status, NOT max(ts) >= TIMESTAMP '2024-01-30 23:00:00' is_failure, max(ts) latest, TIMESTAMP '2024-01-31 06:00:00' sla_deadline FROM events",
    "execution_sla": """
WITH r AS (SELECT lower(regexp_replace(unique_id, '^\\s+|\\s+$', '', 'g')) u, status,
  CAST(timezone('UTC', CAST(CASE WHEN regexp_matches(trim(generated_at), '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN trim(generated_at) ELSE trim(generated_at) || 'Z' END AS TIMESTAMPTZ)) AS TIMESTAMP) g FROM dbt_run_results),
t AS (SELECT u FROM r WHERE u LIKE 'model.%' GROUP BY u ORDER BY count(*) DESC, u DESC LIMIT 1),
x AS (SELECT count(*) n, min(CASE WHEN status = 'success' THEN g END) f FROM r WHERE u IN (SELECT u FROM t) AND g >= TIMESTAMP '2024-01-20 00:00:00' AND g < TIMESTAMP '2024-01-21 00:00:00')
SELECT CASE WHEN n = 0 THEN 'NOT_RUN' WHEN f IS NULL THEN 'ALL_FAILED' WHEN f <= TIMESTAMP '2024-01-20 10:00:00' THEN 'MET_SLA' ELSE 'MISSED_SLA' END status,
  NOT coalesce(n > 0 AND f <= TIMESTAMP '2024-01-20 10:00:00', FALSE) is_failure, f first_success, n runs FROM x""",
}
