"""Configuration, buckets, metrics, scoring and checks with a fixed clock."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import rows
from tidemark.checks import Monitor
from tidemark.config import CheckConfig, ConfigError, RunContext, TableRef, TimeBucket, argument, model_config, resolve
from tidemark.functions import scalars
from tidemark.operators import buckets, metrics, monitors, row_checks, schema_checks, scoring, sla, threshold
from tidemark.sources.store import MetricStore, ParquetTable

NOW = datetime(2024, 1, 31)
CTX = RunContext(NOW, "inv", "exec")


def days(spark, counts, column="updated_at"):
    """Rows per day, the last entry being the day before NOW."""
    data = [(NOW - timedelta(days=len(counts) - i) + timedelta(minutes=k), "x") for i, n in enumerate(counts) for k in range(n)]
    return spark.createDataFrame(data, f"{column} timestamp_ntz, superhero string")


def monitor(spark, counts, **kw):
    return Monitor(days(spark, counts), TableRef("t", "s", "d"), CTX, **kw)


def bad(scores):
    return {r["bucket_end"] for r in scores.where("is_anomalous").collect()}


# configuration


def test_layers_and_defaults():
    assert TableRef("t", "s", "d").full_name == "D.S.T" and TableRef("t", "s").full_name == "S.T"
    model = {"config": {"monitoring": {"days_back": 1, "x": 1}, "meta": {"monitoring": {"days_back": 2}}}, "meta": {"monitoring": {"days_back": 3}}}
    assert model_config(model) == {"days_back": 3, "x": 1}
    assert argument("days_back", {"days_back": 9}, model, {"days_back": 5}) == 9
    assert argument("days_back", {}, model, {"days_back": 5}) == 3
    assert argument("days_back", {}, {}, {"days_back": 5}) == 5 and argument("days_back") == 14
    assert argument("fail_on_zero", {"fail_on_zero": "TRUE"}) is True


def test_derived_periods():
    table = TableRef("t")
    c = resolve(table, {"timestamp_column": "ts", "seasonality": "day_of_week"})
    assert c.days_back == 98 and c.backfill_days == 2
    c = resolve(table, {"timestamp_column": "ts", "time_bucket": {"period": "week", "count": 1}, "detection_period": {"period": "hour", "count": 30}, "training_period": {"period": "month", "count": 2}})
    assert c.backfill_days == 7 and c.days_back == 60


@pytest.mark.parametrize(
    "options",
    [
        {"anomaly_direction": "up"},
        {"time_bucket": {"period": "minute", "count": 1}},
        {"time_bucket": {"period": "day", "count": 0}},
        {"time_bucket": {"period": "day"}},
        {"seasonality": "day_of_week"},
        {"seasonality": "hour_of_day", "timestamp_column": "ts"},
        {"anomaly_sensitivity": -1},
        {"ignore_small_changes": {"spike_failure_percent_threshold": -3}},
        {"detection_delay": {"period": "month", "count": 1}},
    ],
)
def test_invalid_options(options):
    with pytest.raises(ConfigError):
        resolve(TableRef("t"), options)


# buckets

BUCKETS = st.builds(TimeBucket, st.sampled_from(["hour", "day", "week", "month"]), st.integers(1, 9))


@given(BUCKETS, st.datetimes(datetime(2001, 1, 1), datetime(2030, 1, 1)), st.integers(0, 400))
@settings(max_examples=200, deadline=None)
def test_buckets_cover_without_gaps(bucket, t, extra):
    start = buckets.truncate(t, bucket.period)
    end = start + timedelta(days=extra)
    n = buckets.full_buckets(start, end, bucket)
    assert buckets.add(start, bucket, n) <= end < buckets.add(start, bucket, n + 1)


def test_bucket_start_matches_grid(spark):
    data = spark.range(0, 400).select((F.lit(datetime(2023, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") * 23).cast("int"))).alias("ts"))
    for bucket in (TimeBucket("hour", 7), TimeBucket("day", 3), TimeBucket("week", 2), TimeBucket("month", 2)):
        origin = buckets.truncate(datetime(2023, 1, 1), bucket.period)
        grid = buckets.bucket_grid(spark, origin, datetime(2024, 3, 1), bucket)
        joined = data.select("ts", buckets.bucket_start(F.col("ts"), origin, bucket).alias("bucket_start")).join(grid, "bucket_start", "left")
        assert joined.where("bucket_end IS NOT NULL AND NOT (ts >= bucket_start AND ts < bucket_end)").count() == 0
        assert joined.where("bucket_end IS NULL").where(F.col("ts") < buckets.add(origin, bucket, buckets.full_buckets(origin, datetime(2024, 3, 1), bucket))).count() == 0


def test_incremental_range(spark):
    config = CheckConfig(TableRef("t"), timestamp_column="ts")
    start, end = buckets.regular_range(config, CTX)
    grid = buckets.bucket_grid(spark, start, end, config.time_bucket).select("bucket_end")
    assert buckets.incremental_range(config, CTX, None) == (start, end)
    assert buckets.incremental_range(config, CTX, grid)[0] == NOW - timedelta(days=2)
    gap = grid.where(F.col("bucket_end") != F.lit(start + timedelta(days=5)).cast("timestamp_ntz"))
    assert buckets.incremental_range(config, CTX, gap)[0] == start + timedelta(days=4)


# anomalies


def test_volume_clean_drop_spike_and_direction(spark):
    assert not bad(monitor(spark, [10, 11] * 10).volume_anomalies(timestamp_column="updated_at", days_back=20))
    dropped = monitor(spark, [10, 11] * 10 + [0]).volume_anomalies(timestamp_column="updated_at", days_back=21)
    assert bad(dropped) == {NOW}
    risen = monitor(spark, [10, 11] * 10 + [40])
    assert bad(risen.volume_anomalies(timestamp_column="updated_at", days_back=21, anomaly_direction="spike")) == {NOW}
    assert not bad(risen.volume_anomalies(timestamp_column="updated_at", days_back=21, anomaly_direction="drop"))


def test_where_exclusions_and_zero(spark):
    m = monitor(spark, [10, 11] * 10 + [40])
    assert not bad(m.volume_anomalies(timestamp_column="updated_at", days_back=21, where_expression="superhero = 'y'"))
    assert bad(m.volume_anomalies(timestamp_column="updated_at", days_back=21, fail_on_zero=True, where_expression="superhero = 'y'")) == {NOW, NOW - timedelta(days=1)}
    assert m.volume_anomalies(timestamp_column="updated_at", days_back=21, exclude_final_results="value > 20").count() == 1


def test_short_history_has_no_score(spark):
    out = monitor(spark, [5]).volume_anomalies(timestamp_column="updated_at", days_back=1, backfill_days=1).collect()
    assert [r["anomaly_score"] for r in out] == [None] and out[0]["anomaly_description"].startswith("Not enough data")


def test_empty_table_and_no_timestamp(spark):
    m = Monitor(days(spark, []), TableRef("t"), CTX)
    assert [r["metric_value"] for r in m.volume_anomalies(timestamp_column="updated_at", days_back=3).collect()] == [0.0] * 3
    assert [r["metric_value"] for r in m.volume_anomalies().collect()] == [0.0]
    assert m.freshness_anomalies(timestamp_column="updated_at", days_back=3).count() == 0
    assert m.column_anomalies("superhero", timestamp_column="updated_at").count() == 0


def test_freshness_stops_and_needs_timestamp(spark):
    data = [(NOW - timedelta(hours=2 * k),) for k in range(12, 12 * 25)]
    m = Monitor(spark.createDataFrame(data, "ts timestamp_ntz"), TableRef("t"), CTX)
    out = m.freshness_anomalies(timestamp_column="ts", days_back=20)
    assert NOW in bad(out)
    with pytest.raises(ConfigError):
        m.freshness_anomalies()


def test_event_freshness_checks_type(spark):
    m = Monitor(days(spark, [1]), TableRef("t"), CTX)
    with pytest.raises(ConfigError):
        m.event_freshness_anomalies("superhero")


def test_score_shift_and_incremental_equals_full(spark, tmp_path):
    counts = [10, 12, 11, 9] * 5
    store = MetricStore(spark, str(tmp_path / "store"))
    early = Monitor(days(spark, counts[:-4]).withColumn("updated_at", F.expr("updated_at - INTERVAL 4 DAY")), TableRef("t"), RunContext(NOW - timedelta(days=4), "i0", "e0"), store)
    early.volume_anomalies(timestamp_column="updated_at").count()
    early.finish()
    late = Monitor(days(spark, counts), TableRef("t"), CTX, store)
    incremental = late.volume_anomalies(timestamp_column="updated_at")
    full = Monitor(days(spark, counts), TableRef("t"), CTX).volume_anomalies(timestamp_column="updated_at")
    columns = ["bucket_end", "metric_value", "training_avg", "training_set_size"]
    assert rows(incremental.select(*columns)) == rows(full.select(*columns))
    late.finish()
    assert store.read().count() > 14 and scoring.latest_by_id(store.read()).count() == store.read().select("id").distinct().count()


def test_dimension_history_fills_zero(spark):
    df = spark.createDataFrame([(NOW - timedelta(hours=5), None), (NOW - timedelta(hours=5), "a")], "ts timestamp_ntz, k string")
    config = CheckConfig(TableRef("t"), timestamp_column="ts", dimensions=("k",), days_back=3)
    start, end = buckets.regular_range(config, CTX)
    history = spark.createDataFrame([("gone", 5.0, NOW - timedelta(days=9)), ("never", 0.0, NOW)], "dimension_value string, metric_value double, bucket_end timestamp_ntz")
    out = metrics.dimension_metrics(df, config, CTX, start, end, history)
    got = sorted((str(r["dimension_value"]), r["bucket_end"].day, r["metric_value"]) for r in out.collect())
    assert got == [("NULL", 31, 1.0), ("None", 29, 0.0), ("None", 30, 0.0), ("a", 31, 1.0), ("gone", 29, 0.0), ("gone", 30, 0.0), ("gone", 31, 0.0)]


def test_collect_metrics_names(spark):
    m = monitor(spark, [2, 2])
    out = m.collect_metrics([{"name": "n", "type": "row_count"}, {"name": "nulls", "type": "null_count", "columns": "*"}], timestamp_column="updated_at", days_back=2)
    assert {(r["metric_name"], r["column_name"]) for r in out.collect()} == {("n", None), ("nulls", "updated_at"), ("nulls", "superhero")}
    for wrong in ([{"type": "row_count"}, {"type": "row_count"}], [{"type": "row_count", "columns": ["a"]}], [{"type": "null_count"}], [{"type": "odd"}]):
        with pytest.raises(ConfigError):
            m.collect_metrics(wrong, timestamp_column="updated_at")


def test_missing_count(spark):
    df = spark.createDataFrame([(x,) for x in ("a", "b", "c", " a ", None, " ", "null", "NULL")], "s string")
    assert df.agg(monitors.aggregate("missing_count", F.col("s"))).first()[0] == 4.0
    empty = df.limit(0).agg(*[monitors.aggregate(m, F.col("s")).alias(m) for m in monitors.ANY_TYPE + monitors.STRING]).first().asDict()
    assert empty["null_count"] == 0 and empty["null_percent"] is None and empty["average_length"] is None


def test_kinds():
    assert [monitors.kind(t) for t in (T.StringType(), T.DecimalType(3, 1), T.DateType(), T.BooleanType(), T.ArrayType(T.StringType()), T.BinaryType())] == ["string", "numeric", "timestamp", "boolean", "other", "other"]
    assert monitors.for_column(T.ArrayType(T.StringType())) == ["null_count", "null_percent"]


def test_threshold(spark):
    data = [(NOW + timedelta(days=k), NOW + timedelta(days=k + 1), float(v)) for k, v in enumerate((100, 107, 80, 90, 120))]
    df = spark.createDataFrame(data, "bucket_start timestamp_ntz, bucket_end timestamp_ntz, metric_value double")
    assert [r["severity"] for r in threshold.volume_threshold(df).orderBy("bucket_end").collect()] == ["pass", "warn", "error", "pass", "pass"]
    assert [r["severity"] for r in threshold.volume_threshold(df, direction="spike", min_row_count=1).orderBy("bucket_end").collect()] == ["pass", "warn", "pass", "error", "error"]
    with pytest.raises(ConfigError):
        threshold.volume_threshold(df, 9, 5)


# rows, schemas, deadlines


def test_row_checks(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 5), (3, None, None), (4, "b", 9), (5, "b", 2)], "id int, s string, n int")
    assert rows(row_checks.not_null(df, "s", ["ID", "id", "nothing"])) == [(None, 2), (None, 3)]
    assert rows(row_checks.accepted_range(df, "n", 2, 5, columns=[])) == [(1,), (9,)]
    assert rows(row_checks.accepted_range(df, "n", 2, 5, inclusive=False, columns=[])) == [(1,), (2,), (5,), (9,)]
    assert rows(row_checks.unique(df, "s", ["id"])) == [("b", 4), ("b", 5), (None, 2), (None, 3)]
    assert rows(row_checks.match_regex(df, "s", "^A", "i", ["id"])) == [("b", 4), ("b", 5)]
    parent = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(row_checks.relationships(df, "s", parent, "k", ["id"])) == [("b", 4), ("b", 5)]
    with pytest.raises(ConfigError):
        row_checks.not_null(df, "missing")


def test_json_and_python_and_text_checks(spark):
    df = spark.createDataFrame([('"abc"',), ('"ab"',), ('"abcdef"',), ("{",), (None,)], "j string")
    assert rows(row_checks.json_schema(df, "j", {"type": "string", "minLength": 3, "maxLength": 5})) == [('"ab"',), ('"abcdef"',), ("{",), (None,)]
    assert row_checks.python_check(df, lambda d, s: d.where("j IS NULL")) == 1
    assert row_checks.python_check(df, lambda d, s: True) == 0 and row_checks.python_check(df, lambda d, s, n: n, n=7) == 7
    with pytest.raises(ConfigError):
        row_checks.python_check(df, lambda d, s: "x")
    out = row_checks.text_validation(df, "j", "Is it short?", lambda prompts: ["False." if "ab" in p else "true" for p in prompts])
    assert out.count() == 3


@pytest.mark.parametrize(
    "value, schema, good",
    [
        ({"a": 1}, {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}}}, True),
        ({"a": 1.5}, {"properties": {"a": {"type": "integer"}}}, False),
        ({"b": 1}, {"additionalProperties": False, "properties": {"a": {}}}, False),
        ([1, 1], {"uniqueItems": True}, False),
        ([1, "x"], {"items": {"type": ["integer", "string"]}}, True),
        (5, {"anyOf": [{"type": "string"}, {"maximum": 4}]}, False),
        (5, {"oneOf": [{"type": "number"}, {"type": "integer"}]}, False),
        (5, {"not": {"type": "string"}, "enum": [5]}, True),
        (True, {"type": "integer"}, False),
    ],
)
def test_schema_errors(value, schema, good):
    assert (not row_checks.schema_errors(value, schema)) is good


def test_schema_history(spark):
    table = TableRef("t", "s")
    old = schema_checks.declared_columns(spark.createDataFrame([], "a int, b string"), table)
    new = schema_checks.declared_columns(spark.createDataFrame([], "a bigint, c string"), table)
    first = schema_checks.snapshot(old, None, CTX)
    assert not first.where("is_new").count() and schema_checks.changes_since_last_run(old, None).count() == 0
    second = schema_checks.snapshot(new, first, RunContext(NOW + timedelta(days=1)))
    assert rows(second.where("is_new").select("column_name")) == [("c",)]
    assert rows(schema_checks.changes_since_last_run(new, first).select("column_name", "change")) == [("a", "type_changed"), ("b", "column_removed"), ("c", "column_added")]
    base = schema_checks.changes_from_baseline(new, [("S.T", "A", None), ("S.T", "x", "INT")])
    assert rows(base.select("column_name", "change")) == [("x", "column_removed")]


def test_exposures():
    exposures = [{"name": "e", "depends_on": ["m"], "referenced_columns": [{"column_name": "A", "data_type": "INT"}, {"column_name": "z"}, {"column_name": "b", "data_type": "int"}]}, {"name": "f", "depends_on": ["n"]}]
    assert [p["column_name"] for p in schema_checks.exposure_problems(exposures, "m", {"a": "int", "b": "string"})] == ["z", "b"]


@pytest.mark.parametrize("text, hour, minute", [("7", 7, 0), (7, 7, 0), ("07:00", 7, 0), ("7am", 7, 0), ("2:30 PM", 14, 30), ("12am", 0, 0), ("12pm", 12, 0)])
def test_parse_time(text, hour, minute):
    assert (sla.parse_time(text).hour, sla.parse_time(text).minute) == (hour, minute)


def test_parse_time_rejects():
    for wrong in ("25", "13pm", "x", "7:99", "0am"):
        with pytest.raises(ConfigError):
            sla.parse_time(wrong)


def test_deadlines_and_changes_of_clocks():
    assert sla.to_utc(datetime(2024, 7, 1, 7), "Europe/Berlin") == datetime(2024, 7, 1, 5)
    assert sla.to_utc(datetime(2024, 10, 27, 2, 30), "Europe/Berlin") == datetime(2024, 10, 27, 1, 30)
    assert sla.to_utc(datetime(2024, 3, 31, 2, 30), "Europe/Berlin") == datetime(2024, 3, 31, 1, 30)
    due = sla.deadline(RunContext(datetime(2024, 1, 31, 3)), "7am", "America/New_York", day_of_week="tuesday")
    assert due.day_start == datetime(2024, 1, 30, 5) and due.deadline == datetime(2024, 1, 30, 12) and due.passed and due.applies
    assert not sla.applies(datetime(2024, 1, 31), ["monday"], [30]) and sla.applies(datetime(2024, 1, 31), ["monday"], 31)


def test_sla_checks(spark):
    due = sla.deadline(RunContext(datetime(2024, 1, 31, 9)), "8", "UTC")
    df = spark.createDataFrame([(datetime(2024, 1, 30, 23),), (None,)], "ts timestamp_ntz")
    assert sla.data_freshness(df, "ts", due).first()[:2] == ("DATA_STALE", True)
    assert sla.data_freshness(df.limit(0), "ts", due).first()[:2] == ("NO_DATA", True)
    early = sla.deadline(RunContext(datetime(2024, 1, 31, 7)), "8", "UTC")
    assert sla.data_freshness(df, "ts", early).first()[1] is False
    runs = [("m", "error", 6), ("m", "success", 7), ("late", "success", 10), ("bad", "error", 7)]
    df = spark.createDataFrame([(u, s, datetime(2024, 1, 31, h)) for u, s, h in runs], "unique_id string, status string, completed_at timestamp_ntz")
    assert [sla.execution(df, m, due).first()["status"] for m in ("m", "late", "bad", "none")] == ["MET_SLA", "MISSED_SLA", "ALL_FAILED", "NOT_RUN"]


# stores and functions


def test_parquet_table(spark, tmp_path):
    t = ParquetTable(spark, str(tmp_path / "t"), "id string, v int, at timestamp_ntz")
    mk = lambda data: spark.createDataFrame(data, "id string, v int, at timestamp_ntz")
    assert t.count() == 0
    t.append(mk([("a", 1, NOW), (None, 0, NOW)]))
    t.append(mk([("b", 2, NOW)]))
    t.upsert(mk([("a", 5, NOW), ("a", 6, NOW + timedelta(1)), ("c", 7, NOW)]), "id", "at")
    assert rows(t.read().select("id", "v")) == [("a", 6), ("b", 2), ("c", 7), (None, 0)]
    t.delete("v = 2")
    t.delete_and_insert(mk([("a", 0, NOW)]), mk([("z", 9, NOW)]), "id")
    assert rows(t.read().select("id", "v")) == [("c", 7), ("z", 9)]


def test_scalars(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 31, 10, 59), datetime(2024, 3, 1, 12, 0), "DB.SC.T", None, 5)], "a timestamp_ntz, b timestamp_ntz, n string, z string, i int")
    c = F.col
    got = df.select(
        scalars.date_diff("hour", c("a"), c("b")), scalars.date_diff("day", c("a"), c("b")), scalars.date_diff("month", c("a"), c("b")), scalars.date_diff("week", c("a"), c("b")),
        scalars.name_part(c("n"), "schema"), scalars.joined([c("n"), c("z")]), scalars.contains(c("n"), "sc"), scalars.safe_cast(c("n"), "int"),
        scalars.arithmetic_min(c("i"), F.lit(None).cast("int")), scalars.arithmetic_max(c("i"), F.lit(7)), scalars.date_trunc("week", c("a")), scalars.hour_of_week(c("a")),
        scalars.full_table_name(None, F.lit("s"), F.lit("t")), scalars.is_false(F.lit(None).cast("boolean")), scalars.date_add("month", 1, c("a")), scalars.settled_stddev(F.lit(1e-12), F.lit(5.0)),
        scalars.percent(F.lit(1), F.lit(3)), scalars.not_percent(F.lit(1), F.lit(0)), scalars.cast(c("i"), "string"), scalars.to_char(c("a")),
    ).first()
    assert tuple(got) == (721, 30, 2, 4, "SC", "DB.SC.T; NULL", True, None, None, 7, datetime(2024, 1, 29), "Wednesday10", "S.T", False, datetime(2024, 2, 29, 10, 59), 0.0, 33.333, None, "5", "2024-01-31 10:59:00")
