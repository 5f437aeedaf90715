"""Stored scores over the whole history, against numbers by hand and the windows of the reference's model."""

from datetime import datetime, timedelta
from pathlib import Path
from statistics import mean, stdev

import duckdb
import pytest

from tests.conftest import rows
from tidemark.config import RunContext
from tidemark.operators import scoring
from tidemark.plans import reference

NOW = datetime(2024, 1, 31)
DATA = Path("/root/testdata/sf0.001")
COLUMNS = "id string, full_table_name string, column_name string, dimension string, dimension_value string, metric_name string, metric_value double, source_value string, bucket_start timestamp_ntz, bucket_end timestamp_ntz, bucket_duration_hours int, updated_at timestamp_ntz"

SQL = """
WITH m AS (SELECT DISTINCT id, full_table_name, column_name, dimension, dimension_value, metric_name, metric_value, source_value, bucket_start, bucket_end, bucket_duration_hours, updated_at FROM data_monitoring_metrics),
w AS (SELECT *, avg(metric_value) OVER f a, stddev_samp(metric_value) OVER f s, count(metric_value) OVER f n, first_value(bucket_end) OVER f b FROM m
  WINDOW f AS (PARTITION BY metric_name, full_table_name, column_name ORDER BY bucket_start NULLS FIRST, id NULLS FIRST, updated_at NULLS FIRST, metric_value NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT id, bucket_start, bucket_end, n, b, round(a, 4) a, round(s, 4) s, updated_at
FROM w WHERE metric_value IS NOT NULL AND a IS NOT NULL AND bucket_end >= TIMESTAMP '2024-01-24 00:00:00'"""


def metric(k, end, value, start=True):
    return (f"m{k}", "T", None, None, None, "row_count", value, None, end - timedelta(days=1) if start else None, end, 24, NOW)


def test_training_is_the_whole_history(spark):
    values = [float(10 + k % 3) for k in range(40)] + [100.0]
    data = [metric(k, NOW - timedelta(days=len(values) - 1 - k), v) for k, v in enumerate(values)]
    # A row without bucket start comes first and counts; an equal row counts once.
    data += [metric(99, NOW - timedelta(days=3), 11.0, start=False), data[5]]
    later = RunContext(NOW + timedelta(hours=15), "inv", "exec")
    out = {r["id"]: r for r in scoring.stored_scores(spark.createDataFrame(data, COLUMNS), later).collect()}
    assert set(out) == {"m99"} | {f"m{k}" for k in range(33, 41)}
    assert out["m99"]["anomaly_score"] is None and out["m99"]["training_set_size"] == 1
    trained = [11.0, *values]
    last = out["m40"]
    assert last["training_set_size"] == 42 and last["training_start"] == NOW - timedelta(days=3) and last["training_end"] == NOW
    assert last["training_avg"] == pytest.approx(mean(trained)) and last["training_stddev"] == pytest.approx(stdev(trained))
    assert last["anomaly_score"] == pytest.approx((100 - mean(trained)) / stdev(trained))
    assert [k for k, r in out.items() if r["is_anomaly"]] == ["m40"]


def test_query_equals_the_windows_of_the_model(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE VIEW data_monitoring_metrics AS SELECT * FROM '{DATA}/data_monitoring_metrics.parquet'")
    got = reference.metrics_anomaly_score(spark, str(DATA))
    assert {"anomaly_score", "is_anomaly", "latest_metric_value"} <= set(got.columns)
    got = rows(got.selectExpr("id", "bucket_start", "bucket_end", "training_set_size", "training_start", "training_avg", "training_stddev", "updated_at"))
    want = sorted(con.sql(SQL).fetchall(), key=lambda r: [(x is None, str(x)) for x in r])
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[7] == w[7]
        assert g[5] == pytest.approx(w[5], abs=1e-3) and (g[6] is None) == (w[6] is None) and (w[6] is None or g[6] == pytest.approx(w[6], abs=1e-3))
