"""Results and samples, metadata loading, views, streams and commands."""

import json
from datetime import datetime, timedelta

import pytest

from tests.conftest import rows
from tidemark import artifacts, catalogue, commands, results
from tidemark.config import CheckConfig, RunContext, TableRef, TimeBucket
from tidemark.plans import views
from tidemark.sources import store, tables
from tidemark.sources.store import MetricStore, ParquetTable
from tidemark.streaming.volume import into_store, stream_metrics, stream_once

NOW = datetime(2024, 1, 31)
CTX = RunContext(NOW, "inv", "exec")

MANIFEST = {
    "nodes": {
        "model.p.a": {
            "unique_id": "model.p.a", "resource_type": "model", "package_name": "p", "name": "a", "alias": "a", "tags": ["t2", None], "meta": {"tags": ["t1"]}, "database": "db", "schema": "s",
            "config": {"materialized": "table", "group": "g", "tags": "t3", "meta": {"k": 1}}, "depends_on": {"nodes": ["source.p.raw.x"], "macros": []}, "checksum": {"checksum": "c"},
            "columns": {"id": {"name": "id", "description": "key"}, "v": {"name": "v"}},
        },
        "model.q.b": {"unique_id": "model.q.b", "resource_type": "model", "package_name": "q", "name": "b", "meta": {"owner": "x, y"}, "config": {}},
        "test.p.t": {"unique_id": "test.p.t", "resource_type": "test", "package_name": "p", "name": "t", "column_name": "id", "attached_node": "model.p.a", "config": {"severity": "WARN"}, "test_metadata": {"name": "unique", "kwargs": {"column_name": "id", "model": "m"}}},
    },
    "sources": {"source.p.raw.x": {"unique_id": "source.p.raw.x", "resource_type": "source", "package_name": "p", "source_name": "raw", "name": "x", "identifier": "x"}},
    "exposures": {"exposure.p.e": {"unique_id": "exposure.p.e", "package_name": "p", "name": "e", "owner": {"email": "o@x"}}},
    "groups": {"group.p.g": {"unique_id": "group.p.g", "package_name": "p", "name": "g", "owner": {"email": "g@x"}}},
}


def node(**kw):
    return results.TestNode("test.p.t", kw.pop("name", "unique"), **kw)


# samples


@pytest.mark.parametrize(
    "kw, options, selected, limit",
    [
        ({}, {}, None, 5),
        ({"meta": {"test_sample_row_count": -1}}, {}, None, -1),
        ({"meta": {"disable_test_samples": True}}, {}, None, 0),
        ({"model_tags": ["PII"]}, {}, None, 5),
        ({"model_tags": ["PII"]}, {"disable_samples_on_pii_tags": True}, None, 0),
        ({"tags": ["pii"]}, {"disable_samples_on_pii_tags": True}, None, 0),
        ({"column_tags": {"c": ["pii"]}}, {"disable_samples_on_pii_tags": True}, ["d"], 5),
        ({"column_tags": {"c": ["pii"]}}, {"disable_samples_on_pii_tags": True}, ["C"], 0),
        ({"column_tags": {"c": ["pii"]}}, {"disable_samples_on_pii_tags": True}, None, 0),
        ({}, {"enable_samples_on_show_sample_rows_tags": True}, None, 0),
        ({"tags": ["Show_Sample_Rows"]}, {"enable_samples_on_show_sample_rows_tags": True}, None, 5),
        ({"column_name": "c", "column_tags": {"C": ["show_sample_rows"]}}, {"enable_samples_on_show_sample_rows_tags": True}, None, 5),
        ({"tags": ["show_sample_rows"], "model_tags": ["pii"]}, {"enable_samples_on_show_sample_rows_tags": True, "disable_samples_on_pii_tags": True}, None, 0),
    ],
)
def test_sample_limits(kw, options, selected, limit):
    assert results.sample_limit(node(**kw), selected, options) == limit


def test_run_check_and_tables(spark):
    failing = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(12)], "n int, s string")
    out = results.run_check(node(params={"sample_percent": 10}), failing)
    assert (out.status, out.failures, out.failed_rows, len(out.samples)) == ("fail", 12, 12, 5)
    clean = results.run_check(node(severity="WARN"), failing.limit(0))
    assert (clean.status, clean.failures, clean.samples, clean.failed_rows) == ("pass", 0, [], None)
    assert results.run_check(node(severity="WARN"), failing).status == "warn"
    assert results.run_check(node(), failing, "sum(n)").failed_rows == 66
    table, samples = results.result_tables(spark, [out, clean], CTX)
    assert table.count() == 2 and samples.count() == 5
    assert json.loads(samples.orderBy("row_index").first()["result_row"]) == {"n": 0, "s": "x"}
    assert views.alerts(table, "dbt_test").count() == 1


def test_types_of_checks():
    assert results.check_type(node(name="ns.volume_anomalies")) == "anomaly_detection"
    assert results.check_type(node(name="json_schema")) == "schema_change"
    assert results.check_type(node(name="volume_anomalies", own_namespace=False)) == "dbt_test"


def test_anomaly_outcomes(spark):
    shape = "full_table_name string, column_name string, metric_name string, bucket_end timestamp_ntz, anomaly_score double, is_anomalous boolean, anomaly_description string, dimension string, dimension_value string"
    data = [("T", None, "m", NOW, None, False, "?", None, None), ("T", "c", "m", NOW, 5.0, True, "bad", "d", "x"), ("T", "c", "m", NOW, 4.0, True, "bad", "d", "y"), ("T", "c", "m", NOW - timedelta(1), 0.0, False, "ok", "d", "x")]
    out = {o.column_name: o for o in results.anomaly_outcomes(node(), spark.createDataFrame(data, shape))}
    assert out[None].status == "pass" and out[None].description.startswith("Not enough")
    assert out["c"].status == "fail" and out["c"].failures == 2 and out["c"].description.startswith("2 values") and len(out["c"].samples) == 3
    assert "x, y" in out["c"].description and out["c"].samples[-1]["bucket_end"] == NOW
    few = {o.column_name: o for o in results.anomaly_outcomes(node(severity="WARN"), spark.createDataFrame(data, shape), most=1, samples=1)}
    assert few["c"].status == "warn" and len(few["c"].samples) == 1 and "among them x." in few["c"].description
    every = results.anomaly_rows(spark.createDataFrame(data, shape), list(few.values()), CTX)
    assert [r["row_index"] for r in every.orderBy("row_index").collect()] == [0, 1, 2] and results.anomaly_outcomes(node(), spark.createDataFrame([], shape)) == []


# metadata


def test_manifest_rows():
    m = artifacts.Manifest(MANIFEST, NOW)
    a, b = m.models()
    assert a["tags"] == ["t1", "t2", "t3"] and a["owner"] == ["g@x"] and a["group_name"] == "g" and a["meta"] == {"tags": ["t1"], "k": 1}
    assert b["owner"] == ["x", "y"]
    assert artifacts.Manifest(MANIFEST, NOW + timedelta(1)).models()[0]["metadata_hash"] == a["metadata_hash"] != b["metadata_hash"]
    assert [r["name"] for r in m.columns()] == ["id"] and len(m.columns("all")) == 2
    t = m.tests()[0]
    assert t["parent_model_unique_id"] == "model.p.a" and t["model_tags"] == ["t1", "t2", "t3"] and t["short_name"] == "unique" and t["test_params"] == {"column_name": "id"}
    assert [len(artifacts.Manifest(MANIFEST, NOW, "p").tables()[k]) for k in ("dbt_models", "dbt_sources", "dbt_exposures", "dbt_groups", "dbt_seeds")] == [1, 1, 1, 1, 0]


def test_run_result_rows():
    r = {"metadata": {"invocation_id": "i"}, "results": [{"unique_id": "model.p.a", "status": "success", "adapter_response": {"rows_affected": "-1", "query_id": "q"}, "timing": [{"name": "execute", "started_at": "1"}]}, {"unique_id": "gone", "adapter_response": {"rows_affected": "7"}}]}
    a, b = artifacts.run_result_rows(r, MANIFEST, NOW)
    assert a["model_execution_id"] == "i.model.p.a" and a["rows_affected"] is None and a["execute_started_at"] == "1" and a["materialization"] == "table" and b["rows_affected"] == 7
    f = artifacts.source_freshness_rows({"metadata": {"invocation_id": "i"}, "results": [{"unique_id": "s", "status": "runtime error", "error": "x", "max_loaded_at": "1"}]}, NOW)
    assert f[0]["max_loaded_at"] is None if "max_loaded_at" in f[0] else True
    row = artifacts.invocation_row(r, {"GITHUB_ACTIONS": "1", "GITHUB_RUN_ID": "5", "GITHUB_SERVER_URL": "https://h", "GITHUB_REPOSITORY": "o/r"}, {}, NOW)
    assert row["orchestrator"] == "github_actions" and row["job_run_url"] == "https://h/o/r/actions/runs/5"


def test_load_by_difference(spark, tmp_path):
    schema = artifacts.SCHEMAS["dbt_models"]
    store = ParquetTable(spark, str(tmp_path / "m"), schema)
    both = artifacts.Manifest(MANIFEST, NOW).models()
    assert artifacts.load(store, both, schema) == "updated"
    assert artifacts.load(store, artifacts.Manifest(MANIFEST, NOW + timedelta(1)).models(), schema) == "unchanged"
    assert artifacts.load(store, both[:1], schema) == "updated" and store.count() == 1
    assert artifacts.load(store, both, schema, method="append") == "appended" and store.count() == 3
    assert artifacts.load(store, both, schema, method="replace") == "replaced" and store.count() == 2
    assert artifacts.hashes({"dbt_models": store.read()}).count() == 2


# sources, streams, commands


def test_tables(spark, tmp_path):
    df = tables.constant(spark, [{"a": [1, 2], "t": "2024-01-01T01:00:00+01:00", "n": "3", "x": 1}, {"b": True}], "a string, b boolean, t timestamp_ntz, n int")
    assert rows(df) == [("[1, 2]", None, datetime(2024, 1, 1), 3), (None, True, None, None)]
    data = spark.createDataFrame([("a", 1, NOW), ("a", 2, NOW + timedelta(1)), ("b", 3, NOW - timedelta(9))], "id string, v int, at timestamp_ntz")
    tables.export_csv(data, str(tmp_path / "csv"), "at", since=NOW, dedup_by="id", exclude=("at",))
    back = tables.csv_seed(spark, str(tmp_path / "csv"), "id string, v int")
    assert rows(back) == [("a", 2)] and tables.empty(spark, "a int").count() == 0
    data.write.parquet(str(tmp_path / "p"))
    assert tables.relation(spark, str(tmp_path / "p"), "v > 1").count() == 2
    assert tables.without_duplicate_rows(data.unionByName(data)).count() == 3


def test_stream_equals_batch_and_upserts(spark, tmp_path):
    data = [(NOW - timedelta(hours=h), "a" if h % 2 else None, float(h)) for h in range(1, 72)]
    spark.createDataFrame(data, "ts timestamp_ntz, k string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, k string, v double").parquet(str(tmp_path / "in"))
    config = CheckConfig(TableRef("t"), timestamp_column="ts", dimensions=("k",))
    store = MetricStore(spark, str(tmp_path / "store"))
    into_store(stream_metrics(stream, config, CTX, {"v": ["max"]}), store, CTX, str(tmp_path / "c1"), "update").awaitTermination()
    got = {(r["metric_name"], r["bucket_end"], r["dimension_value"]): r["metric_value"] for r in store.read().collect()}
    assert got["row_count", NOW, "a"] == 12 and got["max", NOW, "NULL"] == 24 and got["row_count", NOW, "NULL"] == 12
    with pytest.raises(ValueError):
        stream_metrics(stream, CheckConfig(TableRef("t"), timestamp_column="ts", time_bucket=TimeBucket("month")), CTX)


def test_stream_once(spark, tmp_path):
    spark.createDataFrame([("a", NOW), ("a", NOW), ("b", NOW)], "id string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, at timestamp").parquet(str(tmp_path / "in"))
    seen = []
    stream_once(stream, "id", "at", "1 hour", lambda df, n: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_commands(spark):
    m = artifacts.Manifest(MANIFEST, NOW)
    assert ("source.p.raw.x", "owner") in commands.configuration_problems(m) and ("model.q.b", "meta key k") in commands.configuration_problems(m, meta_keys=["k"])
    text = commands.baseline_test(spark.createDataFrame([], "A int, b string"), "t", enforce_types=True, lower=True)
    assert "- name: a" in text and "data_type: string" in text and "enforce_types: true" in text
    df = spark.createDataFrame([('{"a": 1, "b": ["x"]}',), ('{"a": 2.5, "c": true}',), (None,)], "j string")
    assert commands.json_schema_of(df, "j")["properties"]["a"]["type"] == "number"
    assert catalogue.known("unique") == ("uniqueness", "sum(n_records)") and catalogue.known("odd") is None and catalogue.known("recency", "dbt_utils") == ("freshness", None)
    assert catalogue.describe("not_null") == "Not null."


def test_views_without_matches(spark):
    runs = tables.empty(spark, artifacts.SCHEMAS["dbt_run_results"])
    models = tables.empty(spark, artifacts.SCHEMAS["dbt_models"])
    assert views.model_run_results(runs, models).count() == 0
    sources = tables.empty(spark, artifacts.SCHEMAS["dbt_sources"])
    fresh = tables.constant(spark, [{"unique_id": "s", "status": "error"}], artifacts.SCHEMAS["dbt_source_freshness_results"])
    assert views.alerts_source_freshness(fresh, sources).count() == 0
    assert views.alerts_source_freshness(fresh, tables.constant(spark, [{"unique_id": "s"}], artifacts.SCHEMAS["dbt_sources"])).count() == 1


STORED = "id string, v int, updated_at timestamp_ntz, day string"


def stored(spark, data):
    return spark.createDataFrame([(i, v, datetime(2024, 1, 1, v), d) for i, v, d in data], STORED)


def test_upsert_writes_touched_partitions_only(spark, tmp_path):
    t = ParquetTable(spark, str(tmp_path / "t"), STORED, ("day",))
    t.upsert(stored(spark, [("a", 1, "x"), ("b", 1, "y"), ("c", 1, None), ("d", 1, "z:1")]), "id", "updated_at")
    before = set(t._current()[1]["folders"])
    old = t.read()
    t.upsert(stored(spark, [("b", 2, "y"), ("b", 3, "y"), ("e", 1, "w")]), "id", "updated_at")
    after = set(t._current()[1]["folders"])
    assert {f.split("/")[0] for f in before & after} == {"day=x", "day=__HIVE_DEFAULT_PARTITION__", "day=z%3A1"}
    assert rows(t.read().select("id", "v", "day")) == rows(stored(spark, [("a", 1, "x"), ("b", 3, "y"), ("c", 1, None), ("d", 1, "z:1"), ("e", 1, "w")]).select("id", "v", "day"))
    # Whoever listed the table before still reads it whole.
    assert old.count() == 4
    t.upsert(stored(spark, [("a", 5, "y"), ("c", 5, "x")]), "id", "updated_at")
    assert rows(t.read().select("id", "v", "day")) == rows(stored(spark, [("a", 5, "y"), ("b", 3, "y"), ("c", 5, "x"), ("d", 1, "z:1"), ("e", 1, "w")]).select("id", "v", "day"))
    t.delete("v = 5")
    t.delete_and_insert(stored(spark, [("d", 0, None)]), stored(spark, [("n", 1, "x")]), "id")
    assert rows(t.read().select("id", "day")) == [("b", "y"), ("e", "w"), ("n", "x")]


def test_appends_once_by_token_and_writers_that_meet(spark, tmp_path):
    t = ParquetTable(spark, str(tmp_path / "t"), STORED)
    t.append(stored(spark, [("a", 1, "x")]), "batch 1")
    t.append(stored(spark, [("a", 1, "x")]), "batch 1")
    assert t.count() == 1
    number, now = t._current()
    t.append(stored(spark, [("b", 1, "x")]))
    with pytest.raises(store.Conflict):
        t._publish(number, now["folders"], [])
    assert t.count() == 2
    t.delete_and_insert(None, stored(spark, [(None, 1, "x")]), "id")
    t.delete_and_insert(stored(spark, []), None, "id")
    assert rows(t.read().select("id")) == [("a",), ("b",)]
