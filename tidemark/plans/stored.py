"""Queries over stored history, stores, results, sources and scalar functions, and the same in SQL."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import artifacts, commands, results
from tidemark.checks import Monitor
from tidemark.config import RunContext, TableRef
from tidemark.functions import scalars
from tidemark.functions.text_time import clean_id, utc_instant
from tidemark.operators import metrics, row_checks, schema_checks, scoring, sla
from tidemark.plans import reference, views
from tidemark.session import checkpoint_dir, table
from tidemark.sources import tables
from tidemark.sources.store import METRICS_SCHEMA, MetricStore, ParquetTable

NOW, CTX = reference.NOW, reference.CTX
EARLIER = RunContext(datetime(2024, 1, 25), "earlier", "earlier")
EVENTS = TableRef("events", "main")
SPLIT = datetime(2024, 1, 15)


def _home(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _scores(df: DataFrame, *more: str, digits: int = 6) -> DataFrame:
    return df.select(*more, "bucket_end", F.round("metric_value", 3).alias("metric_value"), F.round("anomaly_score", digits).alias("anomaly_score"), "is_anomalous")


# Runs that build on stored metrics


def incremental_volume(spark: SparkSession, d: str) -> DataFrame:
    """Two runs six days apart: the second computes the missing and recent buckets and reads the others from history."""
    store, events = MetricStore(spark, _home(spark)), table(spark, d, "events")
    first = Monitor(events, EVENTS, EARLIER, store)
    first.volume_anomalies(timestamp_column="ts")
    first.finish()
    return _scores(Monitor(events, EVENTS, CTX, store).volume_anomalies(timestamp_column="ts"))


def incremental_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """As incremental_volume, by event type; values that only history knows get zeros."""
    store, events = MetricStore(spark, _home(spark)), table(spark, d, "events")
    first = Monitor(events, EVENTS, EARLIER, store)
    first.dimension_anomalies(["event_type"], timestamp_column="ts")
    first.finish()
    second = Monitor(events, EVENTS, CTX, store)
    return _scores(second.dimension_anomalies(["event_type"], timestamp_column="ts", anomaly_sensitivity=1.5, backfill_days=14), "dimension_value")


def freshness_anomalies(spark: SparkSession, d: str) -> DataFrame:
    m = Monitor(table(spark, d, "events"), EVENTS, CTX)
    return _scores(m.freshness_anomalies(timestamp_column="ts", anomaly_sensitivity=1, backfill_days=14), digits=3)


def event_freshness_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """How old orders are when they ship, per week, scored."""
    rows = table(spark, d, "lineitem").select("l_shipdate", (F.col("l_shipdate") - F.expr("make_interval(0, 0, 0, CAST(pmod(l_partkey, 9) AS int))")).alias("happened"))
    m = Monitor(rows, TableRef("lineitem", "main"), RunContext(datetime(2001, 8, 1)))
    out = m.event_freshness_anomalies("happened", "l_shipdate", time_bucket={"period": "week", "count": 1}, days_back=90, backfill_days=90, anomaly_sensitivity=1)
    return _scores(out, digits=3)


def excluded_results(spark: SparkSession, d: str) -> DataFrame:
    """Scores of small days are left out of the result, not out of training."""
    m = Monitor(table(spark, d, "events"), EVENTS, CTX)
    out = m.volume_anomalies(timestamp_column="ts", exclude_final_results="average < 0 OR day(bucket_end) % 2 = 0")
    return _scores(out)


def anomalous_dimension_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows by event type of the types that were anomalous."""
    events = table(spark, d, "events")
    found = Monitor(events, EVENTS, CTX).dimension_anomalies(["event_type"], timestamp_column="ts", anomaly_sensitivity=1.6, backfill_days=14)
    return scoring.anomalous_dimension_rows(events, found, F.col("event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


# Stores


def _metric_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stored metrics with an id, collected before 2024-01-15 and since."""
    rows = table(spark, d, "data_monitoring_metrics").where("id IS NOT NULL AND created_at IS NOT NULL").withColumn("bucket_date", F.to_date("bucket_end"))
    split = F.lit(SPLIT).cast("timestamp_ntz")
    return rows.where(F.col("created_at") < split), rows.where(F.col("created_at") >= split)


def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    early, late = _metric_rows(spark, d)
    store = MetricStore(spark, _home(spark))
    store.upsert(early, "id", "updated_at")
    store.upsert(late, "id", "updated_at")
    return store.read().select("id", "updated_at")


def store_delete_and_insert(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the later batch go, then all its rows come."""
    early, late = _metric_rows(spark, d)
    store = MetricStore(spark, _home(spark))
    store.append(early)
    store.delete_and_insert(late.select("id"), late, "id")
    return store.read().groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def store_delete_and_replace(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a value are deleted, then the rows of whole days replace the table."""
    early, late = _metric_rows(spark, d)
    store = ParquetTable(spark, _home(spark), METRICS_SCHEMA, ("bucket_date",))
    store.replace(late)
    store.append(early, "batch")
    store.append(early, "batch")
    store.delete("metric_value IS NULL OR bucket_duration_hours = 1")
    store.replace(store.read().where("bucket_duration_hours = 24"))
    return store.read().groupBy("metric_type").agg(F.count(F.lit(1)).alias("n"))


# Sources


def csv_seed(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV and read back as a seed."""
    path = _home(spark)
    tables.export_csv(table(spark, d, "nation"), path)
    return tables.csv_seed(spark, path, "n_nationkey int, n_name string, n_regionkey int")


def csv_export(spark: SparkSession, d: str) -> DataFrame:
    """Stored metrics of a week, one per id, without two columns."""
    path = _home(spark)
    rows = table(spark, d, "data_monitoring_metrics").where("id IS NOT NULL").select("id", "updated_at", "metric_name", "dimension")
    tables.export_csv(rows, path, "updated_at", datetime(2024, 1, 8), datetime(2024, 1, 15), "id", ("metric_name", "dimension"))
    return tables.csv_seed(spark, path, "id string, updated_at timestamp_ntz")


def relation_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.relation(spark, f"{d}/customer.parquet", "c_acctbal < 0").select("c_custkey", "c_acctbal")


def constant_rows(spark: SparkSession, d: str) -> DataFrame:
    """Python values rendered by the type of their column; an empty table takes part."""
    shape = "a int, b string, c timestamp_ntz, d double, e boolean"
    rows = [{"a": "7", "b": ["x", 1], "c": "2024-01-02T03:04:05+02:00", "d": 1, "e": "yes"}, {"a": 0, "b": True, "e": 1, "unknown": 3}, {"a": 2, "b": {"k": None}, "d": "2.5", "e": False}]
    return tables.constant(spark, rows, shape).unionByName(tables.empty(spark, shape))


def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "schema_columns_snapshot").select("full_table_name", "column_name", "data_type")
    return tables.without_duplicate_rows(rows).groupBy("data_type").agg(F.count(F.lit(1)).alias("n"))


def column_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the catalog's views of two tables."""
    for name in ("nation", "region"):
        table(spark, d, name).createOrReplaceTempView(f"tidemark_{name}")
    found = tables.columns_of(spark).where("full_table_name LIKE '%TIDEMARK\\_%'")
    return found.select(F.regexp_extract("full_table_name", "TIDEMARK_(.*)", 1).alias("table_name"), "column_name", "data_type")


# Schemas


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """(full_table_name, column_name, data_type, day) of each table and day, one type per column."""
    rows = table(spark, d, "schema_columns_snapshot").where("full_table_name IS NOT NULL AND column_name IS NOT NULL")
    kind = F.upper(F.regexp_replace("data_type", r"\s", ""))
    return rows.groupBy(F.upper("full_table_name").alias("full_table_name"), F.lower("column_name").alias("column_name"), F.to_date("detected_at").alias("day")).agg(F.max(kind).alias("data_type"))


def schema_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Which columns of the latest snapshots are new against all that was stored before them."""
    rows = _snapshots(spark, d)
    last = rows.groupBy("full_table_name").agg(F.max("day").alias("last"))
    dated = rows.join(last, "full_table_name")
    before = dated.where("day < last").withColumn("full_column_name", F.concat_ws(".", "full_table_name", "column_name"))
    out = schema_checks.snapshot(dated.where("day = last").select("full_table_name", "column_name", "data_type"), before, CTX)
    return out.select("full_column_name", "is_new", "detected_at")


def schema_states(spark: SparkSession, d: str) -> DataFrame:
    """Every stored column state once, as detected last."""
    rows = table(spark, d, "schema_columns_snapshot").where("column_state_id IS NOT NULL")
    return schema_checks.latest_states(rows).select("column_state_id", "detected_at")


def exposure_validity(spark: SparkSession, d: str) -> DataFrame:
    """What exposures ask of the part table that it does not have."""
    asked = [
        {"name": "prices", "depends_on": ["part"], "referenced_columns": [{"column_name": "P_RETAILPRICE", "data_type": "double"}, {"column_name": "p_discount"}]},
        {"name": "sizes", "depends_on": ["part", "orders"], "referenced_columns": [{"column_name": "p_size", "data_type": "string"}, {"column_name": "o_x", "node": "orders"}]},
        {"name": "other", "depends_on": ["orders"], "referenced_columns": [{"column_name": "nothing"}]},
    ]
    found = schema_checks.exposure_problems(asked, "part", dict(table(spark, d, "part").dtypes))
    return tables.constant(spark, found, "exposure string, column_name string, error string")


# Checks and their results


def text_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a judge of texts rejects; here a rule takes the place of a model."""
    judge = lambda prompts: ["False." if "furniture" in p.lower() else "true" for p in prompts]
    return row_checks.text_validation(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "Is this a segment?", judge, "c_acctbal > 0")


def unstructured_validation(spark: SparkSession, d: str) -> DataFrame:
    judge = lambda prompts: ["false" if "{{" in p else "true" for p in prompts]
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return row_checks.unstructured_validation(rows, "text", "It has no templates.", judge).select("doc_id")


def _node(name: str, column: str | None = None, severity: str = "ERROR", **more) -> results.TestNode:
    return results.TestNode(unique_id=f"test.{name}", name=name, model_unique_id="model.x", column_name=column, severity=severity, **more)


def _check_results(spark: SparkSession, d: str) -> list[results.Outcome]:
    t = lambda name: table(spark, d, name)
    return [
        results.run_check(_node("documents_have_a_language", "lang"), row_checks.not_null(t("documents"), "lang", ["doc_id"])),
        results.run_check(_node("parts_are_of_usual_size", "p_size", "WARN"), row_checks.accepted_range(t("part"), "p_size", 5, 45, columns=["p_partkey"])),
        results.run_check(_node("customers_have_a_key", "c_custkey"), row_checks.not_null(t("customer"), "c_custkey", ["c_name"])),
        results.run_check(_node("results_name_an_invocation", "invocation_id"), _orphans(spark, d), "count(distinct invocation_id)"),
    ]


def check_results(spark: SparkSession, d: str) -> DataFrame:
    """Result rows of four checks over whole tables, with the number of their samples."""
    found, samples = results.result_tables(spark, _check_results(spark, d), CTX)
    kept = samples.groupBy("test_results_id").agg(F.count(F.lit(1)).alias("samples"))
    out = found.join(kept, found["id"] == kept["test_results_id"], "left")
    return out.select("test_name", "column_name", "severity", "status", "failures", F.coalesce("failed_row_count", F.lit(0)).alias("failed_row_count"), F.coalesce("samples", F.lit(0)).alias("samples"))


def alerts_dbt_tests(spark: SparkSession, d: str) -> DataFrame:
    """The checks of check_results() that are no passes."""
    found, _ = results.result_tables(spark, _check_results(spark, d), CTX)
    return views.alerts(found, "dbt_test").select("test_name", "alert_type", "status", "detected_at")


def _anomaly_results(spark: SparkSession, d: str) -> tuple[list[results.Outcome], DataFrame]:
    scores = Monitor(table(spark, d, "events"), EVENTS, CTX).dimension_anomalies(["event_type"], timestamp_column="ts", anomaly_sensitivity=1.5, backfill_days=14)
    node = _node("dimension_anomalies", own_namespace=True)
    return results.anomaly_outcomes(node, scores), scores


def anomaly_results(spark: SparkSession, d: str) -> DataFrame:
    """The outcome of a dimension check over the events, with the number of all its scored rows."""
    outcomes, scores = _anomaly_results(spark, d)
    found, _ = results.result_tables(spark, outcomes, CTX)
    every = results.anomaly_rows(scores, outcomes, CTX).groupBy("test_results_id").agg(F.count(F.lit(1)).alias("scored_rows"))
    return found.join(every, found["id"] == every["test_results_id"]).select("test_sub_type", "status", "failures", "scored_rows")


def alerts_anomaly_detection(spark: SparkSession, d: str) -> DataFrame:
    found, _ = results.result_tables(spark, _anomaly_results(spark, d)[0], CTX)
    return views.alerts(found, "anomaly_detection").select("test_name", "sub_type", "status", "detected_at")


def alerts_schema_changes(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of the tables whose latest snapshot differs from the one before."""
    changed = reference.schema_changes_history(spark, d).groupBy("full_table_name").agg(F.count(F.lit(1)).alias("n"))
    found = changed.select(
        F.col("full_table_name").alias("id"), F.lit("schema_change").alias("test_type"), F.lit("fail").alias("status"), F.lit(NOW).cast("timestamp_ntz").alias("detected_at"), F.col("full_table_name").alias("table_name"), F.col("n").alias("failures")
    )
    shaped = tables.empty(spark, results.RESULTS_SCHEMA).unionByName(found, allowMissingColumns=True)
    return views.alerts(shaped, "schema_change").select("alert_id", "table_name", "status", "detected_at")


def last_schema_change(spark: SparkSession, d: str) -> DataFrame:
    """When a change of a schema was last detected."""
    from tidemark.plans import problems

    found = problems.p7_found(spark, d).select(F.lit("schema_change").alias("test_type"), F.col("detected_on").cast("timestamp_ntz").alias("detected_at"))
    return tables.constant(spark, [{"at": schema_checks.last_change_time(found)}], "at timestamp_ntz")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "dbt_run_results")
    return row_checks.relationships(runs, "invocation_id", table(spark, d, "dbt_invocations"), "invocation_id", ["model_execution_id"])


def relationships_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Results whose invocation is not there, as delivered."""
    return _orphans(spark, d)


# Runs, sources and deadlines


def _nodes_of(runs: DataFrame, kind: str) -> DataFrame:
    """Node rows of a kind from the runs that name it, as no table of theirs is given."""
    mine = runs.where(F.col("unique_id").startswith(f"{kind}.")).select("unique_id").distinct()
    return mine.select("unique_id", *[(F.split("unique_id", r"\.")[1] if c == "package_name" else F.lit(None).cast("string")).alias(c) for c in views.NODE_COLUMNS])


def _by_package(out: DataFrame) -> DataFrame:
    return out.groupBy("package_name", "status", "materialization").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("execution_time"), 3).alias("run_seconds"))


def view_seed_run_results(spark: SparkSession, d: str) -> DataFrame:
    runs = views._runs(spark, d)
    return _by_package(views.node_run_results(runs, _nodes_of(runs, "seed")))


def view_snapshot_run_results(spark: SparkSession, d: str) -> DataFrame:
    runs = views._runs(spark, d)
    nodes = _nodes_of(runs, "snapshot").withColumn("materialization", F.lit("snapshot"))
    return _by_package(views.node_run_results(runs.withColumn("materialization", F.lit(None).cast("string")), nodes))


def latest_full_refresh(spark: SparkSession, d: str) -> DataFrame:
    return views.latest_full_refresh(views._runs(spark, d)).withColumnRenamed("generated_at", "last_full_refresh")


def alerts_source_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Alerts from the greatest stored freshness of each monitored table, over 12 hours a warning, over a day an error."""
    stored = table(spark, d, "data_monitoring_metrics").where("metric_type = 'freshness' AND metric_value IS NOT NULL")
    worst = stored.groupBy(F.col("full_table_name").alias("unique_id")).agg(F.max("metric_value").alias("age"))
    status = F.when(F.col("age") > 86400, "error").when(F.col("age") > 43200, "warn").otherwise("pass")
    found = worst.select("unique_id", status.alias("status"), F.concat(F.lit("run."), "unique_id").alias("source_freshness_execution_id"))
    part = lambda n: scalars.name_part(F.col("unique_id"), n)
    named = {"database_name": part("database"), "schema_name": part("schema"), "identifier": part("table")}
    about = worst.select("unique_id", *[named.get(c, F.lit(None).cast("string")).alias(c) for c in ("database_name", "schema_name", "source_name", "identifier", "tags", "meta", "owner", "package_name", "path")])
    return views.alerts_source_freshness(found, about).select("alert_id", "status", "database_name", "schema_name", "identifier")


def sla_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Deadlines of a day in several notations and zones, those days on which the clock changes among them."""
    asked = [("7", "UTC", 31, 1), ("07:00", "Europe/Berlin", 31, 3), ("7am", "Europe/Berlin", 30, 3), ("2:30pm", "America/New_York", 10, 3), ("12am", "Asia/Kolkata", 1, 7)]
    rows = []
    for text, zone, day, month in asked:
        due = sla.deadline(RunContext(datetime(2024, month, day, 12)), text, zone)
        rows.append({"asked": text, "zone": zone, "time": sla.format_time(sla.parse_time(text)), "due": due.deadline, "applies": sla.applies(datetime(2024, month, day), day_of_week=["sunday"], day_of_month=[1])})
    return tables.constant(spark, rows, "asked string, zone string, time string, due timestamp_ntz, applies boolean")


# Loading what a project run leaves behind: artifacts made from the nations, as no files of theirs are given


def _nations(spark: SparkSession, d: str) -> list:
    return table(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows


def _manifest(spark: SparkSession, d: str, name: str = "name") -> dict:
    nodes = {}
    for r in _nations(spark, d):
        kind = ("model", "seed", "snapshot")[r["n_nationkey"] % 3]
        unique = f"{kind}.geo.{r['n_nationkey']}"
        nodes[unique] = {
            "unique_id": unique, "resource_type": kind, "package_name": "geo" if r["n_nationkey"] < 20 else "other", name: r["n_name"], "schema": f"region_{r['n_regionkey']}",
            "tags": ["b", "a", "b", None], "meta": {"owner": f"{r['n_name']}, team"}, "config": {"materialized": "table", "tags": "c", "group": "g"}, "depends_on": {"nodes": ["y", "x", "x"]},
        }
    return {"nodes": nodes}


def _run(spark: SparkSession, d: str) -> dict:
    rows = []
    for r in _nations(spark, d):
        k = r["n_nationkey"]
        timing = [{"name": "execute", "started_at": f"2024-01-31T00:00:{k:02d}", "completed_at": f"2024-01-31T00:01:{k:02d}"}]
        answer = {"rows_affected": "-1" if k % 4 == 0 else str(k), "query_id": f"q{k}"}
        rows.append({"unique_id": f"{('model', 'seed', 'snapshot')[k % 3]}.geo.{k}", "status": "success" if k % 5 else "error", "execution_time": float(k), "adapter_response": answer, "timing": timing})
    return {"metadata": {"invocation_id": "run", "dbt_version": "1.8.1", "generated_at": "2024-01-31T00:00:00Z"}, "args": {"which": "build", "threads": 4, "select": ["b", "a"]}, "results": rows}


def load_models(spark: SparkSession, d: str) -> DataFrame:
    """The models of a package loaded, then loaded again with one renamed: only what differs is written."""
    schema = artifacts.SCHEMAS["dbt_models"]
    store = ParquetTable(spark, _home(spark), schema)
    said = []
    manifest = _manifest(spark, d)
    for change in (False, False, True):
        if change:
            manifest["nodes"]["model.geo.0"]["name"] = "renamed"
        rows = artifacts.Manifest(manifest, NOW + timedelta(days=len(said)), "geo").models()
        said.append(artifacts.load(store, rows, schema))
    out = store.read().select("unique_id", "name", "schema_name", "materialization", "tags", "owner", "depends_on_nodes", "generated_at")
    return out.withColumn("loads", F.lit(" ".join(said)))


def load_run_results(spark: SparkSession, d: str) -> DataFrame:
    rows = artifacts.run_result_rows(_run(spark, d), _manifest(spark, d), NOW, True)
    out = tables.constant(spark, rows, artifacts.SCHEMAS["dbt_run_results"])
    keep = ["model_execution_id", "name", "status", "resource_type", "execution_time", "execute_started_at", "query_id", "materialization", "group_name", "full_refresh"]
    return out.select(*keep, F.coalesce("rows_affected", F.lit(-1)).alias("rows_affected"))


def load_source_freshness(spark: SparkSession, d: str) -> DataFrame:
    found = [
        {"unique_id": r["n_name"], "status": ("pass", "warn", "runtime error")[r["n_nationkey"] % 3], "max_loaded_at": "2024-01-30", "max_loaded_at_time_ago_in_s": 60.0 * r["n_nationkey"], "error": None}
        for r in _nations(spark, d)
    ]
    rows = artifacts.source_freshness_rows({"metadata": {"invocation_id": "run"}, "results": found}, NOW)
    out = tables.constant(spark, rows, artifacts.SCHEMAS["dbt_source_freshness_results"])
    return out.select("source_freshness_execution_id", "status", "max_loaded_at", F.coalesce("max_loaded_at_time_ago_in_s", F.lit(-1.0)).alias("age"))


def load_invocation(spark: SparkSession, d: str) -> DataFrame:
    where = {"GITHUB_ACTIONS": "1", "GITHUB_RUN_ID": "5", "GITHUB_SERVER_URL": "https://h", "GITHUB_REPOSITORY": "o/r", "GITHUB_SHA": "abc"}
    row = artifacts.invocation_row(_run(spark, d), where, {"env": "prod", "job_name": "nightly"}, NOW)
    shape = ", ".join(f"{c} string" for c in ("invocation_id", "command", "dbt_version", "threads", "selected", "orchestrator", "job_name", "job_run_id", "job_run_url", "env", "git_sha"))
    return tables.constant(spark, [row], shape)


def declaration_problems(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a project that lack what it requires."""
    found = commands.configuration_problems(artifacts.Manifest(_manifest(spark, d), NOW, "geo"), owners=True, description=True, meta_keys=["owner", "tier"])
    return tables.constant(spark, [{"unique_id": u, "missing": m} for u, m in found], "unique_id string, missing string")


def generated_tests(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a generated baseline of the region table and of a JSON schema of the events' properties."""
    text = commands.baseline_test(table(spark, d, "region"), "region", fail_on_added=True) + commands.json_schema_test(table(spark, d, "events"), "events", "props")
    return tables.constant(spark, [{"line": i, "content": c} for i, c in enumerate(text.splitlines())], "line int, content string")


def private_samples(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of a failed check may be kept, by its tags and settings."""
    private = {"disable_samples_on_pii_tags": True, "pii_tags": ["pii"]}
    shown = {"enable_samples_on_show_sample_rows_tags": True, "show_sample_rows_tags": ["show"]}
    cases = {
        "plain": (_node("a"), {}),
        "switched off": (_node("a", meta={"disable_test_samples": True}), {}),
        "own number": (_node("a", meta={"test_sample_row_count": 17}), {}),
        "private model": (_node("a", model_tags=["PII"]), private),
        "private column": (_node("a", "c", column_tags={"C": ["pii"]}), private),
        "other column": (_node("a", "c", column_tags={"x": ["pii"]}), private),
        "not shown": (_node("a"), shown),
        "shown": (_node("a", tags=["show"]), shown),
    }
    rows = [{"what": k, "rows": results.sample_limit(n, ["c"], o)} for k, (n, o) in cases.items()]
    return tables.constant(spark, rows, "what string, rows int")


# More of the checks


def table_metrics_of_two_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Row count and freshness of the same buckets in one result."""
    m = Monitor(table(spark, d, "events"), EVENTS, CTX)
    return _scores(m.table_anomalies(["row_count", "freshness"], timestamp_column="ts"), "metric_name", digits=3)


def anomaly_descriptions(spark: SparkSession, d: str) -> DataFrame:
    m = Monitor(table(spark, d, "events"), EVENTS, CTX)
    return m.volume_anomalies(timestamp_column="ts").select("bucket_end", "anomaly_description")


def metrics_too_large(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the greatest integer and beyond are not kept."""
    rows = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderkey") * 100000).alias("big"))
    config = reference.CheckConfig(TableRef("orders", "main"), dimensions=("o_orderpriority",))
    out = metrics.column_metrics(rows, config, CTX, {"big": ["min", "max", "average", "sum"]})
    return out.select("metric_name", "dimension_value", F.round("metric_value", 3).alias("metric_value"))


def no_metrics(spark: SparkSession, d: str) -> DataFrame:
    start, end = datetime(2024, 1, 30), NOW
    return metrics.table_metrics(table(spark, d, "events"), reference.EVENTS, CTX, [], start, end).select("metric_name", "bucket_end")


def schema_first_run(spark: SparkSession, d: str) -> DataFrame:
    """A table that was never seen has no changes; against its own earlier list it has."""
    now = schema_checks.declared_columns(table(spark, d, "nation"), TableRef("nation", "main"))
    then = schema_checks.snapshot(now.where("column_name <> 'n_name'"), None, EARLIER)
    first = schema_checks.changes_since_last_run(now, None).withColumn("run", F.lit(1))
    return first.unionByName(schema_checks.changes_since_last_run(now, then).withColumn("run", F.lit(2))).select("run", "column_name", "change")


# Scalar functions


def scalar_times(spark: SparkSession, d: str) -> DataFrame:
    s, at = scalars, F.col("o_orderdate")
    end = s.date_add("hour", F.pmod("o_orderkey", F.lit(5000)).cast("int"), at)
    return table(spark, d, "orders").select(
        "o_orderkey",
        *[s.date_trunc(u, end).alias(f"trunc_{u}") for u in ("hour", "day", "week", "month")],
        *[s.date_add(u, n, at).alias(f"add_{u}") for u, n in (("day", 31), ("month", 1), ("minute", -90))],
        *[s.date_diff(u, at, end).cast("bigint").alias(f"diff_{u}") for u in ("day", "week", "month", "quarter", "year", "hour", "minute", "second")],
        s.day_of_week(end).alias("day_of_week"),
        s.hour_of_day(end).cast("bigint").alias("hour_of_day"),
        s.hour_of_week(end).alias("hour_of_week"),
        s.to_char(end).alias("to_char"),
    )


def scalar_values(spark: SparkSession, d: str) -> DataFrame:
    s = scalars
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    odd = F.when(F.col("o_orderkey") % 2 == 1, F.col("o_custkey"))
    return table(spark, d, "orders").select(
        "o_orderkey",
        s.cast(price, "int").alias("as_int"),
        s.cast(F.col("o_orderkey"), "string").alias("as_string"),
        s.cast(F.lit("2024-01-02 03:04:05"), "timestamp").alias("as_timestamp"),
        s.cast(F.lit("2024-01-02"), "date").cast("string").alias("as_date"),
        s.safe_cast(F.concat(status, F.lit("1")), "int").isNull().alias("no_int"),
        s.safe_cast(F.concat(F.lit("1"), F.col("o_custkey").cast("string")), "float").alias("as_float"),
        s.null_of("string").alias("no_text"),
        s.text_literal(12).alias("twelve"),
        s.contains(F.col("o_orderpriority"), "urg").alias("has_urg"),
        s.contains(F.col("o_orderpriority"), "urg", True).alias("has_urg_exactly"),
        s.joined([status, odd]).alias("joined"),
        s.full_table_name(F.lit("db"), F.lit("s"), status).alias("table_name"),
        s.full_column_name(F.lit("s.t"), F.lit("c")).alias("column_name"),
        s.name_part(F.lit("DB.S.T"), "schema").alias("schema_part"),
        s.name_part(F.lit("S.T"), "database").alias("no_database"),
        s.percent(F.col("o_custkey"), F.col("o_orderkey")).alias("percent"),
        s.not_percent(F.col("o_custkey"), F.col("o_orderkey")).alias("not_percent"),
        F.coalesce(s.arithmetic_min(odd, F.col("o_orderkey")), F.lit(-1)).alias("lesser"),
        F.coalesce(s.arithmetic_max(odd, F.col("o_orderkey")), F.lit(-1)).alias("greater"),
        s.is_true(odd > 500).alias("is_true"),
        s.is_false(odd > 500).alias("is_false"),
        s.settled_stddev(price * 1e-12, price).alias("settled"),
        s.surrogate_key(status, odd).alias("surrogate_key"),
    )


_SCORED = """
WITH c AS ({counts}),
w AS (SELECT *, avg(metric_value) OVER f a, stddev_samp(metric_value) OVER f s, count(metric_value) OVER f n FROM c
  WINDOW f AS ({part} ORDER BY bucket_end ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, CASE WHEN s IS NULL OR n = 1 THEN NULL WHEN s = 0 THEN 0 ELSE (metric_value - a) / s END score FROM w)
SELECT {more} bucket_end, round(metric_value, 3) metric_value, round(score, {digits}) anomaly_score,
  coalesce(({fail}) AND bucket_end > (SELECT max(bucket_end) FROM z) - INTERVAL {backfill} DAY, FALSE) is_anomalous FROM z
"""


def _scored_sql(counts: str, fail: str, backfill: int, digits: int = 6, part: str = "", more: str = "") -> str:
    return _SCORED.format(counts=counts, fail=fail, backfill=backfill, digits=digits, part=part, more=more)


_BY_TYPE = reference._DIMENSIONS.format(grid=reference._GRID14, where="TRUE")
_RUNS = f"r AS (SELECT {views._id('unique_id')} u, {views._time('generated_at')} g, status, full_refresh, execution_time FROM dbt_run_results)"
_SNAPSHOTS = """s AS (SELECT upper(full_table_name) t, lower(column_name) c, CAST(detected_at AS DATE) d, max(upper(regexp_replace(data_type, '\\s', '', 'g'))) k
  FROM schema_columns_snapshot WHERE full_table_name IS NOT NULL AND column_name IS NOT NULL GROUP BY 1, 2, 3)"""
_LOST = "SELECT invocation_id, model_execution_id FROM dbt_run_results WHERE invocation_id IS NOT NULL AND invocation_id NOT IN (SELECT invocation_id FROM dbt_invocations WHERE invocation_id IS NOT NULL)"
_CHECKS = f"""
WITH n AS (
  SELECT 'documents_have_a_language' test_name, 'lang' column_name, 'ERROR' severity, count(*) failures, count(*) own FROM documents WHERE lang IS NULL
  UNION ALL SELECT 'parts_are_of_usual_size', 'p_size', 'WARN', count(*), count(*) FROM part WHERE p_size < 5 OR p_size > 45
  UNION ALL SELECT 'customers_have_a_key', 'c_custkey', 'ERROR', count(*), count(*) FROM customer WHERE c_custkey IS NULL
  UNION ALL SELECT 'results_name_an_invocation', 'invocation_id', 'ERROR', count(*), count(DISTINCT invocation_id) FROM ({_LOST})),
c AS (SELECT *, CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'WARN' THEN 'warn' ELSE 'fail' END status FROM n)
"""
_EARLY = "id IS NOT NULL AND created_at < TIMESTAMP '2024-01-15 00:00:00'"
_LATE = "id IS NOT NULL AND created_at >= TIMESTAMP '2024-01-15 00:00:00'"
_KIND = "['model', 'seed', 'snapshot'][n_nationkey % 3 + 1]"
_END = "o_orderdate + to_hours(CAST(o_orderkey % 5000 AS BIGINT))"

QUERIES = {
    f.__name__: f
    for f in (
        incremental_volume,
        incremental_dimensions,
        freshness_anomalies,
        event_freshness_anomalies,
        excluded_results,
        anomalous_dimension_rows,
        store_upsert,
        store_delete_and_insert,
        store_delete_and_replace,
        csv_seed,
        csv_export,
        relation_scan,
        constant_rows,
        duplicate_rows,
        column_metadata,
        schema_snapshot,
        schema_states,
        exposure_validity,
        text_validation,
        unstructured_validation,
        check_results,
        alerts_dbt_tests,
        anomaly_results,
        alerts_anomaly_detection,
        alerts_schema_changes,
        last_schema_change,
        relationships_orphans,
        view_seed_run_results,
        view_snapshot_run_results,
        latest_full_refresh,
        alerts_source_freshness,
        sla_deadlines,
        load_models,
        load_run_results,
        load_source_freshness,
        load_invocation,
        declaration_problems,
        generated_tests,
        private_samples,
        table_metrics_of_two_kinds,
        anomaly_descriptions,
        metrics_too_large,
        no_metrics,
        schema_first_run,
        scalar_times,
        scalar_values,
    )
}
ORACLES = {
    "incremental_volume": _scored_sql(reference._DAILY, "abs(score) > 3", 2),
    "incremental_dimensions": _scored_sql(_BY_TYPE, "abs(score) > 1.5", 14, part="PARTITION BY dimension_value", more="dimension_value,"),
    "freshness_anomalies": _scored_sql(reference._freshness_sql("TRUE", "1 DAY"), "score > 1", 14, 3),
    "event_freshness_anomalies": _scored_sql(
        """SELECT CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) + INTERVAL 7 DAY bucket_end, CAST(max(l_partkey % 9) * 86400 AS DOUBLE) metric_value
  FROM lineitem WHERE """ + reference._SHIP_WHERE + " GROUP BY 1", "score > 1", 90, 3,
    ),
    "excluded_results": "SELECT * FROM (" + _scored_sql(reference._DAILY, "abs(score) > 3", 2) + ") WHERE day(bucket_end) % 2 = 0",
    "anomalous_dimension_rows": "SELECT event_type, count(*) \"rows\" FROM events WHERE event_type IN (SELECT dimension_value FROM ("
    + _scored_sql(_BY_TYPE, "abs(score) > 1.6", 14, part="PARTITION BY dimension_value", more="dimension_value,")
    + ") WHERE is_anomalous) GROUP BY 1",
    "store_upsert": f"""SELECT id, coalesce(max(updated_at) FILTER (WHERE {_LATE}), max(updated_at) FILTER (WHERE {_EARLY})) updated_at
  FROM data_monitoring_metrics WHERE id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1""",
    "store_delete_and_insert": f"""SELECT id, count(*) n FROM data_monitoring_metrics
  WHERE {_LATE} OR ({_EARLY} AND id NOT IN (SELECT id FROM data_monitoring_metrics WHERE {_LATE})) GROUP BY 1""",
    "store_delete_and_replace": "SELECT metric_type, count(*) n FROM data_monitoring_metrics WHERE id IS NOT NULL AND created_at IS NOT NULL AND metric_value IS NOT NULL AND bucket_duration_hours = 24 GROUP BY 1",
    "csv_seed": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "csv_export": """SELECT id, max(updated_at) updated_at FROM data_monitoring_metrics
  WHERE id IS NOT NULL AND updated_at >= TIMESTAMP '2024-01-08 00:00:00' AND updated_at < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1""",
    "relation_scan": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0",
    "constant_rows": """SELECT * FROM (VALUES (7, '["x", 1]', TIMESTAMP '2024-01-02 01:04:05', CAST(1 AS DOUBLE), TRUE),
  (0, 'true', NULL, NULL, TRUE), (2, '{"k": null}', NULL, 2.5, FALSE)) v(a, b, c, d, e)""",
    "duplicate_rows": "SELECT data_type, count(*) n FROM (SELECT DISTINCT full_table_name, column_name, data_type FROM schema_columns_snapshot) GROUP BY 1",
    "column_metadata": """SELECT 'NATION' table_name, column_name, replace(replace(column_type, 'INTEGER', 'INT'), 'VARCHAR', 'STRING') data_type FROM (DESCRIBE nation)
  UNION ALL SELECT 'REGION', column_name, replace(replace(column_type, 'INTEGER', 'INT'), 'VARCHAR', 'STRING') FROM (DESCRIBE region)""",
    "schema_snapshot": f"""WITH {_SNAPSHOTS}, l AS (SELECT t, max(d) d FROM s GROUP BY t), o AS (SELECT s.t, s.c FROM s JOIN l ON s.t = l.t AND s.d < l.d)
SELECT s.t || '.' || s.c full_column_name, s.t IN (SELECT t FROM o) AND (s.t, s.c) NOT IN (SELECT (t, c) FROM o) is_new, TIMESTAMP '2024-01-31 00:00:00' detected_at
FROM s JOIN l USING (t, d)""",
    "schema_states": "SELECT column_state_id, max(detected_at) detected_at FROM schema_columns_snapshot WHERE column_state_id IS NOT NULL GROUP BY 1",
    "exposure_validity": """SELECT * FROM (VALUES ('prices', 'p_discount', 'missing column'), ('sizes', 'p_size', 'type is int, not string')) v(exposure, column_name, error)
  WHERE (SELECT count(*) FROM (DESCRIBE part) WHERE column_name IN ('p_retailprice', 'p_size')) = 2""",
    "text_validation": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 AND c_mktsegment ILIKE '%furniture%'",
    "unstructured_validation": "SELECT doc_id FROM documents WHERE contains(text, '{{')",
    "check_results": _CHECKS + """SELECT test_name, column_name, severity, status, failures, CASE WHEN status <> 'pass' THEN own ELSE 0 END failed_row_count,
  least(failures, 5) samples FROM c""",
    "alerts_dbt_tests": _CHECKS + "SELECT test_name, 'dbt_test' alert_type, status, TIMESTAMP '2024-01-31 00:00:00' detected_at FROM c WHERE status <> 'pass'",
    "anomaly_results": "SELECT 'dimension' test_sub_type, CASE WHEN count(*) FILTER (WHERE is_anomalous) > 0 THEN 'fail' ELSE 'pass' END status, count(*) FILTER (WHERE is_anomalous) failures, count(*) scored_rows FROM ("
    + _scored_sql(_BY_TYPE, "abs(score) > 1.5", 14, part="PARTITION BY dimension_value", more="dimension_value,")
    + ") WHERE anomaly_score IS NOT NULL",
    "alerts_anomaly_detection": "SELECT 'dimension_anomalies' test_name, 'dimension' sub_type, 'fail' status, TIMESTAMP '2024-01-31 00:00:00' detected_at FROM ("
    + _scored_sql(_BY_TYPE, "abs(score) > 1.5", 14, part="PARTITION BY dimension_value", more="dimension_value,")
    + ") HAVING count(*) FILTER (WHERE is_anomalous) > 0",
    "alerts_schema_changes": "SELECT DISTINCT full_table_name alert_id, full_table_name table_name, 'fail' status, TIMESTAMP '2024-01-31 00:00:00' detected_at FROM (" + reference.ORACLES["schema_changes_history"] + ")",
    "last_schema_change": "",
    "relationships_orphans": _LOST,
    "view_seed_run_results": f"WITH {_RUNS} SELECT split_part(u, '.', 2) package_name, status, 'seed' materialization, count(*) runs, round(sum(execution_time), 3) run_seconds FROM r WHERE starts_with(u, 'seed.') GROUP BY 1, 2",
    "view_snapshot_run_results": f"WITH {_RUNS} SELECT split_part(u, '.', 2) package_name, status, 'snapshot' materialization, count(*) runs, round(sum(execution_time), 3) run_seconds FROM r WHERE starts_with(u, 'snapshot.') GROUP BY 1, 2",
    "latest_full_refresh": f"WITH {_RUNS} SELECT u unique_id, max(g) last_full_refresh FROM r WHERE full_refresh AND u IS NOT NULL GROUP BY 1",
    "alerts_source_freshness": """WITH w AS (SELECT full_table_name t, max(metric_value) a FROM data_monitoring_metrics WHERE metric_type = 'freshness' AND metric_value IS NOT NULL GROUP BY 1)
SELECT 'run.' || t alert_id, CASE WHEN a > 86400 THEN 'error' ELSE 'warn' END status, split_part(t, '.', 1) database_name, split_part(t, '.', 2) schema_name, split_part(t, '.', 3) identifier
FROM w WHERE a > 43200 AND t IS NOT NULL""",
    "sla_deadlines": """SELECT asked, zone, "time", CAST(timezone('UTC', timezone(zone, CAST(lt AS TIMESTAMP))) AS TIMESTAMP) due, dayofweek(CAST(lt AS TIMESTAMP)) = 0 OR day(CAST(lt AS TIMESTAMP)) = 1 applies
FROM (VALUES ('7', 'UTC', '7:00 AM', '2024-01-31 07:00:00'), ('07:00', 'Europe/Berlin', '7:00 AM', '2024-03-31 07:00:00'), ('7am', 'Europe/Berlin', '7:00 AM', '2024-03-30 07:00:00'),
  ('2:30pm', 'America/New_York', '2:30 PM', '2024-03-10 14:30:00'), ('12am', 'Asia/Kolkata', '12:00 AM', '2024-07-01 00:00:00')) v(asked, zone, "time", lt)""",
    "load_models": """SELECT 'model.geo.' || n_nationkey unique_id, CASE n_nationkey WHEN 0 THEN 'renamed' ELSE n_name END "name", 'region_' || n_regionkey schema_name, 'table' materialization,
  '["a", "b", "c"]' tags, '["' || n_name || '", "team"]' "owner", '["x", "y"]' depends_on_nodes, CASE n_nationkey WHEN 0 THEN '2024-02-02 00:00:00' ELSE '2024-01-31 00:00:00' END generated_at,
  'updated unchanged updated' loads FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey < 20""",
    "load_run_results": f"""WITH k AS (SELECT *, {_KIND} kind FROM nation)
SELECT 'run.' || kind || '.geo.' || n_nationkey model_execution_id, n_name "name", CASE WHEN n_nationkey % 5 = 0 THEN 'error' ELSE 'success' END status, kind resource_type, CAST(n_nationkey AS DOUBLE) execution_time,
  '2024-01-31T00:00:' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') execute_started_at, 'q' || n_nationkey query_id, 'table' materialization, 'g' group_name, TRUE full_refresh,
  CASE WHEN n_nationkey % 4 = 0 THEN -1 ELSE n_nationkey END rows_affected FROM k""",
    "load_source_freshness": """SELECT 'run.' || n_name source_freshness_execution_id, ['pass', 'warn', 'runtime error'][n_nationkey % 3 + 1] status,
  CASE WHEN n_nationkey % 3 < 2 THEN '2024-01-30' END max_loaded_at, CASE WHEN n_nationkey % 3 < 2 THEN 60.0 * n_nationkey ELSE -1 END age FROM nation""",
    "load_invocation": """SELECT 'run' invocation_id, 'build' command, '1.8.1' dbt_version, '4' threads, '["a", "b"]' selected, 'github_actions' orchestrator, 'nightly' job_name, '5' job_run_id,
  'https://h/o/r/actions/runs/5' job_run_url, 'prod' env, 'abc' git_sha""",
    "declaration_problems": "SELECT 'model.geo.' || n_nationkey unique_id, unnest(['description', 'meta key tier']) missing FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey < 20",
    "generated_tests": """WITH c AS (SELECT column_name n, replace(replace(column_type, 'INTEGER', 'INT'), 'VARCHAR', 'STRING') k, row_number() OVER () i FROM (DESCRIBE region)),
l AS (SELECT 0 a, 0 b, 'models:' t UNION ALL SELECT 0, 1, '  - name: region' UNION ALL SELECT 0, 2, '    columns:'
  UNION ALL SELECT 1, 2 * i, '      - name: ' || n FROM c UNION ALL SELECT 1, 2 * i + 1, '        data_type: ' || k FROM c
  UNION ALL SELECT 2, 0, '    tests:' UNION ALL SELECT 2, 1, '      - schema_changes_from_baseline:' UNION ALL SELECT 2, 2, '          fail_on_added: true'
  UNION ALL SELECT 3, 0, 'models:' UNION ALL SELECT 3, 1, '  - name: events' UNION ALL SELECT 3, 2, '    columns:' UNION ALL SELECT 3, 3, '      - name: props'
  UNION ALL SELECT 3, 4, '        tests:' UNION ALL SELECT 3, 5, '          - json_schema: {"properties": {"k": {"type": "integer"}}, "type": "object"}')
SELECT row_number() OVER (ORDER BY a, b) - 1 line, t content FROM l""",
    "private_samples": """SELECT * FROM (VALUES ('plain', 5), ('switched off', 0), ('own number', 17), ('private model', 0), ('private column', 0), ('other column', 5), ('not shown', 0), ('shown', 5)) v(what, "rows")""",
    "table_metrics_of_two_kinds": _scored_sql(
        f"SELECT 'row_count' metric_name, bucket_end, metric_value FROM ({reference._DAILY}) UNION ALL SELECT 'freshness', bucket_end, metric_value FROM ({reference._freshness_sql('TRUE', '1 DAY')})",
        "(score > 3 OR score < -3 AND metric_name = 'row_count')", 2, 3, "PARTITION BY metric_name", "metric_name,",
    ),
    "anomaly_descriptions": f"""WITH w AS (SELECT bucket_end, metric_value, avg(metric_value) OVER f a, count(*) OVER f n FROM ({reference._DAILY}) WINDOW f AS (ORDER BY bucket_end ROWS UNBOUNDED PRECEDING))
SELECT bucket_end, CASE WHEN n = 1 THEN 'Not enough data to calculate anomaly score.'
  ELSE 'The last row_count value is ' || round(metric_value, 3) || '. The average for this metric is ' || round(a, 3) || '.' END anomaly_description FROM w""",
    "metrics_too_large": """WITH m AS (SELECT unnest(['min', 'max', 'average', 'sum']) metric_name, coalesce(o_orderpriority, 'NULL') dimension_value,
  unnest([CAST(min(o_orderkey) AS DOUBLE), max(o_orderkey), avg(o_orderkey), sum(o_orderkey)]) * 100000 v FROM orders GROUP BY o_orderpriority)
SELECT metric_name, dimension_value, round(v, 3) metric_value FROM m WHERE v < 2147483647""",
    "no_metrics": "SELECT '' metric_name, TIMESTAMP '2024-01-31 00:00:00' bucket_end WHERE FALSE",
    "schema_first_run": "SELECT 2 run, 'n_name' column_name, 'column_added' \"change\"",
    "scalar_times": f"""WITH o AS (SELECT *, {_END} e FROM orders)
SELECT o_orderkey, CAST(date_trunc('hour', e) AS TIMESTAMP) trunc_hour, CAST(date_trunc('day', e) AS TIMESTAMP) trunc_day, CAST(date_trunc('week', e) AS TIMESTAMP) trunc_week,
  CAST(date_trunc('month', e) AS TIMESTAMP) trunc_month, o_orderdate + INTERVAL 31 DAY add_day, o_orderdate + INTERVAL 1 MONTH add_month, o_orderdate - INTERVAL 90 MINUTE add_minute,
  date_diff('day', o_orderdate, e) diff_day, date_diff('day', date_trunc('week', o_orderdate), date_trunc('week', e)) // 7 diff_week, date_diff('month', o_orderdate, e) diff_month, date_diff('quarter', o_orderdate, e) diff_quarter,
  date_diff('year', o_orderdate, e) diff_year, date_sub('hour', o_orderdate, e) diff_hour, date_sub('minute', o_orderdate, e) diff_minute, date_sub('second', o_orderdate, e) diff_second,
  dayname(e) day_of_week, hour(e) hour_of_day, dayname(e) || hour(e) hour_of_week, strftime(e, '%Y-%m-%d %H:%M:%S') to_char FROM o""",
    "scalar_values": """WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END odd FROM orders)
SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) as_int, CAST(o_orderkey AS VARCHAR) as_string, TIMESTAMP '2024-01-02 03:04:05' as_timestamp, '2024-01-02' as_date,
  TRY_CAST(o_orderstatus || '1' AS INTEGER) IS NULL no_int, TRY_CAST('1' || o_custkey AS DOUBLE) as_float, CAST(NULL AS VARCHAR) no_text, '12' twelve,
  contains(lower(o_orderpriority), 'urg') has_urg, contains(o_orderpriority, 'urg') has_urg_exactly, coalesce(o_orderstatus, 'NULL') || '; ' || coalesce(CAST(odd AS VARCHAR), 'NULL') joined,
  'DB.S.' || upper(o_orderstatus) table_name, 'S.T.C' column_name, 'S' schema_part, CAST(NULL AS VARCHAR) no_database,
  round(CAST(o_custkey AS DOUBLE) * 100 / nullif(o_orderkey, 0), 3) percent, round(100 - round(CAST(o_custkey AS DOUBLE) * 100 / nullif(o_orderkey, 0), 3), 3) not_percent,
  CASE WHEN odd IS NOT NULL THEN least(odd, o_orderkey) ELSE -1 END lesser, CASE WHEN odd IS NOT NULL THEN greatest(odd, o_orderkey) ELSE -1 END greater,
  coalesce(odd > 500, FALSE) is_true, coalesce(odd <= 500, FALSE) is_false, CASE WHEN o_totalprice * 1e-12 < 1e-9 * greatest(1.0, abs(o_totalprice)) THEN CAST(0 AS DOUBLE) ELSE o_totalprice * 1e-12 END settled,
  md5(o_orderstatus || '-' || coalesce(CAST(odd AS VARCHAR), '')) surrogate_key FROM o""",
}


def _finish() -> None:
    from tidemark.plans import problems

    ORACLES["last_schema_change"] = "SELECT max(CAST(detected_on AS TIMESTAMP)) \"at\" FROM (" + problems.P7_FOUND_SQL + ")"


_finish()
