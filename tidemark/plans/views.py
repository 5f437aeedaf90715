"""Views over run results, invocations and test results, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text_time import clean_id, utc_instant
from tidemark.operators.ordered import number_within
from tidemark.session import table

RUN_COLUMNS = [
    "model_execution_id",
    "unique_id",
    "invocation_id",
    "query_id",
    "name",
    "generated_at",
    "status",
    "full_refresh",
    "message",
    "execution_time",
    "execute_started_at",
    "execute_completed_at",
    "compile_started_at",
    "compile_completed_at",
    "compiled_code",
    "adapter_response",
    "thread_id",
    "group_name",
]
NODE_COLUMNS = ["database_name", "schema_name", "tags", "package_name", "path", "original_path", "owner", "alias"]


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """Of each unique_id the row generated last."""
    order = W.partitionBy("unique_id").orderBy(utc_instant("generated_at").desc_nulls_last(), F.col("metadata_hash").desc_nulls_last())
    return nodes.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def node_run_results(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Runs with the columns of the node that ran; runs of unknown nodes are left out."""
    about = nodes.select(F.col("unique_id").alias("_id"), *NODE_COLUMNS, *(["materialization"] if "materialization" in nodes.columns else []))
    joined = runs.drop("materialization").join(about, runs["unique_id"] == F.col("_id")) if "materialization" not in about.columns else runs.withColumnRenamed("materialization", "_run_materialization").join(about, runs["unique_id"] == F.col("_id"))
    kind = F.coalesce("_run_materialization", "materialization") if "materialization" in about.columns else F.lit("seed")
    return joined.select(*RUN_COLUMNS, *NODE_COLUMNS, kind.alias("materialization"))


def model_run_results(runs: DataFrame, models: DataFrame) -> DataFrame:
    """Model runs with their place from the end, and whether they belong to the day's first or last invocation.

    The first and last invocation of a day come from a combined aggregate of all runs of the day (ties
    go to the smaller invocation id), which is joined back: one row per day, no window over a day.
    """
    at = utc_instant("generated_at")
    out = node_run_results(runs, models)
    days = (
        out.groupBy(F.to_date(at).alias("_day"))
        .agg(F.min_by("invocation_id", F.struct(at, F.col("invocation_id"))).alias("_first"), F.max_by("invocation_id", F.struct(at, F.col("invocation_id"))).alias("_last"))
    )
    newest = [at.desc_nulls_last(), F.col("model_execution_id").desc_nulls_last()]
    ranked = number_within(out, ["unique_id"], newest, F.to_date(at), "model_invocation_reverse_index", last_first=True)
    joined = ranked.join(days, F.to_date(at).eqNullSafe(F.col("_day")), "left")
    same = lambda c: F.coalesce(F.col("invocation_id") == F.col(c), F.lit(False))
    return joined.withColumn("is_the_first_invocation_of_the_day", same("_first")).withColumn("is_the_last_invocation_of_the_day", same("_last")).drop("_day", "_first", "_last")


def latest_full_refresh(runs: DataFrame) -> DataFrame:
    """(unique_id, generated_at) of each node's latest run that was a full refresh."""
    return runs.where("full_refresh AND unique_id IS NOT NULL").groupBy("unique_id").agg(F.max(utc_instant("generated_at")).alias("generated_at"))


def job_run_results(invocations: DataFrame) -> DataFrame:
    start, end = F.min(utc_instant("run_started_at")), F.max(utc_instant("run_completed_at"))
    return (
        invocations.where("job_id IS NOT NULL")
        .groupBy(F.col("job_name").alias("name"), F.col("job_id").alias("id"), F.col("job_run_id").alias("run_id"))
        .agg(start.alias("run_started_at"), end.alias("run_completed_at"))
        .withColumn("run_execution_time", F.expr("timestampdiff(SECOND, run_started_at, run_completed_at)"))
    )


def alerts(results: DataFrame, kind: str, disabled: bool = False, warnings: bool = True, skipped: bool = False) -> DataFrame:
    """Test results of a type that are no passes; warnings and skipped ones as asked for."""
    status = F.lower("status")
    out = results.where((F.col("test_type") == kind) & (status != "pass"))
    if not warnings:
        out = out.where(status != "warn")
    if not skipped:
        out = out.where(status != "skipped")
    return (out.limit(0) if disabled else out).select(
        F.col("id").alias("alert_id"),
        "test_execution_id",
        "test_unique_id",
        "model_unique_id",
        "detected_at",
        "database_name",
        "schema_name",
        "table_name",
        "column_name",
        F.col("test_type").alias("alert_type"),
        F.col("test_sub_type").alias("sub_type"),
        F.col("test_results_description").alias("alert_description"),
        "owners",
        "tags",
        "test_name",
        "test_params",
        "severity",
        "status",
    )


def alerts_models(model_runs: DataFrame, snapshot_runs: DataFrame, disabled: bool = False, skipped: bool = False) -> DataFrame:
    """Runs of models and snapshots that did not succeed."""
    keep = ["model_execution_id", "unique_id", "generated_at", "database_name", "materialization", "path", "original_path", "schema_name", "message", "owner", "tags", "alias", "status", "full_refresh"]
    every = model_runs.select(*keep).unionByName(snapshot_runs.select(*keep))
    bad = every.where(F.lower("status") != "success")
    if not skipped:
        bad = bad.where(F.lower("status") != "skipped")
    out = bad.withColumn("detected_at", utc_instant("generated_at")).withColumnsRenamed({"model_execution_id": "alert_id", "owner": "owners"}).drop("generated_at")
    return out.limit(0) if disabled else out


def alerts_source_freshness(results: DataFrame, sources: DataFrame, warnings: bool = True) -> DataFrame:
    """Source freshness results that are no passes, with the source's columns."""
    bad = results.where(F.lower("status") != "pass")
    if not warnings:
        bad = bad.where(F.lower("status") != "warn")
    about = sources.select("unique_id", "database_name", "schema_name", "source_name", "identifier", "tags", "meta", "owner", "package_name", "path")
    return bad.withColumnRenamed("source_freshness_execution_id", "alert_id").join(about, "unique_id")


# Queries over the test tables


def _runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dbt_run_results")
    return rows.withColumn("unique_id", clean_id("unique_id")).withColumn("invocation_id", clean_id("invocation_id")).withColumn("model_execution_id", clean_id("model_execution_id"))


def _models(spark: SparkSession, d: str) -> DataFrame:
    return latest_nodes(table(spark, d, "dbt_models").withColumn("unique_id", clean_id("unique_id")))


def view_model_run_results(spark: SparkSession, d: str) -> DataFrame:
    out = model_run_results(_runs(spark, d), _models(spark, d))
    return out.groupBy("package_name", "status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("model_invocation_reverse_index") == 1).alias("latest"),
        F.count_if("is_the_first_invocation_of_the_day").alias("first_of_day"),
        F.count_if("is_the_last_invocation_of_the_day").alias("last_of_day"),
    )


def view_job_run_results(spark: SparkSession, d: str) -> DataFrame:
    return job_run_results(table(spark, d, "dbt_invocations"))


def view_alerts_models(spark: SparkSession, d: str) -> DataFrame:
    runs, models = _runs(spark, d), _models(spark, d)
    out = alerts_models(node_run_results(runs, models), node_run_results(runs, models).limit(0))
    return out.groupBy("schema_name", "status").agg(F.count(F.lit(1)).alias("alerts"), F.max("detected_at").alias("latest"))


def artifact_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _models(spark, d).select(F.lit("dbt_models").alias("artifacts_model"), "unique_id", "metadata_hash")


def pipeline_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Models by package and materialization, with the number of tags, of the latest upload."""
    tags = F.size(F.from_json("tags", "array<string>"))
    return _models(spark, d).groupBy("package_name", "materialization").agg(F.count(F.lit(1)).alias("models"), F.sum(F.greatest(tags, F.lit(0))).cast("bigint").alias("tags"))


def _id(c: str) -> str:
    return f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


def _time(c: str) -> str:
    return f"CAST(timezone('UTC', TRY_CAST(CASE WHEN regexp_matches({c}, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN {c} ELSE {c} || 'Z' END AS TIMESTAMPTZ)) AS TIMESTAMP)"


_LATEST = f"""
m AS (SELECT * FROM (SELECT * REPLACE ({_id('unique_id')} AS unique_id),
  row_number() OVER (PARTITION BY {_id('unique_id')} ORDER BY {_time('generated_at')} DESC NULLS LAST, metadata_hash DESC NULLS LAST) nth FROM dbt_models) WHERE nth = 1),
r AS (SELECT {_id('unique_id')} u, {_id('invocation_id')} i, {_id('model_execution_id')} e, status, {_time('generated_at')} g FROM dbt_run_results)"""

QUERIES = {
    "view_model_run_results": view_model_run_results,
    "view_job_run_results": view_job_run_results,
    "view_alerts_models": view_alerts_models,
    "artifact_hashes": artifact_hashes,
    "pipeline_metadata": pipeline_metadata,
}
ORACLES = {
    "view_model_run_results": f"""WITH {_LATEST},
j AS (SELECT r.*, m.package_name FROM r JOIN m ON r.u = m.unique_id),
k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY g DESC NULLS LAST, e DESC NULLS LAST) x,
  first_value(i) OVER (PARTITION BY CAST(g AS DATE) ORDER BY g, i NULLS FIRST) f,
  first_value(i) OVER (PARTITION BY CAST(g AS DATE) ORDER BY g DESC, i DESC NULLS LAST) l FROM j)
SELECT package_name, status, count(*) runs, count(*) FILTER (WHERE x = 1) latest, count(*) FILTER (WHERE i = f) first_of_day,
  count(*) FILTER (WHERE i = l) last_of_day FROM k GROUP BY 1, 2""",
    "view_job_run_results": f"""SELECT job_name "name", job_id id, job_run_id run_id, min({_time('run_started_at')}) run_started_at, max({_time('run_completed_at')}) run_completed_at,
  CAST(trunc(epoch_us(max({_time('run_completed_at')})) / 1e6 - epoch_us(min({_time('run_started_at')})) / 1e6) AS BIGINT) run_execution_time
FROM dbt_invocations WHERE job_id IS NOT NULL GROUP BY 1, 2, 3""",
    "view_alerts_models": f"""WITH {_LATEST}
SELECT m.schema_name, r.status, count(*) alerts, max(r.g) latest FROM r JOIN m ON r.u = m.unique_id WHERE lower(r.status) NOT IN ('success', 'skipped') GROUP BY 1, 2""",
    "artifact_hashes": f"WITH {_LATEST} SELECT 'dbt_models' artifacts_model, unique_id, metadata_hash FROM m",
    "pipeline_metadata": f"""WITH {_LATEST} SELECT package_name, materialization, count(*) models,
  CAST(sum(coalesce(len(CAST(from_json(tags, '["VARCHAR"]') AS VARCHAR[])), 0)) AS BIGINT) tags FROM m GROUP BY 1, 2""",
}
