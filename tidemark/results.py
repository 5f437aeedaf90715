"""From a check's outcome to stored result rows: counts, samples and who may see them, status, types."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, RunContext
from tidemark.operators.row_checks import failed_row_count
from tidemark.sources.tables import constant

RESULTS_SCHEMA = (
    "id string, data_issue_id string, test_execution_id string, test_unique_id string, model_unique_id string, invocation_id string, "
    "detected_at timestamp_ntz, created_at timestamp_ntz, database_name string, schema_name string, table_name string, column_name string, "
    "test_type string, test_sub_type string, test_results_description string, owners string, tags string, test_results_query string, other string, "
    "test_name string, test_params string, severity string, status string, failures bigint, test_short_name string, test_alias string, "
    "result_rows string, failed_row_count bigint"
)
ROWS_SCHEMA = (
    "test_results_id string, result_row string, detected_at timestamp_ntz, created_at timestamp_ntz, row_index int, test_type string"
)
# The checks of each type.
ANOMALY_CHECKS = (
    "volume_anomalies",
    "freshness_anomalies",
    "event_freshness_anomalies",
    "table_anomalies",
    "dimension_anomalies",
    "column_anomalies",
    "all_columns_anomalies",
)
SCHEMA_CHECKS = ("schema_changes", "schema_changes_from_baseline", "json_schema")


@dataclass
class TestNode:
    """What is known about a test: names, tags, where it hangs and how it is configured."""

    unique_id: str
    name: str
    model_unique_id: str | None = None
    column_name: str | None = None
    own_namespace: bool = True
    severity: str = "ERROR"
    tags: list[str] = field(default_factory=list)
    owners: list[str] = field(default_factory=list)
    model_tags: list[str] = field(default_factory=list)
    column_tags: dict[str, list[str]] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    meta: dict[str, Any] = field(default_factory=dict)
    database: str | None = None
    schema: str | None = None
    table: str | None = None

    @property
    def short_name(self) -> str:
        return self.name.rsplit(".", 1)[-1]


def check_type(node: TestNode) -> str:
    if node.own_namespace and node.short_name.lower() in ANOMALY_CHECKS:
        return "anomaly_detection"
    return "schema_change" if node.own_namespace and node.short_name.lower() in SCHEMA_CHECKS else "dbt_test"


def _lower(tags: str | Iterable[str] | None) -> set[str]:
    return {t.lower() for t in ([tags] if isinstance(tags, str) else tags or ())}


def sample_limit(node: TestNode, selected: Iterable[str] | None = None, options: Mapping[str, Any] | None = None) -> int:
    """Rows of a failed test that may be kept: -1 all, 0 none.

    The test's own switch comes first, then a tag that allows samples, then hiding by default where
    such tags are in use, then tags for personal data on the model, the test, or a selected column
    (all of the table's columns if it is not known which are selected). Personal data of the model or
    of the tested column outweighs a tag that allows samples.
    """
    get = lambda name: (options or {}).get(name, DEFAULTS[name])
    limit = node.meta.get("test_sample_row_count", get("test_sample_row_count"))
    if node.meta.get("disable_test_samples"):
        return 0
    private = _lower(get("pii_tags")) if get("disable_samples_on_pii_tags") else set()
    model, test = _lower(node.model_tags), _lower(node.tags)
    columns = {c.lower(): _lower(t) for c, t in node.column_tags.items()}
    own = columns.get((node.column_name or "").lower(), set())
    if get("enable_samples_on_show_sample_rows_tags"):
        shown = _lower(get("show_sample_rows_tags"))
        allowed = bool(shown & (model | test)) or bool(shown & own) and not private & own
        return limit if allowed and not private & model else 0
    seen = columns if selected is None else {c.lower() for c in selected}
    if private & model or private & test or any(private & t for c, t in columns.items() if c in seen):
        return 0
    return limit


def sample_rows(failures: DataFrame, limit: int, failed: int | None = None) -> list[dict[str, Any]]:
    """Up to limit failing rows as dicts; no query for a limit of 0 or a passed test; never more rows than failures.

    A limit below 0 asks for all rows, which are streamed here partition by partition; as_json_rows() keeps
    all rows of a large table without the driver.
    """
    if limit == 0 or failed == 0:
        return []
    rows = failures.toLocalIterator() if limit < 0 else failures.limit(limit).collect()
    out = [r.asDict(recursive=True) for r in rows]
    return out[:failed] if failed else out


@dataclass
class Outcome:
    node: TestNode
    status: str
    failures: int
    failed_rows: int | None
    samples: list[dict[str, Any]]
    description: str | None = None
    sub_type: str = "generic"
    column_name: str | None = None
    other: Any = None
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    table: str | None = None


def run_check(node: TestNode, failures: DataFrame, calculation: str | None = "count(*)", warn_if: int = 1, error_if: int = 1, options: Mapping[str, Any] | None = None) -> Outcome:
    """Count, own calculation and samples of a check's failing rows, from one persisted result."""
    failures = failures.persist()
    try:
        n = failures.count()
        severe = node.severity.upper() == "ERROR" and n >= error_if
        status = "fail" if severe else "warn" if n >= warn_if else "pass"
        counted = failed_row_count(failures, calculation) if calculation and status != "pass" else None
        samples = sample_rows(failures, sample_limit(node, failures.columns, options), n) if status != "pass" else []
        return Outcome(node, status, n, counted, samples)
    finally:
        failures.unpersist()


#: What one outcome of an anomaly check stands for.
GROUP = ["full_table_name", "column_name", "metric_name"]


def anomaly_outcomes(node: TestNode, classified: DataFrame, most: int = 5, samples: int = 100) -> list[Outcome]:
    """One outcome per (table, column, metric) of classified scores, which have one row per bucket and series.

    Counted and described in Spark: per outcome its counts, its last row and the `most` dimension values that
    were anomalous last come to the driver, and as samples its last `samples` scored rows; anomaly_rows() has
    all of them. A metric without any score passes with a note.
    """
    rows = classified.withColumn("_scored", F.col("anomaly_score").isNotNull())
    bad = F.col("_scored") & F.coalesce("is_anomalous", F.lit(False))
    # The last anomalous row, else the last scored one, else the last.
    rank = F.struct(bad.cast("int").alias("b"), F.col("_scored").alias("s"), F.col("bucket_end").alias("e"), F.col("anomaly_description").alias("d"))
    counts = rows.groupBy(*GROUP).agg(
        F.count_if("_scored").alias("scored"),
        F.count_if(bad).alias("bad"),
        F.max_by("anomaly_description", rank).alias("text"),
        F.max_by("dimension", rank).alias("dimension"),
    )
    values = rows.where(bad & F.col("dimension").isNotNull()).groupBy(*GROUP, "dimension_value").agg(F.max("bucket_end").alias("last"))
    of_group = W.partitionBy(*GROUP)
    top = values.withColumn("_nth", F.row_number().over(of_group.orderBy(F.col("last").desc(), F.col("dimension_value").asc_nulls_last()))).where(F.col("_nth") <= most)
    known: dict[tuple, tuple[int, list]] = {}
    for r in values.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).collect():
        known[tuple(r[c] for c in GROUP)] = (r["n"], [])
    for r in top.orderBy(*GROUP, "_nth").collect():
        known[tuple(r[c] for c in GROUP)][1].append(r["dimension_value"])
    last = of_group.orderBy(F.col("bucket_end").desc(), F.col("is_anomalous").desc())
    kept: dict[tuple, list[dict[str, Any]]] = {}
    picked = rows.where("_scored").withColumn("_nth", F.row_number().over(last)).where(F.col("_nth") <= samples)
    for r in picked.orderBy(*GROUP, F.col("_nth").desc()).collect():
        d = r.asDict(recursive=True)
        kept.setdefault(tuple(d[c] for c in GROUP), []).append({k: v for k, v in d.items() if k not in ("_scored", "_nth")})
    out = []
    for r in counts.orderBy(*GROUP).collect():
        group = tuple(r[c] for c in GROUP)
        text = r["text"] if r["scored"] else "Not enough data to calculate anomaly score."
        n, names = known.get(group, (0, []))
        if r["bad"] and n > 1:
            text = f"{n} values of dimension {r['dimension']} are anomalous, among them " + ", ".join(map(str, names)) + "."
        status = ("fail" if node.severity.upper() == "ERROR" else "warn") if r["bad"] else "pass"
        out.append(Outcome(node, status, r["bad"], r["bad"], kept.get(group, []), text, r["metric_name"], r["column_name"], table=r["full_table_name"]))
    return out


def anomaly_rows(classified: DataFrame, outcomes: list[Outcome], ctx: RunContext) -> DataFrame:
    """All scored rows as sample rows of their outcomes, for the table of sample rows; nothing comes to the driver."""
    spark = classified.sparkSession
    ids = spark.createDataFrame([(o.table, o.column_name, o.sub_type, o.id, check_type(o.node)) for o in outcomes], "_t string, _c string, _m string, test_results_id string, test_type string")
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(GROUP, ("_t", "_c", "_m"))]
    scored = classified.where("anomaly_score IS NOT NULL")
    nth = F.row_number().over(W.partitionBy("test_results_id").orderBy("bucket_end", F.col("dimension_value").asc_nulls_first())) - 1
    # Outcomes are as many as metrics, not as rows.
    return scored.withColumn("result_row", F.to_json(F.struct(*scored.columns))).join(F.broadcast(ids), on).select(
        "test_results_id", "result_row", F.lit(ctx.run_started_at).cast("timestamp_ntz").alias("detected_at"), F.lit(ctx.now).cast("timestamp_ntz").alias("created_at"), nth.alias("row_index"), "test_type"
    )


def result_tables(spark: SparkSession, outcomes: list[Outcome], ctx: RunContext) -> tuple[DataFrame, DataFrame]:
    """(results, sample rows) of a run, ready to be appended to their tables."""
    rows, samples = [], []
    for o in outcomes:
        n = o.node
        note = o.description
        percent = n.params.get("sample_percent")
        if isinstance(percent, (int, float)) and 0 < percent < 100:
            note = ((note + " ") if note else "") + "The samples come from a part of the rows and may not match the number of failures."
        rows.append(
            {
                "id": o.id,
                "test_execution_id": f"{ctx.invocation_id}.{n.unique_id}",
                "test_unique_id": n.unique_id,
                "model_unique_id": n.model_unique_id,
                "invocation_id": ctx.invocation_id,
                "detected_at": ctx.run_started_at,
                "created_at": ctx.now,
                "database_name": n.database,
                "schema_name": n.schema,
                "table_name": n.table,
                "column_name": o.column_name or n.column_name,
                "test_type": check_type(n),
                "test_sub_type": o.sub_type,
                "test_results_description": note,
                "owners": sorted(n.owners),
                "tags": sorted(n.tags),
                "other": o.other,
                "test_name": n.name,
                "test_params": n.params,
                "severity": n.severity,
                "status": o.status,
                "failures": o.failures,
                "test_short_name": n.short_name,
                "failed_row_count": o.failed_rows,
            }
        )
        for i, s in enumerate(o.samples):
            samples.append(
                {
                    "test_results_id": o.id,
                    "result_row": json.dumps(s, default=str, sort_keys=True),
                    "detected_at": ctx.run_started_at,
                    "created_at": ctx.now,
                    "row_index": i,
                    "test_type": check_type(n),
                }
            )
    return constant(spark, rows, RESULTS_SCHEMA), constant(spark, samples, ROWS_SCHEMA)


def as_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("result_row"))
