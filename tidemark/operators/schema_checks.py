"""Schema snapshots and what changed against the last one or a declared baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import RunContext, TableRef
from tidemark.operators.metrics import surrogate_key

SNAPSHOT = (
    "column_state_id string, full_column_name string, full_table_name string, column_name string, data_type string, "
    "is_new boolean, detected_at timestamp_ntz, created_at timestamp_ntz"
)


def declared_columns(df: DataFrame, table: TableRef) -> DataFrame:
    """(full_table_name, column_name, data_type) of a table, types in upper case."""
    rows = [(table.full_name, f.name, f.dataType.simpleString().upper()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "full_table_name string, column_name string, data_type string")


def snapshot(columns: DataFrame, history: DataFrame | None, ctx: RunContext) -> DataFrame:
    """Snapshot rows of (full_table_name, column_name, data_type). A column is new if its table was in the
    last snapshot and it was not in any; on a table's first run nothing is new."""
    when = F.lit(ctx.run_started_at).cast("timestamp_ntz")
    full = F.concat_ws(".", "full_table_name", "column_name")
    rows = columns.withColumn("full_column_name", full)
    if history is None:
        rows = rows.withColumn("is_new", F.lit(False))
    else:
        known = history.select(F.lower("full_column_name").alias("_column")).distinct().withColumn("_seen", F.lit(True))
        tables = history.select(F.upper("full_table_name").alias("_table")).distinct().withColumn("_known", F.lit(True))
        rows = (
            rows.join(known, F.lower("full_column_name") == F.col("_column"), "left")
            .join(tables, F.upper("full_table_name") == F.col("_table"), "left")
            .withColumn("is_new", F.col("_known").isNotNull() & F.col("_seen").isNull())
        )
    return rows.select(
        surrogate_key(F.col("full_table_name"), F.col("column_name"), F.col("data_type")).alias("column_state_id"),
        "full_column_name",
        "full_table_name",
        "column_name",
        "data_type",
        "is_new",
        when.alias("detected_at"),
        when.alias("created_at"),
    )


def last_snapshot(history: DataFrame) -> DataFrame:
    """Of each table the rows of its latest snapshot."""
    latest = history.groupBy(F.upper("full_table_name").alias("_table")).agg(F.max("detected_at").alias("_at"))
    return history.join(latest, (F.upper("full_table_name") == F.col("_table")) & (F.col("detected_at") == F.col("_at"))).drop("_table", "_at")


def changes(now: DataFrame, before: DataFrame, added: bool = True, types: bool = True) -> DataFrame:
    """(full_table_name, column_name, change, data_type, pre_data_type, description) between two column lists.

    Names are compared without case; removals of tables that are gone altogether are not reported,
    types that are not declared are not compared. added / types switch those changes off.
    """
    cur = now.select(F.lower("full_table_name").alias("t"), F.lower("column_name").alias("c"), "full_table_name", "column_name", "data_type").dropDuplicates(["t", "c"])
    pre = before.select(
        F.lower("full_table_name").alias("pt"), F.lower("column_name").alias("pc"), F.col("full_table_name").alias("pre_table"), F.col("column_name").alias("pre_column"), F.col("data_type").alias("pre_data_type")
    ).dropDuplicates(["pt", "pc"])
    both = cur.join(pre, (F.col("t") == F.col("pt")) & (F.col("c") == F.col("pc")), "full_outer")
    there = cur.select(F.col("t").alias("_there")).distinct()
    known = pre.select(F.col("pt").alias("_known")).distinct()
    both = both.join(there, F.coalesce("t", "pt") == F.col("_there"), "left_semi").join(known, F.coalesce("t", "pt") == F.col("_known"), "left_semi")
    differs = F.upper("data_type") != F.upper("pre_data_type")
    change = (
        F.when(F.col("pt").isNull(), F.when(F.lit(added), "column_added"))
        .when(F.col("t").isNull(), "column_removed")
        .when(F.lit(types) & differs, "type_changed")
    )
    name = F.coalesce("column_name", "pre_column")
    text = (
        F.when(change == "column_added", F.concat(F.lit('The column "'), name, F.lit('" was added')))
        .when(change == "column_removed", F.concat(F.lit('The column "'), name, F.lit('" was removed')))
        .otherwise(F.concat(F.lit('The type of "'), name, F.lit('" was changed from '), "pre_data_type", F.lit(" to "), "data_type"))
    )
    return both.select(
        F.coalesce("full_table_name", "pre_table").alias("full_table_name"),
        name.alias("column_name"),
        change.alias("change"),
        "data_type",
        "pre_data_type",
        text.alias("description"),
    ).where("change IS NOT NULL")


def changes_since_last_run(columns: DataFrame, history: DataFrame | None) -> DataFrame:
    """Changes against the table's last stored snapshot; none on the first run."""
    before = columns.limit(0) if history is None else last_snapshot(history)
    return changes(columns, before)


def changes_from_baseline(columns: DataFrame, baseline: list[tuple[str, str, str | None]], fail_on_added: bool = False, enforce_types: bool = False) -> DataFrame:
    """Changes against declared (table, column, type or None)."""
    declared = columns.sparkSession.createDataFrame(baseline, "full_table_name string, column_name string, data_type string")
    return changes(columns, declared, added=fail_on_added, types=enforce_types)


def latest_states(history: DataFrame) -> DataFrame:
    """Snapshot rows once per column state, the latest."""
    order = W.partitionBy("column_state_id").orderBy(F.col("detected_at").desc_nulls_last(), F.col("created_at").desc_nulls_last())
    return history.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def last_change_time(results: DataFrame):
    """When a schema change was last reported."""
    return results.where("test_type = 'schema_change'").agg(F.max("detected_at")).first()[0]


def exposure_problems(exposures: list[dict], node: str, columns: dict[str, str]) -> list[dict]:
    """Columns that exposures of a node refer to and that are missing or of another type.

    exposures: dicts with name, depends_on (node ids) and referenced columns [{'column_name',
    'data_type', 'node'}]; columns: the node's columns and types.
    """
    have = {c.lower(): t.lower() for c, t in columns.items()}
    out = []
    for e in exposures:
        if node not in e.get("depends_on", ()):
            continue
        for ref in e.get("referenced_columns", ()):
            if ref.get("node") and ref["node"] != node:
                continue
            name, kind = ref["column_name"].lower(), (ref.get("data_type") or "").lower()
            if name not in have:
                out.append({"exposure": e["name"], "column_name": ref["column_name"], "error": "missing column"})
            elif kind and kind != have[name]:
                out.append({"exposure": e["name"], "column_name": ref["column_name"], "error": f"type is {have[name]}, not {kind}"})
    return out
