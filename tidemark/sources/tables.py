"""Reading and writing plain tables: relations, CSV seeds, constant rows, column lists, exports."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def relation(spark: SparkSession, source: str, where: str | None = None, format: str | None = None, **options: str) -> DataFrame:
    """A catalog table or a path (parquet, orc, json, csv or another format by its name), filtered."""
    if format is None and "/" not in source:
        df = spark.table(source)
    else:
        df = spark.read.format(format or "parquet").options(**options).load(source)
    return df.where(where) if where else df


def csv_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Seed rows from CSV with a header; the schema is given, never inferred."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def cell(value: Any, kind: T.DataType) -> Any:
    """A Python value as a column of that type takes it: lists and dicts as JSON, times from ISO text."""
    if value is None:
        return None
    if isinstance(value, (list, tuple, dict)) and isinstance(kind, T.StringType):
        return json.dumps(value, default=str)
    if isinstance(kind, T.StringType):
        return ("true" if value else "false") if isinstance(value, bool) else str(value)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)) and isinstance(value, str):
        parsed = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
        return parsed.astimezone(None).replace(tzinfo=None) if parsed.tzinfo and isinstance(kind, T.TimestampType) else _utc(parsed)
    if isinstance(kind, T.DateType) and isinstance(value, str):
        return date.fromisoformat(value[:10])
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType)):
        return int(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    return bool(value) if isinstance(kind, T.BooleanType) else value


def _utc(t: datetime) -> datetime:
    from datetime import UTC

    return t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t


def constant(spark: SparkSession, rows: Iterable[Mapping[str, Any]], schema: str) -> DataFrame:
    """Rows from dicts; missing keys are null, unknown ones are ignored."""
    shape = spark.createDataFrame([], schema).schema
    return spark.createDataFrame([tuple(cell(r.get(f.name), f.dataType) for f in shape.fields) for r in rows], shape)


def insert(df: DataFrame, table: str) -> None:
    """Append by column name to a catalog table."""
    df.select(*df.sparkSession.table(table).columns).write.mode("append").insertInto(table)


def create_or_replace(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").saveAsTable(table)


def columns_of(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(full_table_name, column_name, data_type) of the tables of a catalog database; a driver-side listing."""
    rows = []
    for t in spark.catalog.listTables(database):
        name = ".".join(p for p in ((t.namespace or [None])[-1], t.name) if p)
        rows += [(name.upper(), c.name, c.dataType.upper()) for c in spark.catalog.listColumns(name)]
    return spark.createDataFrame(rows, "full_table_name string, column_name string, data_type string")


def tables_of(spark: SparkSession, databases: list[str]) -> DataFrame:
    rows = [((t.namespace or [""])[-1], t.name, t.tableType) for d in databases for t in spark.catalog.listTables(d)]
    return spark.createDataFrame(rows, "schema_name string, table_name string, table_type string")


def deduplicated(df: DataFrame, key: str, newest: str) -> DataFrame:
    """One row per key, the newest."""
    order = W.partitionBy(key).orderBy(F.col(newest).desc_nulls_last())
    return df.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def export_csv(
    df: DataFrame,
    path: str,
    timestamp: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
    dedup_by: str | None = None,
    exclude: tuple[str, ...] = (),
) -> None:
    """Rows from since up to until as CSV with a header, on request one per key."""
    if timestamp and since is not None:
        df = df.where(F.col(timestamp) >= F.lit(since).cast("timestamp_ntz"))
    if timestamp and until is not None:
        df = df.where(F.col(timestamp) < F.lit(until).cast("timestamp_ntz"))
    if dedup_by:
        df = deduplicated(df, dedup_by, timestamp or dedup_by)
    # By default CSV cuts instants to milliseconds.
    whole = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    df.drop(*exclude).write.mode("overwrite").options(timestampFormat=whole, timestampNTZFormat=whole).csv(path, header=True)


def without_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
