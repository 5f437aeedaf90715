"""Scalar functions of the monitoring vocabulary, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.metrics import surrogate_key
from tidemark.operators.monitors import percent

TYPES = {
    "timestamp": "timestamp_ntz",
    "date": "date",
    "float": "double",
    "numeric": "decimal(28,6)",
    "int": "int",
    "bigint": "bigint",
    "string": "string",
    "long_string": "string",
    "bool": "boolean",
    "boolean": "boolean",
}


def cast(c: Column, kind: str) -> Column:
    return c.cast(TYPES[kind])


def safe_cast(c: Column, kind: str) -> Column:
    """Null where the value cannot be cast."""
    return c.try_cast(TYPES[kind])


def null_of(kind: str) -> Column:
    return F.lit(None).cast(TYPES[kind])


def text_literal(value) -> Column:
    return F.lit(None if value is None else str(value)).cast("string")


def date_trunc(unit: str, c: Column) -> Column:
    """Start of the unit, without zone."""
    return F.date_trunc(unit, c.cast("timestamp_ntz")).cast("timestamp_ntz")


def date_add(unit: str, n: Column | int, c: Column) -> Column:
    return F.timestamp_add(unit.upper(), F.lit(n) if isinstance(n, int) else n, c.cast("timestamp_ntz"))


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Whole units from start to end: dates for days, calendar months and Monday weeks by boundaries, elapsed
    seconds (cut towards zero) for hours and less."""
    start, end = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    if unit == "day":
        return F.date_diff(end, start)
    if unit == "week":
        return (F.date_diff(F.date_trunc("week", end), F.date_trunc("week", start)) / 7).cast("int")
    if unit in ("month", "quarter", "year"):
        months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
        return months if unit == "month" else (F.year(end) - F.year(start)) * 4 + F.quarter(end) - F.quarter(start) if unit == "quarter" else F.year(end) - F.year(start)
    return F.timestamp_diff(unit.upper(), start, end)


def day_of_week(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def hour_of_day(c: Column) -> Column:
    return F.hour(c)


def hour_of_week(c: Column) -> Column:
    return F.concat(day_of_week(c), F.hour(c).cast("string"))


def to_char(c: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(c, pattern)


def contains(c: Column, part: str, case_sensitive: bool = False) -> Column:
    return F.contains(c, F.lit(part)) if case_sensitive else F.contains(F.lower(c), F.lit(part.lower()))


def joined(columns: list[Column], separator: str = "; ") -> Column:
    """Values joined; null as the text NULL."""
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("NULL")) for c in columns])


def full_table_name(database: Column | None, schema: Column, table: Column) -> Column:
    return F.upper(F.concat_ws(".", *([database] if database is not None else []), schema, table))


def full_column_name(table: Column, column: Column) -> Column:
    return F.concat(F.upper(table), F.lit("."), F.upper(column))


def name_part(name: Column, part: str) -> Column:
    """The database, schema or table of a full table name of two or three parts."""
    back = {"table": -1, "schema": -2, "database": -3}[part]
    pieces = F.split(name, r"\.")
    return F.when(F.size(pieces) >= -back, F.element_at(pieces, back))


def not_percent(part: Column, whole: Column) -> Column:
    return F.round(100 - percent(part, whole), 3)


def arithmetic_min(a: Column, b: Column) -> Column:
    """The lesser; null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def arithmetic_max(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_false(c: Column) -> Column:
    return F.coalesce(~c, F.lit(False))


def settled_stddev(sd: Column, avg: Column) -> Column:
    """A standard deviation that is only rounding noise counts as 0."""
    return F.when(sd < 1e-9 * F.greatest(F.lit(1.0), F.abs(avg)), F.lit(0.0)).otherwise(sd)


