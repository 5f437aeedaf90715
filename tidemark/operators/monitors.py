"""The monitors of a column by its kind, as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the monitors, and which run by default.
TABLE_MONITORS = ("row_count", "freshness", "event_freshness")
ANY_TYPE = ("null_count", "null_percent", "not_null_percent")
STRING = ("min_length", "max_length", "average_length", "missing_count", "missing_percent", "not_missing_percent")
NUMERIC = ("min", "max", "zero_count", "zero_percent", "not_zero_percent", "average", "standard_deviation", "variance", "sum")
BOOLEAN = ("count_true", "count_false")
NOT_BY_DEFAULT = ("not_null_percent", "not_missing_percent", "not_zero_percent", "sum")
ALL_COLUMN_MONITORS = ANY_TYPE + STRING + NUMERIC + BOOLEAN


def kind(data_type: T.DataType) -> str:
    """string, numeric, timestamp, boolean or other."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return "other"


def for_column(data_type: T.DataType, asked: list[str] | None = None) -> list[str]:
    """The monitors to run on a column: those asked for, else the defaults, as far as its kind has them."""
    own = {"string": STRING, "numeric": NUMERIC, "boolean": BOOLEAN}.get(kind(data_type), ())
    have = ANY_TYPE + own
    return [m for m in (asked or [m for m in have if m not in NOT_BY_DEFAULT]) if m in have]


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole with three decimals; null where whole is 0."""
    share = part.cast("double") * 100 / F.nullif(whole, F.lit(0)).cast("double")
    return F.round(share, 3)


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def aggregate(monitor: str, c: Column) -> Column:
    """The monitor's value over a group of rows, as a double."""
    n = F.count(F.lit(1))
    text = c.cast("string")
    missing = c.isNull() | (F.trim(text) == "") | (F.lower(text) == "null")
    zero = c.isNull() | (c.cast("double") == 0)
    counts = {"null": c.isNull(), "missing": missing, "zero": zero}
    name, _, what = monitor.rpartition("_")
    inverse = name.startswith("not_")
    if what in ("count", "percent") and name.removeprefix("not_") in counts:
        part = _sum(counts[name.removeprefix("not_")])
        if what == "count":
            return part.cast("double")
        share = percent(part, n)
        return F.round(100 - share, 3) if inverse else share
    number = c.cast("double")
    out = {
        "min_length": lambda: F.min(F.length(text)),
        "max_length": lambda: F.max(F.length(text)),
        "average_length": lambda: F.avg(F.length(text)),
        "min": lambda: F.min(number),
        "max": lambda: F.max(number),
        "average": lambda: F.avg(number),
        "sum": lambda: F.sum(number),
        "standard_deviation": lambda: F.stddev_samp(number),
        "variance": lambda: F.var_samp(number),
        "count_true": lambda: F.count_if(c.cast("boolean")),
        "count_false": lambda: F.count_if(~c.cast("boolean")),
    }[monitor]
    return out().cast("double")
