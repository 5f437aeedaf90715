"""Scalar helpers shared by the operators: identifiers and instants written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java whitespace as a class; SQL trim() alone would only take blanks.
_EDGE_SPACE = r"^[\s ]+|[\s ]+$"


def clean_id(c: Column | str) -> Column:
    """Trimmed (any whitespace) and in lower case; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, _EDGE_SPACE, ""))


def utc_instant(c: Column | str) -> Column:
    """Text in any ISO notation to a UTC timestamp without zone; text without offset is UTC.

    Null, blank or unreadable text gives null.
    """
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    has_zone = c.rlike(r"(?i)(z|utc|[+-]\d{2}:?\d{2})$") & c.rlike(r"\d[T ]\d")
    zoned = F.when(has_zone, c).otherwise(F.concat(c, F.lit("Z")))
    local = zoned.try_cast("timestamp").cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def instant_text(c: Column | str) -> Column:
    """`YYYY-MM-DD HH:MM:SS`, cut to whole seconds."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
