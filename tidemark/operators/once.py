"""Messages delivered more than once: keep one copy of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import fresh


def keep_one(df: DataFrame, identifier: Column, arrival: list[Column]) -> DataFrame:
    """One row per identifier: the first in the order `arrival`, ties broken by the whole row's content.

    identifier: null rows cannot be shown to be copies and are all kept, with copies = 1.
    arrival: sort columns, best first (for "the latest" give a descending one).
    Adds `copies`, the number of rows of the identifier (a column of that name is replaced).
    Repeated rows that are equal in every column count as copies; any of them is the same row.
    An empty table gives an empty result.

    The filter on row_number is pushed below the shuffle by Spark (a group limit per task), so a
    task sends one row per identifier, however many an identifier has; the copies are counted by a
    map-side combined aggregate, and both sides meet on the partitioning they already have.
    """
    df = df.drop("copies")
    key, nth, other = fresh(df, "key", "nth", "other")
    tie = [F.col(f"`{c}`").cast("string").asc_nulls_last() for c in df.columns if _orderable(df, c)]
    keyed = df.withColumn(key, identifier)
    some = keyed.filter(F.col(key).isNotNull())
    order = W.partitionBy(key).orderBy(*arrival, *tie)
    first = some.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1).drop(nth)
    counts = some.groupBy(F.col(key).alias(other)).agg(F.count(F.lit(1)).alias("copies"))
    kept = first.join(counts.hint("merge"), F.col(key) == F.col(other)).drop(key, other)
    rest = keyed.filter(F.col(key).isNull()).drop(key).withColumn("copies", F.lit(1).cast("bigint"))
    return kept.unionByName(rest)


def new_only(batch: DataFrame, identifier: Column, stored: DataFrame, stored_identifier: Column, arrival: list[Column]) -> DataFrame:
    """The messages of a batch that are not stored yet, each once (columns of the batch).

    Rows without identifier are kept. The batch is reduced to one row per identifier first, and the
    stored side to its distinct identifiers, so that no hot identifier meets itself in the anti-join.
    """
    once = keep_one(batch, identifier, arrival).drop("copies")
    key, other = fresh(batch, "key", "stored")
    known = stored.select(stored_identifier.alias(other)).filter(F.col(other).isNotNull()).distinct()
    return once.withColumn(key, identifier).join(known, F.col(key) == F.col(other), "left_anti").drop(key)


def _orderable(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType.typeName()
    return kind not in ("map", "variant", "struct", "array")
