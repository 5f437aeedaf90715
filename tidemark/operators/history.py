"""History of changing attributes: versions with the period in which each was valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut


def name_set(c: Column) -> Column:
    """A JSON list of names as a canonical text: trimmed, lower case, distinct, sorted; null stays null.

    Text that is no JSON list is taken as names separated by commas; the empty list is '[]'.
    """
    listed = F.from_json(c, "array<string>")
    names = F.when(listed.isNotNull(), listed).otherwise(F.split(c, ","))
    tidy = F.transform(names, lambda n: F.lower(F.trim(n)))
    kept = F.array_sort(F.array_distinct(F.filter(tidy, lambda n: n.isNotNull() & (n != ""))))
    return F.when(c.isNotNull(), F.to_json(kept))


def observations(df: DataFrame, key: Column, at: Column, attributes: dict[str, Column]) -> DataFrame:
    """(key, at, *attributes) of the rows that have a key and an instant, repeated rows once."""
    return (
        df.select(key.alias("key"), at.alias("at"), *[c.alias(n) for n, c in attributes.items()])
        .filter(F.col("key").isNotNull() & F.col("at").isNotNull())
        .distinct()
    )


def ordered_states(seen: DataFrame, names: list[str], chunk: str = "MONTH") -> DataFrame:
    """(key, at, seq, *names): observations numbered within their key, with nulls replaced by the last known value.

    Done in two levels, so that a key with very many rows is not sorted in one task: rows are ordered
    within (key, calendar chunk), and only the chunks' summaries are ordered within the key.
    Ties of instant are ordered by the attributes, nulls first.
    """
    part = ["key", "chunk"]
    order = W.partitionBy(*part).orderBy("at", *[F.col(n).asc_nulls_first() for n in names])
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    # The filter is always true; said here, both uses of the windows below are one plan and are computed once.
    chunked = seen.withColumn("chunk", F.date_trunc(chunk, "at").cast("timestamp_ntz")).filter("key IS NOT NULL AND chunk IS NOT NULL")
    filled = chunked.select(
        *part, "at", F.row_number().over(order).alias("place"), *[F.last(n, ignorenulls=True).over(so_far).alias(n) for n in names]
    )
    summary = filled.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n"), *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("place"))).alias(f"last_{n}") for n in names]
    )
    before = W.partitionBy("key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        F.col("key").alias("_key"),
        F.col("chunk").alias("_chunk"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        *[F.last(f"last_{n}", ignorenulls=True).over(before).alias(f"carry_{n}") for n in names],
    )
    joined = filled.join(carried.hint("merge"), (F.col("key") == F.col("_key")) & (F.col("chunk") == F.col("_chunk")))
    return joined.select("key", "at", (F.col("offset") + F.col("place")).alias("seq"), *[F.coalesce(n, f"carry_{n}").alias(n) for n in names])


def change_events(states: DataFrame, names: list[str], as_of: Column | None = None) -> DataFrame:
    """(key, seq, at, change, *names): inserted, changed and deleted, by a null-safe full outer join of
    each state with the one before it (key and number, so that a hot key is spread over all tasks).

    A key is 'deleted' at its last state if that lies before `as_of`; without as_of no key is. What the
    join finds equal to the state before is no event. Pass states that were cut(), as both sides read them.
    """
    now = states.select(*[F.col(c).alias(f"n_{c}") for c in states.columns])
    was = states.select(*[F.col(c).alias(f"w_{c}") for c in states.columns]).withColumn("w_seq", F.col("w_seq") + 1)
    both = now.join(was, F.col("n_key").eqNullSafe(F.col("w_key")) & F.col("n_seq").eqNullSafe(F.col("w_seq")), "full_outer")
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"n_{n}").eqNullSafe(F.col(f"w_{n}"))
    gone = F.lit(False) if as_of is None else F.col("w_at") < as_of
    change = (
        F.when(F.col("w_key").isNull(), "inserted")
        .when(F.col("n_key").isNull() & gone, "deleted")
        .when(F.col("n_key").isNotNull() & ~same, "changed")
    )
    return both.select(
        F.coalesce("n_key", "w_key").alias("key"),
        F.coalesce("n_seq", "w_seq").alias("seq"),
        F.coalesce("n_at", "w_at").alias("at"),
        change.alias("change"),
        *[F.coalesce(f"n_{n}", f"w_{n}").alias(n) for n in names],
    ).filter(F.col("change").isNotNull())


def versions(events: DataFrame, names: list[str], chunk: str = "MONTH") -> DataFrame:
    """(key, *names, valid_from, valid_to) of inserted and changed events; valid_to null: still valid.

    lead is taken within (key, chunk); the last event of a chunk takes the first one of the key's next
    chunk, so no key's whole history has to pass through one task.
    """
    begun = events.filter(F.col("change").isin("inserted", "changed")).withColumn(
        "chunk", F.date_trunc(chunk, "at").cast("timestamp_ntz")
    )
    firsts = begun.groupBy("key", "chunk").agg(F.min("at").alias("first"))
    after = firsts.select(
        F.col("key").alias("_key"),
        F.col("chunk").alias("_chunk"),
        F.lead("first").over(W.partitionBy("key").orderBy("chunk")).alias("after"),
    )
    joined = begun.join(after, (F.col("key") == F.col("_key")) & (F.col("chunk") == F.col("_chunk")))
    order = W.partitionBy("key", "chunk").orderBy("seq")
    return joined.select(
        "key", *names, F.col("at").alias("valid_from"), F.coalesce(F.lead("at").over(order), F.col("after")).alias("valid_to")
    )


def attribute_events(df: DataFrame, key: Column, at: Column, attributes: dict[str, Column], as_of: Column | None = None) -> DataFrame:
    """(key, seq, at, change, *attributes) of all changes; rows and nulls as in attribute_history()."""
    names = list(attributes)
    return change_events(cut(ordered_states(observations(df, key, at, attributes), names)), names, as_of)


def attribute_history(df: DataFrame, key: Column, at: Column, attributes: dict[str, Column]) -> DataFrame:
    """(key, *attributes, valid_from, valid_to) of every version of every key.

    Rows of a key are ordered by `at`; a null attribute says nothing and leaves the earlier value; a
    version begins at the key's first row and at each row whose attributes differ from the row
    before, and ends where the next begins (valid_to null for the last). Rows without key or instant
    are left out; an empty table gives an empty result; other columns of df do not matter.
    """
    return versions(attribute_events(df, key, at, attributes), list(attributes))
