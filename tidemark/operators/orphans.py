"""References to records that do not exist, from signed change deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEDGER = ["target", "key", "at"]


def reference_deltas(df: DataFrame) -> DataFrame:
    """(target, key, at, delta) of references that came (+1) or were withdrawn (-1); null or blank keys are none."""
    return df.select(*LEDGER, "delta").filter(F.col("key").isNotNull() & (F.col("key") != "") & (F.col("delta") != 0))


def existence_deltas(intervals: DataFrame, delta: int = 1) -> DataFrame:
    """(target, key, at, delta) from (target, key, first, last): +1 when a record appears, -1 after it went.

    Each interval counts for itself, so a key may go and come again, and several records may share one; a null first
    means always, a null last never ends. delta = -1 takes intervals back that were counted before.
    """
    moves = F.array(
        F.struct(F.col("first").alias("at"), F.lit(delta).alias("delta")),
        F.struct(F.expr("timestampadd(MICROSECOND, 1, last)").alias("at"), F.lit(-delta).alias("delta")),
    )
    return (
        intervals.filter(F.col("key").isNotNull() & (F.col("key") != ""))
        .select("target", "key", F.posexplode(moves).alias("nth", "move"))
        .filter((F.col("nth") == 0) | F.col("move.at").isNotNull())
        .select("target", "key", "move.at", "move.delta")
    )


def apply_deltas(state: DataFrame | None, references: DataFrame, existence: DataFrame) -> DataFrame:
    """The ledger (target, key, at, refs, records) after a batch of change deltas.

    `refs` and `records` are signed counts of the changes at that instant; rows that cancel out
    vanish. Deltas may come in any order and batches in any grouping; the ledger is the same.
    One shuffle with map-side sums, so a hot key's deltas are added up where they are read.
    """
    rows = references.select(*LEDGER, F.col("delta").alias("refs"), F.lit(0).alias("records")).unionByName(
        existence.select(*LEDGER, F.lit(0).alias("refs"), F.col("delta").alias("records"))
    )
    if state is not None:
        rows = rows.unionByName(state)
    return (
        rows.groupBy(*LEDGER)
        .agg(F.sum("refs").cast("bigint").alias("refs"), F.sum("records").cast("bigint").alias("records"))
        .filter((F.col("refs") != 0) | (F.col("records") != 0))
    )


def orphans(ledger: DataFrame) -> DataFrame:
    """(target, key, at, refs, seen): references whose target has no record at their instant.

    A row is an orphan if refs > 0 and the existence counts of its key up to `at` add up to zero or
    less. `seen` says whether the key ever has a record. A null `at` asks whether the key has any
    record at all. Counts run in two levels: within (key, month) row by row, and over the months'
    sums, so a key that holds very many instants is spread over its months.
    """
    # A plain number, not a null, for what has no instant, so that rows already lie where the join needs them.
    rows = ledger.withColumn("_month", F.coalesce(F.year("at") * 12 + F.month("at"), F.lit(-1)))
    part = ["target", "key", "_month"]
    key = W.partitionBy("_target", "_key")
    per = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in part]).agg(F.sum("records").alias("_n"), F.max(F.col("records") > 0).alias("_has"))
    earlier = key.orderBy("__month").rowsBetween(W.unboundedPreceding, -1)
    carried = per.select("_target", "_key", "__month", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.max("_has").over(key).alias("seen"))
    on = [F.col(c) == F.col(f"_{c}") for c in part]
    inside = W.partitionBy(*part).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    counted = rows.join(carried.hint("merge"), on).withColumn("_alive", F.col("_before") + F.sum("records").over(inside))
    alive = F.when(F.col("at").isNull(), F.col("seen").cast("bigint")).otherwise(F.col("_alive"))
    return counted.filter((F.col("refs") > 0) & (alive <= 0)).select(*LEDGER, "refs", "seen")


def current_orphans(ledger: DataFrame, now: Column | None = None) -> DataFrame:
    """(target, key, refs, seen): keys with more references than were withdrawn and no record up to now (or ever).

    The report of a ledger whose references have no instant of their own: a sum per key.
    """
    due = F.lit(True) if now is None else F.col("at").isNull() | (F.col("at") <= now)
    sums = ledger.groupBy("target", "key").agg(
        F.sum(F.when(due, F.col("refs"))).alias("refs"),
        F.sum(F.when(due, F.col("records"))).alias("_records"),
        F.max(F.col("records") > 0).alias("seen"),
    )
    return sums.filter((F.col("refs") > 0) & (F.coalesce("_records", F.lit(0)) <= 0)).select("target", "key", "refs", "seen")
