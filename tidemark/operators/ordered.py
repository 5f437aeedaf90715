"""Numbers and running statistics within keys that may hold very many rows, in two levels.

A window over a key sorts all its rows in one task. Here rows are ordered within (key, chunk), chunks
being ranges of the order, and only the chunks' summaries are ordered within the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import fresh


def number_within(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, name: str, last_first: bool = False) -> DataFrame:
    """df with the row's number within its key. `chunk` must grow with the order, or fall if last_first;
    null chunks come last."""
    (part,) = fresh(df, "part")
    direction = F.col(part).desc_nulls_last() if last_first else F.col(part).asc_nulls_last()
    before = W.partitionBy(*keys).orderBy(direction).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn(part, chunk)
    per = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))
    other = {k: f"_k{i}" for i, k in enumerate([*keys, part])}
    right = per.select(*[F.col(k).alias(n) for k, n in other.items()], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rows = rows.join(right, [F.col(k).eqNullSafe(F.col(n)) for k, n in other.items()]).drop(*other.values())
    inside = W.partitionBy(*keys, part).orderBy(*order)
    return rows.withColumn(name, (F.col("_offset") + F.row_number().over(inside)).cast("int")).drop("_offset", part)


def running_statistics(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str) -> DataFrame:
    """df with training_set_size, training_avg and training_stddev of `value` over its key's rows up to each.

    chunk must be a function of the first order column that grows with it; nulls come first. Sums of
    squares are kept around the key's mean, so that adding chunks up loses no precision.
    """
    v = F.col(value)
    (part,) = fresh(df, "part")
    key = W.partitionBy(*keys)
    before = key.orderBy(F.col(part).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    centre = F.sum("_s").over(key) / F.nullif(F.sum("_n").over(key), F.lit(0))
    spread = F.coalesce("_q", F.lit(0.0)) + F.when(F.col("_n") > 0, F.col("_n") * F.pow(F.col("_s") / F.col("_n") - F.col("_c"), 2)).otherwise(0.0)
    summary = [F.count(v).alias("_n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("_s"), (F.var_pop(v) * F.count(v)).alias("_q")]
    rows = df.withColumn(part, chunk)
    per = rows.groupBy(*keys, part).agg(*summary).withColumn("_c", centre).withColumn("_q", spread)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    other = {k: f"_k{i}" for i, k in enumerate([*keys, part])}
    right = per.select(*[F.col(k).alias(n) for k, n in other.items()], "_c", zero("_n").alias("_pn"), zero("_s").alias("_ps"), zero("_q").alias("_pq"))
    joined = rows.join(right, [F.col(k).eqNullSafe(F.col(n)) for k, n in other.items()]).drop(*other.values())
    inside = W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = joined.select(
        "*",
        F.count(v).over(inside).alias("_rn"),
        F.coalesce(F.avg(v).over(inside), F.lit(0.0)).alias("_rm"),
        F.coalesce(F.var_pop(v).over(inside), F.lit(0.0)).alias("_rv"),
    )
    n = F.col("_pn") + F.col("_rn")
    mean = (F.col("_ps") + F.col("_rn") * F.col("_rm")) / F.nullif(n, F.lit(0))
    around = F.col("_pq") + F.col("_rn") * (F.col("_rv") + F.pow(F.col("_rm") - F.col("_c"), 2))
    out = own.withColumn("training_set_size", n.cast("bigint")).withColumn("training_avg", mean)
    variance = F.greatest((around - n * F.pow(F.col("training_avg") - F.col("_c"), 2)) / (n - 1), F.lit(0.0))
    # What is left of equal values is rounding.
    noise = 1e-28 * F.pow("training_avg", 2)
    out = out.withColumn("training_stddev", F.when(n > 1, F.sqrt(F.when(variance > noise, variance).otherwise(0.0))))
    return out.drop(part, "_c", "_pn", "_ps", "_pq", "_rn", "_rm", "_rv")
