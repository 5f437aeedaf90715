"""Two-level numbers and running statistics against plain windows."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordered import number_within, running_statistics

T0 = datetime(2024, 1, 1)


def data(spark, n=400):
    rng = np.random.default_rng(0)
    rows = [(str(rng.integers(3)) if k % 7 else None, T0 + timedelta(hours=int(rng.integers(0, 240))) if k % 11 else None, k, float(1e6 + rng.normal()) if k % 5 else None) for k in range(n)]
    return spark.createDataFrame(rows, "k string, at timestamp_ntz, id int, v double")


def test_running_statistics(spark):
    df = data(spark).where("at IS NOT NULL")
    got = running_statistics(df, ["k"], ["at", "id"], F.date_trunc("DAY", "at").cast("timestamp_ntz"), "v").toPandas().sort_values("id")
    w = W.partitionBy("k").orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("*", F.count("v").over(w).alias("n"), F.avg("v").over(w).alias("m"), F.stddev_samp("v").over(w).alias("s")).toPandas().sort_values("id")
    assert (got["training_set_size"].to_numpy() == want["n"].to_numpy()).all()
    assert np.allclose(got["training_avg"], want["m"], equal_nan=True)
    assert np.allclose(got["training_stddev"].astype(float), want["s"].astype(float), rtol=1e-6, equal_nan=True)


def test_running_statistics_of_equal_values(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 40000).cast("timestamp_ntz").alias("at"), F.lit(0.1).alias("v"))
    out = running_statistics(df, ["k"], ["at"], F.date_trunc("DAY", "at").cast("timestamp_ntz"), "v")
    assert out.agg(F.max("training_stddev"), F.count_if(F.col("training_stddev").isNull())).first() == (0.0, 1)
    assert running_statistics(df.limit(0), ["k"], ["at"], F.date_trunc("DAY", "at").cast("timestamp_ntz"), "v").count() == 0


def test_number_within_both_ways(spark):
    df = data(spark)
    day = F.to_date("at")
    for last_first in (False, True):
        order = [F.col("at").desc_nulls_last() if last_first else F.col("at").asc_nulls_last(), F.col("id")]
        got = number_within(df, ["k"], order, day, "nth", last_first)
        want = df.withColumn("nth", F.row_number().over(W.partitionBy("k").orderBy(*order)))
        assert sorted(map(tuple, got.select("id", "nth").collect())) == sorted(map(tuple, want.select("id", "nth").collect()))
