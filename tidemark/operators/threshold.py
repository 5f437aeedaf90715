"""Volume threshold: a bucket's rows against those of the bucket before, in percent, with two severities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import DIRECTIONS, ConfigError

SEVERITIES = ("pass", "warn", "error")


def volume_threshold(
    metrics: DataFrame, warn_percent: float = 5, error_percent: float = 10, direction: str = "both", min_row_count: int = 100
) -> DataFrame:
    """(bucket_end, row_count, previous_row_count, percent_change, severity, severity_level) per bucket.

    metrics: (bucket_start, bucket_end, metric_value), stored and new rows of row_count; of a bucket
    given twice the row updated last counts, if metrics has updated_at. A previous bucket with fewer
    than min_row_count rows gives no verdict, nor does the first bucket.
    """
    if direction not in DIRECTIONS:
        raise ConfigError(f"direction must be one of {', '.join(DIRECTIONS)}")
    if not 0 <= warn_percent <= error_percent:
        raise ConfigError("the warning threshold must lie between 0 and the error threshold")
    newest = F.col("updated_at").desc_nulls_last() if "updated_at" in metrics.columns else F.col("metric_value").desc_nulls_last()
    nth = F.row_number().over(W.partitionBy("bucket_end").orderBy(newest, F.col("metric_value").desc_nulls_last()))
    once = metrics.withColumn("_nth", nth).where("_nth = 1")
    # One row per bucket: the window sees as many rows as there are buckets.
    before = F.lag("metric_value").over(W.orderBy("bucket_end"))
    change = F.when((before >= min_row_count) & (before > 0), (F.col("metric_value") - before) / before * 100)
    out = once.select("bucket_start", "bucket_end", F.col("metric_value").alias("row_count"), before.alias("previous_row_count"), F.round(change, 2).alias("percent_change"), change.alias("_change"))
    size = {"both": F.abs("_change"), "spike": F.col("_change"), "drop": -F.col("_change")}[direction]
    level = F.when(size > error_percent, 2).when(size > warn_percent, 1).otherwise(0)
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return out.select("bucket_start", "bucket_end", "row_count", "previous_row_count", "percent_change", names[level].alias("severity"), level.alias("severity_level"))
