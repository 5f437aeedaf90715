"""Anomaly scores: stored history and new metrics against running training windows, and what they mean."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import CheckConfig, RunContext
from tidemark.operators import buckets
from tidemark.operators.metrics import surrogate_key
from tidemark.operators.ordered import running_statistics

SERIES = ["full_table_name", "column_name", "metric_name", "dimension", "dimension_value"]
#: Metrics that can be below zero; of all others the displayed minimum is cut at zero.
SIGNED = ("min", "max", "average", "standard_deviation", "variance", "sum")
#: Metrics of which only a rise is bad.
RISE_ONLY = ("freshness", "event_freshness")


def season(seasonality: str | None) -> Column:
    """What a bucket end has in common with those it is compared with."""
    end = F.col("bucket_end")
    day = F.date_format(end, "EEEE")
    hour = F.hour(end).cast("string")
    if seasonality == "day_of_week":
        return day
    if seasonality == "hour_of_day":
        return hour
    return F.concat(day, hour) if seasonality == "hour_of_week" else F.lit("no_seasonality")


def latest_by_id(metrics: DataFrame) -> DataFrame:
    """Of each metric id the row updated last (then by value, so that ties are settled)."""
    order = W.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("metric_value").desc_nulls_last(), F.col("source_value").desc_nulls_last())
    return metrics.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def training_rows(history: DataFrame | None, fresh: DataFrame, config: CheckConfig, ctx: RunContext) -> DataFrame:
    """History of the same table and properties within the training period, and the new metrics, once each.

    With a timestamp history counts only if its bucket is one of the present grid.
    """
    if history is None:
        return latest_by_id(fresh)
    start, _ = buckets.regular_range(config, ctx)
    old = history.where(
        (F.upper("full_table_name") == config.table.full_name)
        & (F.col("metric_properties") == config.metric_properties)
        & (F.col("bucket_end") > F.lit(start).cast("timestamp_ntz"))
    )
    if config.timestamp_column:
        on_grid = buckets.bucket_start(F.col("bucket_start"), start, config.time_bucket) == F.col("bucket_start")
        old = old.where(on_grid & (buckets.bucket_end(F.col("bucket_start"), config.time_bucket) == F.col("bucket_end")))
    return latest_by_id(old.select(fresh.columns).unionByName(fresh))


def anomaly_scores(rows: DataFrame, config: CheckConfig, ctx: RunContext) -> DataFrame:
    """Score and limits of each metric row from its series' (and season's) values up to it, itself included.

    A series is a table, column, metric and dimension value; its rows are one per bucket, so a window
    sees what one source has in the training period, never a whole table.
    """
    if config.anomaly_exclude_metrics:
        own = {"metric_date": "CAST(bucket_end AS date)", "metric_time_bucket": "bucket_end"}
        helped = rows.select("*", *[F.expr(e).alias(n) for n, e in own.items()])
        rows = helped.where(~F.coalesce(F.expr(config.anomaly_exclude_metrics), F.lit(False))).drop(*own)
    rows = rows.withColumn("bucket_seasonality", season(config.seasonality))
    series = SERIES + (["bucket_seasonality"] if config.seasonality else [])
    window = W.partitionBy(*series).orderBy("bucket_end").rowsBetween(W.unboundedPreceding, 0)
    trained = F.col("metric_value")
    ends = F.col("bucket_end")
    if config.exclude_detection_period_from_training:
        inside = F.col("bucket_end") <= F.lit(_boundary(config, ctx)).cast("timestamp_ntz")
        trained = F.when(inside, trained)
        ends = F.when(inside, ends)
    windowed = rows.select(
        "*",
        F.avg(trained).over(window).alias("training_avg"),
        F.stddev_samp(trained).over(window).alias("training_stddev"),
        F.count(trained).over(window).alias("training_set_size"),
        # Null where the row itself (the first row) is outside the training period.
        F.last(ends).over(window).alias("training_end"),
        F.first(ends).over(window).alias("training_start"),
    ).where("metric_value IS NOT NULL AND training_avg IS NOT NULL")
    v, avg, sd, n = (F.col(c) for c in ("metric_value", "training_avg", "training_stddev", "training_set_size"))
    score = F.when(sd.isNull() | (n == 1), F.lit(None).cast("double")).when(sd == 0, F.lit(0.0)).otherwise((v - avg) / sd)
    s = F.lit(float(config.anomaly_sensitivity))
    low, high = avg - s * sd, avg + s * sd
    if config.drop_percent is not None:
        low = F.least(low, (1 - config.drop_percent / 100) * avg)
    if config.spike_percent is not None:
        high = F.greatest(high, (1 + config.spike_percent / 100) * avg)
    low = F.when((low > 0) | F.col("metric_type").isin(*SIGNED), low).when(low.isNull(), low).otherwise(F.lit(0.0))
    return windowed.select(
        surrogate_key(F.col("id"), F.lit(ctx.execution_id)).alias("id"),
        F.col("id").alias("metric_id"),
        F.lit(ctx.execution_id).alias("test_execution_id"),
        F.lit(ctx.run_started_at).cast("timestamp_ntz").alias("detected_at"),
        "full_table_name",
        "column_name",
        "metric_name",
        "metric_type",
        score.alias("anomaly_score"),
        s.alias("anomaly_score_threshold"),
        F.col("source_value").alias("anomalous_value"),
        "bucket_start",
        "bucket_end",
        "bucket_seasonality",
        "metric_value",
        low.alias("min_metric_value"),
        high.alias("max_metric_value"),
        "training_avg",
        "training_stddev",
        "training_set_size",
        "training_start",
        "training_end",
        "dimension",
        "dimension_value",
    )


def _boundary(config: CheckConfig, ctx: RunContext) -> datetime:
    return buckets.backfill_start(config, ctx)


def directional(config: CheckConfig, metric: Column) -> Column:
    """Whether the score is beyond the sensitivity in a direction that counts."""
    score, s = F.col("anomaly_score"), config.anomaly_sensitivity
    rises, falls = score > s, score < -s
    wanted = {"spike": rises, "drop": falls, "both": rises | falls}[config.anomaly_direction]
    return F.when(metric.isin(*RISE_ONLY), rises).otherwise(wanted)


def large_change(config: CheckConfig) -> Column | None:
    """Whether the change from the average is more than a small one; None where no threshold is set.

    With direction both and both thresholds either change counts; with one threshold only that side's
    can, so the other direction never fires.
    """
    v, avg = F.col("metric_value"), F.col("training_avg")
    rise = v > (1 + (config.spike_percent or 0) / 100) * avg
    fall = v < (1 - (config.drop_percent or 0) / 100) * avg
    spike, drop = config.spike_percent is not None, config.drop_percent is not None
    if config.anomaly_direction == "spike":
        return rise if spike else None
    if config.anomaly_direction == "drop":
        return fall if drop else None
    if spike and drop:
        return rise | fall
    return rise if spike else fall if drop else None


def classify(scores: DataFrame, config: CheckConfig, ctx: RunContext) -> DataFrame:
    """Scores with is_anomalous, a description, and the limits to show next to each value."""
    condition = directional(config, F.col("metric_type"))
    change = large_change(config)
    if change is not None:
        condition = condition & change
    if config.min_value is not None:
        condition = condition & (F.col("metric_value") >= config.min_value)
    if config.fail_on_zero:
        condition = condition | ((F.col("metric_value") == 0) & F.col("anomaly_score").isNotNull())
    recent = F.col("bucket_end") > F.col("max_bucket_end") - F.expr(f"INTERVAL {config.backfill_days} DAY")
    series = W.partitionBy("full_table_name", "column_name", "metric_name", "dimension", "dimension_value", "bucket_seasonality").orderBy("bucket_end")
    # An anomalous value is part of its own limits; those of the bucket before show what was expected. A
    # side on which nothing counts shows the value itself.
    before = lambda c: F.when(F.col("is_anomalous"), F.lag(c).over(series)).otherwise(F.col(c))
    lowest = before("metric_value" if config.anomaly_direction == "spike" else "min_metric_value")
    highest = before("metric_value" if config.anomaly_direction == "drop" else "max_metric_value")
    out = (
        _with_latest(scores)
        .withColumn("is_anomalous", F.coalesce(condition & recent, F.lit(False)))
        .withColumn("anomaly_description", description())
        .withColumn("value", F.col("metric_value"))
        .withColumn("average", F.col("training_avg"))
        .withColumn("min_value", lowest)
        .withColumn("max_value", highest)
        .withColumn("start_time", F.col("bucket_start"))
        .withColumn("end_time", F.col("bucket_end"))
    )
    return out.where(config.exclude_final_results) if config.exclude_final_results else out


def _with_latest(scores: DataFrame) -> DataFrame:
    """scores with max_bucket_end, the last bucket of their run: a sum of one row, not a window over all rows.

    The maximum is taken over whole rows, so that both uses of the scores need the same columns and
    their shuffle (and the scan below it) is computed once.
    """
    first = ["bucket_end", *[c for c in scores.columns if c != "bucket_end"]]
    last = scores.groupBy(F.col("test_execution_id").alias("_run")).agg(F.max(F.struct(*first)).alias("_row"))
    last = F.broadcast(last.select("_run", F.col("_row.bucket_end").alias("max_bucket_end")))
    return scores.join(last, F.col("test_execution_id") == F.col("_run"), "left").drop("_run")


def _number(c: Column, digits: int = 3) -> Column:
    return F.round(c, digits).cast("string")


def description() -> Column:
    """What a score says, in words; ages in hours."""
    hours = lambda c: _number(c / 3600, 2)
    seen = F.when(
        F.col("metric_type") == "freshness",
        F.concat(
            F.lit("Last update was at "),
            F.coalesce("anomalous_value", F.lit("an unknown time")),
            F.lit(", "),
            hours(F.col("metric_value")),
            F.lit(" hours before. Usually updated within "),
            hours(F.col("training_avg")),
            F.lit(" hours."),
        ),
    ).when(
        F.col("dimension").isNotNull() & F.col("column_name").isNull(),
        F.concat(
            F.lit("The last "),
            F.col("metric_name"),
            F.lit(" value for dimension "),
            F.col("dimension"),
            F.lit(" = "),
            F.coalesce("dimension_value", F.lit("NULL")),
            F.lit(" is "),
            _number(F.col("metric_value")),
            F.lit(". The average for this metric is "),
            _number(F.col("training_avg")),
            F.lit("."),
        ),
    ).otherwise(
        F.concat(
            F.when(F.col("column_name").isNotNull(), F.concat(F.lit("In column "), F.col("column_name"), F.lit(", the last "))).otherwise(F.lit("The last ")),
            F.col("metric_name"),
            F.lit(" value is "),
            _number(F.col("metric_value")),
            F.lit(". The average for this metric is "),
            _number(F.col("training_avg")),
            F.lit("."),
        )
    )
    return F.when(F.col("anomaly_score").isNull(), F.lit("Not enough data to calculate anomaly score.")).otherwise(seen)


def anomalous_dimension_rows(df: DataFrame, results: DataFrame, value: Column) -> DataFrame:
    """All rows of a monitored table whose dimension value is anomalous."""
    bad = results.where("is_anomalous AND dimension_value IS NOT NULL").select(F.col("dimension_value").alias("_bad")).distinct()
    return df.join(bad, value == F.col("_bad"), "left_semi")


def stored_scores(metrics: DataFrame, ctx: RunContext, sensitivity: float = 3, days: int = 7) -> DataFrame:
    """Running scores of the stored metrics whose bucket ended in the last days: per table, column and metric
    (not dimension), in order of bucket start (none first), over all stored rows up to each, equal rows once."""
    keep = ["id", "full_table_name", "column_name", "dimension", "dimension_value", "metric_name", "metric_value", "source_value", "bucket_start", "bucket_end", "bucket_duration_hours", "updated_at"]
    keys = ["metric_name", "full_table_name", "column_name"]
    order = ["bucket_start", "id", "updated_at", "metric_value"]
    rows = metrics.select(*keep).distinct()
    # A table's metric may hold a large part of all rows, so it is summed up in days first.
    day = F.date_trunc("DAY", "bucket_start").cast("timestamp_ntz")
    since = F.date_trunc("DAY", F.lit(ctx.run_started_at).cast("timestamp_ntz")).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAY")
    scored = running_statistics(rows, keys, order, day, "metric_value")
    scored = scored.where("metric_value IS NOT NULL AND training_avg IS NOT NULL").where(F.col("bucket_end") >= since)
    started = rows.groupBy(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)]).agg(F.min_by("bucket_end", F.struct(*order)).alias("training_start"))
    scored = scored.join(started, [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]).drop(*[f"_s{i}" for i in range(len(keys))])
    v = F.col("metric_value")
    sd = F.col("training_stddev")
    score = F.when(sd.isNull(), F.lit(None).cast("double")).when(sd == 0, 0.0).otherwise((v - F.col("training_avg")) / sd)
    scored = scored.withColumn("anomaly_score", score).withColumn("training_end", F.col("bucket_end"))
    return scored.withColumn("is_anomaly", F.coalesce(F.abs("anomaly_score") > sensitivity, F.lit(False)))


def threshold_sensitivity(scores: DataFrame, levels: tuple[float, ...] = (1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5)) -> DataFrame:
    """Which scores would be anomalies at other sensitivities."""
    flags = [F.coalesce(F.abs("anomaly_score") >= level, F.lit(False)).alias("is_anomaly_" + str(level).replace(".", "_")) for level in levels]
    return scores.select("full_table_name", "column_name", "metric_name", "bucket_end", "metric_value", "training_avg", "anomaly_score", *flags)


