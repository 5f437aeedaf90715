"""Irregular readings onto a regular grid; missing cells filled by low-rank factorisation or marked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, join_lookup

#: Monday 1970-01-05 00:00 UTC: periods of any length that divides a week start at multiples from it.
ORIGIN_S = 4 * 86400
#: Periods of one block of the source-by-time matrix; bounds the arrays of one row and one factor.
BLOCK = 4096
#: Time factors held by the driver and sent to the tasks at once (periods of all blocks fitted together).
FACTOR_ROWS = 400_000
#: Rounds of alternating least squares at most, and the share of the error that a round must still take off.
ROUNDS, SETTLED = 12, 0.01
OBSERVED, FILLED, UNSUPPORTED = "observed", "filled", "unsupported"
GRID = "series array<string>, hours int, period bigint, value double, status string"


def cells(
    df: DataFrame, series: list[Column], start: Column, end: Column, value: Column, hours: Column, version: Column
) -> DataFrame:
    """(series, hours, period, value): one row per filled period of a series.

    series: texts that name the source, null equal to null. hours: the series' length is that of most
    of its rows (the shorter one on a tie); series without any length are left out. A row belongs to
    the period that holds the midpoint of start and end; a missing bound is the other one moved by
    the series' length, a row without both is left out. A period's value is the non-null one with the
    latest version (the largest on a tie).
    """
    rows = df.select(
        F.array(*series).alias("series"),
        F.unix_micros(start.cast("timestamp_ntz").cast("timestamp")).alias("start"),
        F.unix_micros(end.cast("timestamp_ntz").cast("timestamp")).alias("end"),
        value.cast("double").alias("value"),
        F.when(hours > 0, hours).cast("int").alias("hours"),
        version.alias("version"),
    )
    counts = rows.filter("hours IS NOT NULL").groupBy("series", "hours").agg(F.count(F.lit(1)).alias("n"))
    length = cut(counts.groupBy("series").agg(F.max_by("hours", F.struct("n", -F.col("hours"))).alias("hours")))
    known = join_lookup(rows.drop("hours"), length, ["series"])
    step = F.col("hours") * F.lit(3_600_000_000)
    first = F.coalesce("start", F.col("end") - step)
    last = F.coalesce("end", F.col("start") + step)
    middle = first + F.floor((last - first) / 2) - F.lit(ORIGIN_S * 1_000_000)
    return (
        known.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("period", F.floor(middle / step).cast("bigint"))
        .filter(F.col("period").isNotNull())
        .groupBy("series", "hours", "period")
        .agg(F.max_by("value", F.struct("version", "value")).alias("value"))
    )


def blocks(filled: DataFrame) -> DataFrame:
    """(series, hours, block, lo, hi, periods, readings): a row per series and block of BLOCK periods
    between the series' first and last filled one, also where a block holds no reading."""
    some = (
        filled.withColumn("block", F.floor(F.col("period") / BLOCK).cast("bigint"))
        .groupBy("series", "hours", "block")
        .agg(
            F.min("period").alias("lo"),
            F.max("period").alias("hi"),
            F.array_sort(F.collect_list(F.struct("period", "value"))).alias("cells"),
        )
    )
    some = cut(some)
    span = some.groupBy("series", "hours").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    every = span.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK).cast("bigint"), F.floor(F.col("last") / BLOCK).cast("bigint")))
    ).withColumnRenamed("series", "_series")
    on = (F.col("series") == F.col("_series")) & (some["block"] == every["block"])
    joined = every.join(some.drop("hours", "lo", "hi"), on, "left")
    return joined.select(
        F.col("_series").alias("series"),
        "hours",
        every["block"].alias("block"),
        F.greatest("first", every["block"] * BLOCK).alias("lo"),
        F.least("last", every["block"] * BLOCK + (BLOCK - 1)).alias("hi"),
        F.coalesce(F.col("cells.period"), F.expr("CAST(array() AS array<bigint>)")).alias("periods"),
        F.coalesce(F.col("cells.value"), F.expr("CAST(array() AS array<double>)")).alias("readings"),
    )


def _scaled(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Readings centred and scaled robustly and clipped, so that a wild one cannot bend a factor."""
    centre = float(np.median(x))
    spread = float(np.median(np.abs(x - centre))) * 1.4826
    if not spread > 1e-12 * max(1.0, abs(centre)):
        spread = float(np.std(x)) or 1.0
    if not np.isfinite(spread):
        spread = 1.0
    return np.clip((x - centre) / spread, -6, 6), centre, spread


def _source_factor(f: np.ndarray, x: np.ndarray, ridge: float) -> np.ndarray:
    return np.linalg.solve(f.T @ f + ridge * (1 + len(x) / 50) * np.eye(f.shape[1]), f.T @ x)


def fit_time_factors(rows: DataFrame, rank: int = 3, rounds: int = ROUNDS, ridge: float = 1.0, seed: int = 7) -> dict:
    """Alternating least squares over the source-by-time matrices, one matrix per (hours, block).

    Returns {(hours, block): (lowest period, factors[periods, rank], sources per period)}. A round is
    one pass: each task solves its sources' factors from the time factors and adds up the normal
    equations of the periods; only those sums are shuffled, and their totals (periods x rank
    numbers, never more than FACTOR_ROWS periods) come to the driver, which solves the periods. Rounds end
    when the squared error of the scaled readings falls by less than SETTLED of itself, or after `rounds`.
    """
    ranges = {
        (r["hours"], r["block"]): (r["lo"], r["hi"] - r["lo"] + 1)
        for r in rows.filter(F.size("periods") > 0).groupBy("hours", "block").agg(F.min(F.element_at("periods", 1)).alias("lo"), F.max(F.element_at("periods", -1)).alias("hi")).collect()
    }
    rng = np.random.default_rng(seed)
    factors = {k: (lo, rng.normal(size=(n, rank)), np.zeros(n)) for k, (lo, n) in sorted(ranges.items())}
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    width = len(pairs) + rank + 2
    schema = "hours int, block bigint, period bigint, " + ", ".join(f"s{i} double" for i in range(width))
    spark = rows.sparkSession

    before = np.inf
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast({k: (lo, f) for k, (lo, f, _n) in factors.items()})

        def sums(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total: dict = {}
            for batch in batches:
                for hours, block, periods, readings in zip(batch["hours"], batch["block"], batch["periods"], batch["readings"]):
                    if len(readings) <= rank:
                        continue
                    lo, f = shared.value[hours, block]
                    at = np.asarray(periods) - lo
                    x, _, _ = _scaled(np.asarray(readings, dtype=float))
                    u = _source_factor(f[at], x, ridge)
                    row = np.concatenate([[u[i] * u[j] for i, j in pairs], np.zeros(rank), [1.0, 0.0]])
                    add = np.repeat(row[None, :], len(at), axis=0)
                    add[:, len(pairs) : len(pairs) + rank] = x[:, None] * u[None, :]
                    add[:, -1] = (x - f[at] @ u) ** 2
                    key = (hours, block)
                    if key not in total:
                        total[key] = np.zeros((len(f), width))
                    total[key][at] += add
            for (hours, block), sums_ in total.items():
                lo = shared.value[hours, block][0]
                at = np.flatnonzero(sums_[:, -2])
                out = pd.DataFrame(sums_[at], columns=[f"s{i}" for i in range(width)])
                out.insert(0, "period", at + lo)
                out.insert(0, "block", block)
                out.insert(0, "hours", np.int32(hours))
                yield out

        added = (
            rows.select("hours", "block", "periods", "readings")
            .mapInPandas(sums, schema)
            .groupBy("hours", "block", "period")
            .agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
            .toPandas()
        )
        for (hours, block), part in added.groupby(["hours", "block"]):
            lo, f, n = factors[hours, block]
            at = part["period"].to_numpy() - lo
            s = part[[f"s{i}" for i in range(width)]].to_numpy()
            a = np.zeros((len(at), rank, rank))
            for k, (i, j) in enumerate(pairs):
                a[:, i, j] = a[:, j, i] = s[:, k]
            a += ridge * 0.1 * np.eye(rank)
            f = np.zeros_like(f)
            f[at] = np.linalg.solve(a, s[:, len(pairs) : len(pairs) + rank, None])[:, :, 0]
            n = np.zeros_like(n)
            n[at] = s[:, -2]
            factors[hours, block] = (lo, f, n)
        shared.unpersist()
        error = float(added[f"s{width - 1}"].sum())
        if before - error < SETTLED * before:
            break
        before = error
    return factors


def regular_grid(
    filled: DataFrame, statuses: tuple[str, ...] = (OBSERVED, FILLED, UNSUPPORTED), rank: int = 3, rounds: int = ROUNDS, support: int = 4
) -> DataFrame:
    """(series, hours, period, value, status) for every period between a series' first and last filled one.

    filled: (series, hours, period, value), one row per filled period, from cells(). Observed cells
    keep their exact value. Missing cells are filled from the low-rank model of the matrix of all
    series with the same length if at least `support` sources have the period and the series has at
    least 2 x rank readings in the block; others are 'unsupported' with a null value. `statuses`
    picks the cells to return. An empty input gives an empty grid.

    Matrices are cut into blocks of BLOCK periods, so no row or task holds more than a block of a
    source; blocks are fitted together up to FACTOR_ROWS periods, in several groups beyond that.
    """
    rows = cut(blocks(filled))
    sizes = (
        rows.groupBy("hours", "block").agg((F.max("hi") - F.min("lo") + 1).alias("n")).orderBy("hours", "block").collect()
    )
    groups: list[list] = [[]]
    used = 0
    for r in sizes:
        if groups[-1] and used + r["n"] > FACTOR_ROWS:
            groups.append([])
            used = 0
        groups[-1].append((r["hours"], r["block"]))
        used += r["n"]
    out = None
    for group in groups:
        mine = rows
        if len(groups) > 1:
            lows, highs = min(group), max(group)
            spot = F.struct("hours", "block")
            as_struct = lambda k: F.struct(F.lit(k[0]).cast("int").alias("hours"), F.lit(k[1]).cast("bigint").alias("block"))
            mine = rows.filter((spot >= as_struct(lows)) & (spot <= as_struct(highs)))
        part = _expand(mine, fit_time_factors(mine, rank, rounds), statuses, rank, support)
        out = part if out is None else out.unionByName(part)
    return out


def _expand(rows: DataFrame, factors: dict, statuses: tuple[str, ...], rank: int, support: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(factors)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for series, hours, block, lo, hi, periods, readings in zip(*[batch[c] for c in ("series", "hours", "block", "lo", "hi", "periods", "readings")]):
                n = int(hi - lo + 1)
                value, status = np.full(n, np.nan), np.full(n, UNSUPPORTED, dtype=object)
                at, x = np.asarray(periods, dtype=np.int64), np.asarray(readings, dtype=float)
                if len(x) >= 2 * rank and (hours, block) in shared.value:
                    base, f, seen = shared.value[hours, block]
                    scaled, centre, spread = _scaled(x)
                    u = _source_factor(f[at - base], scaled, 1.0)
                    spots = np.arange(lo, hi + 1) - base
                    ok = (spots >= 0) & (spots < len(f))
                    ok[ok] = seen[spots[ok]] >= support
                    value[ok] = centre + spread * (f[spots[ok]] @ u)
                    status[ok] = FILLED
                value[at - lo], status[at - lo] = x, OBSERVED
                keep = np.flatnonzero(np.isin(status, statuses))
                if len(keep):
                    parts.append(
                        pd.DataFrame({"series": [series] * len(keep), "hours": np.int32(hours), "period": keep + lo, "value": value[keep], "status": status[keep]})
                    )
                if sum(map(len, parts)) > 20_000:
                    yield _nulls(pd.concat(parts))
                    parts = []
            if parts:
                yield _nulls(pd.concat(parts))

    return rows.mapInPandas(emit, GRID)


def _nulls(out: pd.DataFrame) -> pd.DataFrame:
    return out.assign(value=out["value"].astype(object).where(out["value"].notna(), None))


def period_start(hours: Column, period: Column) -> Column:
    """The period's first instant, as a UTC timestamp without zone."""
    since = F.make_dt_interval(F.lit(0), (period * hours + F.lit(ORIGIN_S // 3600)).cast("int"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since
