"""Implausible readings: physical limits, stuck runs and spikes, per source and relative to its own behaviour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.regular_grid import ORIGIN_S
from tidemark.session import cut, join_lookup

#: Readings that one task step judges of a source at least (a source of fewer than twice as many is judged whole),
#: and about how many it sees beyond either end.
CHUNK, HALO = 4096, 256
#: Equal successive readings that make a stuck run.
STUCK = 6
#: Neighbours normally differ where readings outside such runs are at least this share of all, and at most that share
#: of them equals the one before.
VARIED, REPEATED = 0.4, 0.3
#: Scatters from the expected value beyond which a reading is a spike, and the longest excursion in readings.
SPIKE, BACK_WITHIN = 8.0, 3
#: Readings on either side that say what the level is.
SIDE = 9
#: Standard errors by which the levels before and after a reading must differ for a level shift.
SHIFT = 4.0
LIMIT, RUN, JUMP = "limit", "stuck", "spike"
FLAGGED = "id string, kind string"
COUNTED = "g1 bigint, g2 bigint, n bigint, varied bigint, repeated bigint"


def limits(metric: Column) -> tuple[Column, Column]:
    """The least and greatest value that a metric can take, by its type's name; null where it has none."""
    name = F.lower(F.coalesce(metric, F.lit("")))
    percent = name.rlike("percent")
    counted = name.rlike(r"count|length|freshness|deviation|variance|duration|^dimension")
    return F.when(percent | counted, F.lit(0.0)), F.when(percent, F.lit(100.0))


def implausible(
    df: DataFrame,
    identifier: Column,
    series: list[Column],
    start: Column,
    at: Column,
    hours: Column,
    value: Column,
    version: Column,
    metric: Column,
) -> DataFrame:
    """(id, kind) of the readings that are wrong for their series; kind is 'limit', 'stuck' or 'spike'.

    Of each id only the row with the latest version and a value counts (the larger value on a tie).
    A series is a tuple of texts, null equal to null; its readings are ordered by `at`, then id;
    `hours` is its bucket length (that of most of its readings; a day where none has one). A reading's
    place in the rhythm is the period that holds the midpoint of start and `at`; a null start is `at`
    minus the bucket length. Rows without id, value (null, NaN) or `at` are no readings. A series with fewer than
    2 x SIDE readings has no spikes, only limits and stuck runs. An empty table gives an empty result.

    The table is read once: rows are reduced to one per id by a map-side combined aggregate and kept
    in a written table, from which come the series' lengths and the readings. A series of 2 x CHUNK
    readings or more is cut into spans of time of about CHUNK readings, with about HALO of its neighbours
    on both sides, so a source that holds a third of all rows is spread over many steps; within a
    partition the sorted readings are streamed and one span is held at a time. Whether a series' neighbours
    normally differ is counted over all its spans first; rhythm, scatter and autoregression are those of the
    span. Readings of one instant are not divided.
    """
    low, high = limits(metric)
    # A series by two hashes: 128 bits, nulls told from texts.
    told = [x for c in series for x in (c.isNull(), c)]
    latest = cut(
        df.select(
            identifier.alias("id"),
            F.xxhash64(*told).alias("g1"),
            F.xxhash64(F.lit("tidemark"), *told).alias("g2"),
            F.unix_micros(at.cast("timestamp_ntz").cast("timestamp")).alias("at"),
            F.unix_micros(start.cast("timestamp_ntz").cast("timestamp")).alias("start"),
            F.when(hours > 0, hours).cast("int").alias("hours"),
            value.cast("double").alias("value"),
            version.alias("version"),
            low.alias("low"),
            high.alias("high"),
        )
        .filter("id IS NOT NULL AND at IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
        .groupBy("id")
        .agg(F.max(F.struct("version", "value", "at", "start", "hours", "low", "high", "g1", "g2")).alias("r"))
        .select("id", "r.at", "r.start", "r.hours", "r.value", "r.low", "r.high", "r.g1", "r.g2")
    )
    sizes = latest.groupBy("g1", "g2", "hours").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    known = F.when(F.col("hours").isNotNull(), F.struct("n", -F.col("hours")))
    spans = sizes.groupBy("g1", "g2").agg(
        F.coalesce(F.max_by("hours", known), F.lit(24)).alias("length"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    parts = F.when(F.col("n") < 2 * CHUNK, F.lit(1)).otherwise(F.floor(F.col("n") / CHUNK)).cast("bigint")
    whole = F.col("last") - F.col("first") + 1
    facts = cut(
        spans.withColumn("parts", parts)
        .withColumn("width", F.ceil(whole / F.col("parts")))
        .withColumn("halo", F.ceil(whole * HALO / F.col("n")))
        .select("g1", "g2", "length", "first", "parts", "width", "halo")
    )
    if facts.filter("parts > 1").isEmpty():
        return _ordered(latest, facts.withColumn("differs", F.lit(None).cast("boolean"))).mapInArrow(_scan, FLAGGED)
    counts = _ordered(latest, facts.filter("parts > 1").withColumn("differs", F.lit(None).cast("boolean"))).mapInArrow(_count, COUNTED)
    long = counts.groupBy("g1", "g2").agg(*[F.sum(c).alias(c) for c in ("n", "varied", "repeated")])
    differs = (F.col("varied") >= VARIED * F.col("n")) & (F.col("repeated") <= REPEATED * F.col("varied"))
    return _ordered(latest, cut(facts.join(long.select("g1", "g2", differs.alias("differs")), ["g1", "g2"], "left"))).mapInArrow(_scan, FLAGGED)


def _ordered(latest: DataFrame, facts: DataFrame) -> DataFrame:
    """The readings of the series in facts, span by span, those of the halo included, in order."""
    rows = join_lookup(latest, facts, ["g1", "g2"])
    step = F.col("length") * F.lit(3_600_000_000)
    begun = F.coalesce("start", F.col("at") - step)
    middle = begun + F.floor((F.col("at") - begun) / 2) - F.lit(ORIGIN_S * 1_000_000)
    spot = lambda t: F.least(F.greatest(F.floor((t - F.col("first")) / F.col("width")), F.lit(0)), F.col("parts") - 1)
    here = spot(F.col("at"))
    spots = F.array_distinct(F.array(here, spot(F.col("at") - F.col("halo")), spot(F.col("at") + F.col("halo"))))
    return (
        rows.withColumn("here", here)
        .withColumn("span", F.explode(spots))
        .select(
            "g1",
            "g2",
            "span",
            "at",
            "id",
            "value",
            F.floor(middle / step).cast("bigint").alias("period"),
            F.col("length").alias("hours"),
            "low",
            "high",
            "differs",
            (F.col("here") == F.col("span")).alias("own"),
        )
        .repartition("g1", "g2", "span")
        .sortWithinPartitions("g1", "g2", "span", "at", "id")
    )


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts of the spans in them and their end); a span is never divided."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        key = np.stack([rows[c].to_numpy() for c in ("g1", "g2", "span")])
        starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
        held = rows.slice(starts[-1]).combine_chunks()
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, starts in _spans(batches):
        value, own = rows["value"].to_numpy(), rows["own"].to_numpy(zero_copy_only=False)
        out = []
        for a, b in zip(starts[:-1], starts[1:]):
            long, repeat = _runs(value[a:b])
            mine = own[a:b]
            out.append((rows["g1"][a].as_py(), rows["g2"][a].as_py(), int(mine.sum()), int((mine & ~long).sum()), int((mine & repeat).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["g1", "g2", "n", "varied", "repeated"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, starts in _spans(batches):
        yield from _judge_all(rows, starts)


def _judge_all(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    period, value, hours = (rows[c].to_numpy() for c in ("period", "value", "hours"))
    low, high = (rows[c].to_numpy(zero_copy_only=False).astype(float) for c in ("low", "high"))
    kind = np.zeros(len(value), dtype=np.int8)
    for a, b in zip(starts[:-1], starts[1:]):
        kind[a:b] = judge(period[a:b], value[a:b], int(hours[a]), low[a:b], high[a:b], rows["differs"][a].as_py())
    at = np.flatnonzero((kind > 0) & rows["own"].to_numpy(zero_copy_only=False))
    if len(at):
        names = np.array(["", LIMIT, RUN, JUMP], dtype=object)[kind[at]]
        yield pa.RecordBatch.from_arrays([rows["id"].combine_chunks().take(pa.array(at)).cast(pa.string()), pa.array(list(names), pa.string())], names=["id", "kind"])


def judge(period: np.ndarray, value: np.ndarray, hours: int, low: np.ndarray, high: np.ndarray, differs: bool | None = None) -> np.ndarray:
    """0 plausible, 1 limit, 2 stuck, 3 spike, for one source's readings in order of time.

    differs: whether the source's neighbouring readings normally differ; None: as these readings say.
    """
    n = len(value)
    kind = np.zeros(n, dtype=np.int8)
    long, repeat = _runs(value)
    if differs is None:
        varied = n - int(long.sum())
        differs = varied >= VARIED * n and int(repeat.sum()) <= REPEATED * varied
    limit = (value < low) | (value > high)
    if differs:
        kind[long] = 2
    kind[limit] = 1
    ok = np.flatnonzero(kind == 0)
    if len(ok) >= 2 * SIDE:
        jumps = _spikes(period[ok], value[ok], hours)
        kind[ok[jumps]] = 3
    return kind


def _runs(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(readings in runs of at least STUCK equal ones, readings outside of these that equal the one before)."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(value) != 0) + 1])[: len(value)]
    size = np.diff(np.append(first, len(value)))
    long = np.repeat(size >= STUCK, size)
    repeat = ~long
    repeat[first] = False
    return long, repeat


def _running(x: np.ndarray, side: int) -> np.ndarray:
    """before[j]: the median of the up to `side` values before index j, for j = 0 .. len(x); nan at 0."""
    n = len(x)
    out = np.empty(n + 1)
    out[0] = np.nan
    for j in range(1, min(side, n + 1)):
        out[j] = np.median(x[:j])
    if n >= side:
        out[side:] = np.median(np.lib.stride_tricks.sliding_window_view(x, side), axis=1)
    return out


def _sides(y: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each reading the median of the clean ones before it and of those after it."""
    x = y[clean]
    before = np.cumsum(clean) - clean
    left = _running(x, SIDE)[before]
    after = len(x) - before - clean
    right = _running(x[::-1], SIDE)[after]
    return left, right


def _smooth(x: np.ndarray, side: int) -> np.ndarray:
    """Centred running median over 2 side + 1 values, the ends filled with the first and last full one."""
    width = 2 * side + 1
    if len(x) < width:
        return np.full(len(x), np.median(x))
    mid = np.median(np.lib.stride_tricks.sliding_window_view(x, width), axis=1)
    return np.concatenate([np.full(side, mid[0]), mid, np.full(side, mid[-1])])


def _profile(r: np.ndarray, slot: np.ndarray, slots: int, neutral: float) -> np.ndarray:
    """The median of r per slot of a cycle; slots with fewer than 3 readings are neutral."""
    out = np.full(slots, neutral)
    order = np.argsort(slot, kind="stable")
    sorted_slots, sorted_r = slot[order], r[order]
    edges = np.searchsorted(sorted_slots, np.arange(slots + 1))
    for s in range(slots):
        a, b = edges[s], edges[s + 1]
        if b - a >= 3:
            out[s] = np.median(sorted_r[a:b])
    return out


def _deseason(period: np.ndarray, v: np.ndarray, hours: int, multiply: bool) -> tuple[np.ndarray, np.ndarray]:
    """(v without its daily and weekly rhythm, the rhythm)."""
    neutral = 1.0 if multiply else 0.0
    season = np.full(len(v), neutral)
    day = 24 // hours if hours < 24 and 24 % hours == 0 else 0
    week = 7 if hours <= 24 and 168 % hours == 0 else 0
    side = max(7, day) if day else 7
    for _ in range(2):
        y = v / season if multiply else v - season
        level = _smooth(y, side)
        if multiply:
            level = np.where(np.abs(level) < 1e-12, 1e-12, level)
        r = v / level if multiply else v - level
        if day:
            hour = _profile(r, period % day, day, neutral)[period % day]
        else:
            hour = np.full(len(v), neutral)
        rest = r / np.where(np.abs(hour) < 1e-12, 1e-12, hour) if multiply else r - hour
        if week:
            date = (period * hours // 24) % 7
            dow = _profile(rest, date, 7, neutral)[date]
        else:
            dow = np.full(len(v), neutral)
        season = hour * dow if multiply else hour + dow
        if multiply:
            season = np.where(np.abs(season) < 1e-6, 1e-6, season)
    return (v / season if multiply else v - season), season


def _scatter(y: np.ndarray) -> float:
    r = y - _smooth(y, 4)
    return 1.4826 * float(np.median(np.abs(r - np.median(r)))) * 1.06


def _spikes(period: np.ndarray, v: np.ndarray, hours: int) -> np.ndarray:
    """Additive outliers of at most BACK_WITHIN readings, lasting changes of level being none.

    The rhythm is taken off (as factors or as terms, whichever leaves less scatter). What is left is a
    level with robust first-order autoregression around it. In each round the level-shift test divides
    the readings into stretches of one level, and the additive-outlier test takes the readings that are off
    from their stretch's level on both sides, less what the autoregression expects from their
    neighbours, by more than SPIKE scatters. These are taken out and everything is estimated anew
    until nothing changes any more; where rounds go in circles, what any round of the circle finds is
    taken. Longer runs of outliers are changes of level and stay.
    """
    best = None
    for multiply in (True, False) if np.quantile(v, 0.05) > 0.1 * np.median(v) > 0 else (False,):
        y, season = _deseason(period, v, hours, multiply)
        unit = season if multiply else np.ones(len(v))
        s = _scatter(y) * float(np.median(np.abs(unit)))
        if best is None or s < 0.97 * best[0]:
            best = (s, y, unit)
    y = best[1]
    flagged = np.zeros(len(v), dtype=bool)
    rounds: list[np.ndarray] = []
    while True:
        rounds.append(flagged)
        clean = ~flagged
        sigma, phi = _noise(y, clean)
        edges = _shifts(y, clean, sigma, phi)
        flagged = _short_runs(np.abs(_additive(y, clean, edges, sigma, phi)) > SPIKE * sigma)
        for k, earlier in enumerate(rounds):
            if (earlier == flagged).all():
                return np.logical_or.reduce(rounds[k:])


def _shifts(y: np.ndarray, clean: np.ndarray, sigma: float, phi: float) -> np.ndarray:
    """Level-shift test: where stretches of one level begin, and the end.

    The statistic of a reading is the difference of the median levels of SIDE clean readings before and
    from it on, over its standard error under the autoregression. Only shifts beyond SPIKE scatters matter, as
    smaller ones hide no outlier.
    """
    at = np.flatnonzero(clean)
    x = y[at]
    if len(x) < 2 * SIDE:
        return np.array([0, len(y)])
    level = np.median(np.lib.stride_tricks.sliding_window_view(x, SIDE), axis=1)
    change = np.abs(level[SIDE:] - level[:-SIDE])
    error = sigma * np.sqrt(np.pi / SIDE * (1 + phi) / (1 - phi))
    spots = np.flatnonzero((change > SPIKE * sigma) & (change > SHIFT * error))
    edges = [0]
    for group in np.split(spots, np.flatnonzero(np.diff(spots) > 1) + 1) if len(spots) else []:
        top = group[change[group] >= 0.8 * change[group].max()] + SIDE
        # The place that leaves least distance from the levels on its two sides.
        cost = [np.abs(x[k - SIDE : k] - level[k - SIDE]).sum() + np.abs(x[k : k + SIDE] - level[k]).sum() for k in top.tolist()]
        edges.append(int(at[top[int(np.argmin(cost))]]))
    return np.unique([*edges, len(y)])


def _additive(y: np.ndarray, clean: np.ndarray, edges: np.ndarray, sigma: float, phi: float) -> np.ndarray:
    """Additive-outlier test: the estimated outlier at each reading, 0 where the two sides disagree.

    Against the level on either side the estimate is what remains of the reading when the
    autoregression's expectation from both neighbours, phi / (1 + phi^2) times their distances, is
    taken off; the smaller one counts. Beside a shift the distance from the level beyond it counts too.
    """
    left, right = np.empty(len(y)), np.empty(len(y))
    for a, b in zip(edges[:-1], edges[1:]):
        left[a:b], right[a:b] = _sides(y[a:b], clean[a:b])
        # Right beside a shift too few readings say what that side's level is.
        known = np.cumsum(clean[a:b])
        if a:
            left[a:b][known - clean[a:b] < BACK_WITHIN + 1] = np.nan
        if b < len(y):
            right[a:b][known[-1] - known < BACK_WITHIN + 1] = np.nan
    left, right = np.where(np.isnan(left), right, left), np.where(np.isnan(right), left, right)
    # A distance that is unusual itself says nothing about its neighbour.
    usual = lambda d: np.where(np.abs(d) <= 3 * sigma, d, 0.0)
    before = np.concatenate([[0.0], np.where(clean[:-1], usual(y[:-1] - left[1:]), 0.0)])
    after = np.concatenate([np.where(clean[1:], usual(y[1:] - right[:-1]), 0.0), [0.0]])
    expected = phi / (1 + phi * phi) * (before + after)
    dl, dr = y - left - expected, y - right - expected
    off = np.where(np.sign(dl) == np.sign(dr), np.where(np.abs(dl) < np.abs(dr), dl, dr), 0.0)
    off = np.nan_to_num(off)
    for e in edges[1:-1].tolist():
        old, new = left[e - 1], right[e]
        for near, beyond in ((range(e - 1, max(-1, e - 1 - BACK_WITHIN), -1), new), (range(e, min(len(y), e + BACK_WITHIN)), old)):
            under_way = True
            for k in near:
                off[k] = np.sign(off[k]) * min(abs(off[k]), abs(y[k] - beyond))
                # Next to the shift a reading between the levels is on its way from one to the other.
                under_way &= abs(off[k]) > SPIKE * sigma and min(old, new) < y[k] < max(old, new)
                if under_way:
                    off[k] = 0.0
    return off


def _noise(y: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Scatter of the clean readings around their level, and the robust lag-one coefficient."""
    x = y[clean]
    r = x - _smooth(x, 6)
    r = r - np.median(r)
    sigma = 1.4826 * float(np.median(np.abs(r))) * 1.05
    floor = 1e-9 * max(1.0, float(np.median(np.abs(x))))
    if sigma <= floor:
        # A series that hardly changes: its rare small steps are its scatter (large ones may be spikes).
        steps = np.sort(np.abs(np.diff(x)))
        steps = steps[steps > floor]
        small = max(1.0, 0.02 * float(np.median(np.abs(x))))
        sigma = min(float(steps[len(steps) // 4]), small) if len(steps) >= 3 else small
    c = np.clip(r, -2 * sigma, 2 * sigma)
    power = float(c[:-1] @ c[:-1])
    phi = float(c[1:] @ c[:-1]) / power if power > 0 else 0.0
    return sigma, min(max(phi, -0.9), 0.9)


def _short_runs(off: np.ndarray) -> np.ndarray:
    """The runs of readings that are off and end within BACK_WITHIN readings, before the series does."""
    out = np.zeros(len(off), dtype=bool)
    at = np.flatnonzero(off)
    if not len(at):
        return out
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        if len(run) <= BACK_WITHIN and run[-1] < len(off) - 1:
            out[run] = True
    return out
