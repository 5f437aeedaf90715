"""The general upkeep operators: edge cases of each, and known results on small tables."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark import session
from tidemark.functions.text_time import clean_id, instant_text, utc_instant
from tidemark.operators import hierarchy, history, once, orphans, regular_grid, snapshot_diff, spikes

T0 = datetime(2024, 1, 1)


def hours(n):
    return T0 + timedelta(hours=n)


def test_utc_instant_notations(spark):
    texts = ["2024-01-01 10:00:00", "2024-01-01T10:00:00Z", "2024-01-01T12:00:00+02:00", "2024-01-01 10:00:00.99", " 2024-01-01T05:00:00-05:00 ", "", "no", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", instant_text(utc_instant("t")).alias("t")).orderBy("i")
    assert [r["t"] for r in df.collect()] == ["2024-01-01 10:00:00"] * 5 + [None] * 3


def test_clean_id(spark):
    df = spark.createDataFrame([(" \tA.b\n ",), (None,), ("  ",)], "x string").select(clean_id("x").alias("x"))
    assert rows(df) == [("",), ("a.b",), (None,)]


# keep_one


def test_keep_one_latest_ties_nulls_and_clashing_names(spark):
    data = [("a", 1, "x", "k"), ("a", 2, "y", "k"), ("a", 2, "z", "k"), ("b", None, "x", None), (None, 5, "n", None), (None, 6, "n", None)]
    df = spark.createDataFrame(data, "id string, at int, _key string, copies string")
    out = once.keep_one(df, F.col("id"), [F.col("at").desc_nulls_last()])
    got = {(r["id"], r["at"], r["_key"], r["copies"]) for r in out.collect()}
    assert got == {("a", 2, "y", 3), ("b", None, "x", 1), (None, 5, "n", 1), (None, 6, "n", 1)}


def test_keep_one_hot_key_and_empty(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    out = once.keep_one(df, F.col("k"), [F.col("id").asc()])
    assert out.where("k = 'hot'").select("id", "copies").collect()[0] == (0, 6667)
    assert out.count() == df.select("k").distinct().count()
    assert once.keep_one(df.limit(0), F.col("k"), [F.col("id")]).count() == 0


def test_new_only(spark):
    batch = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), (None, 3)], "id string, at int")
    stored = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    out = once.new_only(batch, F.col("id"), stored, F.col("id"), [F.col("at")])
    assert rows(out) == [("b", 1), (None, 3)]


def test_small_tables_are_spread_over_the_cores(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and session.spread(df).count() == 1000
    monkeypatch.setattr(session, "SPREAD_BYTES", 10)
    assert session.spread(df) is df


# orphans


def test_orphans_by_deltas(spark):
    refs = spark.createDataFrame(
        [("t", "a", hours(5), 1), ("t", "a", hours(50), 1), ("t", "b", hours(5), 1), ("t", "c", hours(5), 1), ("t", "c", hours(5), -1), ("t", None, hours(5), 1), ("t", "", hours(5), 1), ("t", "d", None, 2), ("t", "a", None, 1)],
        "target string, key string, at timestamp_ntz, delta int",
    )
    spans = spark.createDataFrame([("t", "a", hours(2), hours(9)), ("t", "a", hours(4), hours(10)), ("t", "e", hours(0), None)], "target string, key string, first timestamp_ntz, last timestamp_ntz")
    ledger = orphans.apply_deltas(None, orphans.reference_deltas(refs), orphans.existence_deltas(spans))
    got = {(r["key"], r["at"], r["refs"], r["seen"]) for r in orphans.orphans(ledger).collect()}
    assert got == {("a", hours(50), 1, True), ("b", hours(5), 1, False), ("d", None, 2, False)}


def test_orphan_ledger_in_batches_equals_at_once(spark):
    shape = "target string, key string, at timestamp_ntz, delta int"
    first = spark.createDataFrame([("t", "a", hours(1), 1), ("t", "b", hours(1), 2)], shape)
    second = spark.createDataFrame([("t", "b", hours(1), -2), ("t", "a", hours(1), 1)], shape)
    none = spark.createDataFrame([], shape)
    step = orphans.apply_deltas(orphans.apply_deltas(None, first, none), second, none)
    whole = orphans.apply_deltas(None, first.unionByName(second), none)
    assert rows(step) == rows(whole) == [("t", "a", hours(1), 2, 0)]


def test_key_that_goes_and_comes_again(spark):
    spans = spark.createDataFrame([("t", "a", hours(24), hours(48)), ("t", "a", hours(192), hours(216)), ("t", "b", None, hours(3))], "target string, key string, first timestamp_ntz, last timestamp_ntz")
    refs = spark.createDataFrame([("t", "a", hours(h), 1) for h in (1, 30, 120, 200, 300)] + [("t", "b", hours(2), 1), ("t", "b", hours(1000), 1)], "target string, key string, at timestamp_ntz, delta int")
    none = refs.limit(0)
    one = orphans.apply_deltas(None, refs, orphans.existence_deltas(spans))
    two = orphans.apply_deltas(orphans.apply_deltas(None, none, orphans.existence_deltas(spans.filter("first IS NULL OR last < TIMESTAMP '2024-01-05'"))), refs, orphans.existence_deltas(spans.filter("last > TIMESTAMP '2024-01-05'")))
    want = [("t", "a", hours(1), 1, True), ("t", "a", hours(120), 1, True), ("t", "a", hours(300), 1, True), ("t", "b", hours(1000), 1, True)]
    assert set(rows(orphans.orphans(one))) == set(rows(orphans.orphans(two))) == set(want)


@pytest.mark.parametrize("seed", range(3))
def test_ledger_does_not_depend_on_batches(spark, seed):
    rng = random.Random(seed)
    keys = "abcd"
    refs = [("t", rng.choice(keys), rng.choice([None, hours(rng.randrange(2000))]), rng.choice([1, 1, -1])) for _ in range(80)]
    spans = []
    for _ in range(30):
        first = rng.randrange(2000)
        spans.append(("t", rng.choice(keys), hours(first), rng.choice([None, hours(first + rng.randrange(300))]), rng.choice([1, 1, -1])))
    ref_shape, span_shape = "target string, key string, at timestamp_ntz, delta int", "target string, key string, first timestamp_ntz, last timestamp_ntz, sign int"

    def ledger(parts):
        state = None
        for k in range(parts):
            r = spark.createDataFrame([x for i, x in enumerate(refs) if i % parts == k], ref_shape)
            s = spark.createDataFrame([x for i, x in enumerate(spans) if (i * 7) % parts == k], span_shape)
            new = orphans.existence_deltas(s.filter("sign > 0")).unionByName(orphans.existence_deltas(s.filter("sign < 0"), -1))
            state = orphans.apply_deltas(state, orphans.reference_deltas(r), new)
        return state

    whole, parts = ledger(1), ledger(3)
    assert rows(whole) == rows(parts)
    counts, moves = {}, []
    for _, key, at, n in refs:
        counts[key, at] = counts.get((key, at), 0) + n
    for _, key, first, last, sign in spans:
        moves += [(key, first, sign)] + ([(key, last + timedelta(microseconds=1), -sign)] if last else [])
    net = {}
    for key, at, n in moves:
        net[key, at] = net.get((key, at), 0) + n
    ever = {k for (k, _), n in net.items() if n > 0}
    alive = lambda key, at: key in ever if at is None else sum(n for (k, t), n in net.items() if k == key and t <= at) > 0
    want = {(key, at, n) for (key, at), n in counts.items() if n > 0 and not alive(key, at)}
    assert {(r["key"], r["at"], r["refs"]) for r in orphans.orphans(parts).collect()} == want
    now = hours(1000)
    sums = {k: sum(n for (x, at), n in counts.items() if x == k and (at is None or at <= now)) for k in keys}
    want = {(k, n) for k, n in sums.items() if n > 0 and not alive(k, now)}
    assert {(r["key"], r["refs"]) for r in orphans.current_orphans(whole, F.lit(now).cast("timestamp_ntz")).collect()} == want


# hierarchy


def brute_hierarchy(parents):
    known = {n: {p for p in ps if p in parents} for n, ps in parents.items()}
    out, done = {}, set()
    while True:
        ready = [n for n in known if n not in done and known[n] <= done]
        if not ready:
            break
        for n in ready:
            best = {} if known[n] else {n: 0}
            for p in known[n]:
                for root, depth in out[p].items():
                    best[root] = max(best.get(root, 0), depth + 1)
            out[n] = best
        done |= set(ready)
    return {(n, r, d) for n, b in out.items() for r, d in b.items()} | {(n, "cycle", -1) for n in known if n not in done}


@pytest.mark.parametrize(("seed", "local"), [(1, 0), (2, 0), (3, 0), (1, 5000), (2, 5000), (3, 5000)])
def test_hierarchy_matches_brute_force(spark, monkeypatch, seed, local):
    monkeypatch.setattr(hierarchy, "LOCAL_EDGES", local)
    monkeypatch.setattr(hierarchy, "TOPS", 7)
    rng = np.random.default_rng(seed)
    n = 120
    parents = {}
    for i in range(n):
        k = rng.choice([0, 1, 1, 1, 2, 3]) if i else 0
        parents[f"n{i}"] = {f"n{j}" for j in rng.integers(max(0, i - 12), max(1, i), size=k)}
    for _ in range(2):
        a, b = rng.integers(n // 2, n, 2)
        parents[f"n{min(a, b)}"] |= {f"n{max(a, b)}"}
    parents["n5"] |= {"unknown"}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in parents.items()], "node string, parents array<string>")
    got = {tuple(r) for r in hierarchy.hierarchy(df).collect()}
    assert got == brute_hierarchy(parents)


def test_hierarchy_cycles_paths_nulls_and_repeats(spark):
    data = [
        ("r", []), ("a", ["r", "r"]), ("b", ["a", None]), ("c", ["b", "r"]), ("c", ["b", "r"]), ("self", ["self"]), ("x", ["y"]), ("y", ["x"]),
        ("below", ["y", "r"]), ("up", ["r"]), ("m", ["up", "n"]), ("n", ["m"]), (None, ["r"]), ("lone", None),
    ]
    df = spark.createDataFrame(data, "node string, parents array<string>")
    out = {(r["node"], r["root"], r["depth"], "/".join(r["path"] or [])) for r in hierarchy.hierarchy(df, paths=True).collect()}
    assert out == {
        ("r", "r", 0, "r"), ("a", "r", 1, "r/a"), ("b", "r", 2, "r/a/b"), ("c", "r", 3, "r/a/b/c"), ("up", "r", 1, "r/up"), ("lone", "lone", 0, "lone"),
        ("self", "cycle", -1, ""), ("x", "cycle", -1, ""), ("y", "cycle", -1, ""), ("below", "cycle", -1, ""), ("m", "cycle", -1, ""), ("n", "cycle", -1, ""),
    }
    pairs = {tuple(r) for r in hierarchy.descendants(df, hierarchy.hierarchy(df)).collect()}
    assert pairs == {("r", "a", 1), ("r", "b", 2), ("r", "c", 3), ("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("r", "up", 1)}


def test_hierarchy_long_chain_and_empty(spark):
    n = 300
    df = spark.createDataFrame([(f"c{i}", [f"c{i - 1}"] if i else []) for i in range(n)], "node string, parents array<string>")
    out = hierarchy.hierarchy(df)
    assert out.agg(F.max("depth"), F.count("*")).first() == (n - 1, n)
    assert hierarchy.hierarchy(df.limit(0)).count() == 0


def test_listed_parents(spark):
    df = spark.createDataFrame([('["A.b", " c "]',), ("['x', 'X']",), ("[]",), ("[ ]",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(hierarchy.listed_parents(F.col("t"))).collect()] == [["a.b", "c"], ["x"], [], [], [], []]


# history


def test_history_nulls_absences_and_order(spark):
    data = [
        ("m", T0, "A", '["x", "y"]'),
        ("m", T0 + timedelta(7), None, '["Y ", "x"]'),
        ("m", T0 + timedelta(60), "a", None),
        ("m", T0 + timedelta(67), "b", "[]"),
        ("m", T0 + timedelta(67), "b", "[]"),
        ("m", T0 + timedelta(74), "a", "[]"),
        ("n", T0, None, None),
        (None, T0, "a", "[]"),
        ("o", None, "a", "[]"),
    ]
    df = spark.createDataFrame(data, "key string, at timestamp_ntz, c string, o string").withColumn("seq", F.lit(1)).withColumn("chunk", F.lit(1))
    out = history.attribute_history(df, F.col("key"), F.col("at"), {"c": F.lower("c"), "o": history.name_set(F.col("o"))})
    got = [(r["key"], r["c"], r["o"], r["valid_from"], r["valid_to"]) for r in out.orderBy("key", "valid_from").collect()]
    assert got == [
        ("m", "a", '["x","y"]', T0, T0 + timedelta(67)),
        ("m", "b", "[]", T0 + timedelta(67), T0 + timedelta(74)),
        ("m", "a", "[]", T0 + timedelta(74), None),
        ("n", None, None, T0, None),
    ]
    assert history.attribute_history(df.limit(0), F.col("key"), F.col("at"), {"c": F.col("c")}).count() == 0


def test_history_events_report_deletions(spark):
    seen = spark.createDataFrame([("a", T0, "1"), ("a", hours(9), "2"), ("b", hours(9), "1")], "key string, at timestamp_ntz, v string")
    states = history.ordered_states(seen, ["v"])
    events = history.change_events(states, ["v"], as_of=F.lit(hours(9)).cast("timestamp_ntz"))
    assert {(r["key"], r["change"]) for r in events.collect()} == {("a", "inserted"), ("a", "changed"), ("b", "inserted")}
    late = history.change_events(states, ["v"], as_of=F.lit(hours(10)).cast("timestamp_ntz"))
    assert ("a", "deleted") in {(r["key"], r["change"]) for r in late.collect()}


# snapshots


def test_snapshot_changes_small(spark):
    day = lambda n: (T0 + timedelta(n)).date()
    data = [
        ("t", day(0), "a", "INT"), ("t", day(0), "b", "INT"), ("t", day(0), "n", None), ("t", day(3), "a", "TEXT"), ("t", day(3), "c", "INT"), ("t", day(3), "c", "INT"),
        ("t", day(3), "n", "INT"), ("u", day(1), "x", "INT"), (None, day(1), "x", "INT"), ("t", None, "a", "INT"), ("t", day(9), "a", "TEXT"), ("t", day(9), "b", "INT"),
    ]
    df = spark.createDataFrame(data, "entity string, day date, member string, value string")
    out = snapshot_diff.snapshot_changes(snapshot_diff.snapshot_rows(df, *[F.col(c) for c in df.columns]))
    got = {(r["entity"], r["day"], r["member"], r["change_kind"], r["old"], r["new"]) for r in out.collect()}
    assert got == {
        ("t", day(3), "a", "changed", "INT", "TEXT"), ("t", day(3), "b", "removed", "INT", None), ("t", day(3), "c", "added", None, "INT"),
        ("t", day(9), "b", "added", None, "INT"), ("t", day(9), "c", "removed", "INT", None), ("t", day(9), "n", "removed", "INT", None),
    }


def test_snapshot_merge_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        days = spark.range(2).select(F.date_add(F.lit(T0.date()), F.col("id").cast("int")).alias("day"), F.col("id").alias("d"))
        members = spark.range(500).select(F.col("id").cast("string").alias("member"), F.col("id").alias("m"))
        df = days.crossJoin(members).where("NOT (d = 1 AND m % 10 = 0)").select(F.lit("hot").alias("entity"), "day", "member", F.when((F.col("m") % 7 == 0) & (F.col("d") == 1), "B").otherwise("A").alias("value"))
        out = snapshot_diff.snapshot_changes(df)
        got = dict(out.groupBy("change_kind").count().collect())
        assert got == {"removed": 50, "changed": len([i for i in range(500) if i % 7 == 0 and i % 10])}
        assert snapshot_diff.snapshot_changes(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# grid


def grid_cells(df):
    return regular_grid.cells(df, [F.col("s"), F.col("t")], F.col("b"), F.col("e"), F.col("v"), F.col("h"), F.col("u"))


GRID = "s string, t string, b timestamp_ntz, e timestamp_ntz, v double, h int, u timestamp_ntz"


def test_grid_midpoints_missing_and_dirty(spark):
    data = [
        ("a", None, hours(0), hours(1), 1.0, 1, hours(2)),
        ("a", None, hours(0), hours(1), 9.0, 1, hours(1)),
        ("a", None, None, hours(2), 2.0, None, hours(2)),
        ("a", None, hours(2), hours(3), None, 1, hours(3)),
        ("a", None, hours(3) - timedelta(minutes=20), hours(4) - timedelta(minutes=20), 4.0, 1, hours(5)),
        ("a", None, hours(5), hours(6), 6.0, 6, hours(6)),
        ("a", None, hours(9), hours(10), float("nan"), 1, hours(10)),
        ("b", "x", hours(0), hours(1), 1.0, None, hours(2)),
    ]
    out = regular_grid.regular_grid(grid_cells(spark.createDataFrame(data, GRID)))
    got = {(r["series"][0], r["period"] - (19723 - 4) * 24, r["value"], r["status"]) for r in out.collect()}
    assert got == {("a", 0, 1.0, "observed"), ("a", 1, 2.0, "observed"), ("a", 2, None, "unsupported"), ("a", 3, 4.0, "observed"), ("a", 4, None, "unsupported"), ("a", 5, 6.0, "observed")}
    starts = out.select(instant_text(regular_grid.period_start(F.col("hours"), F.col("period")))).distinct()
    assert ("2024-01-01 02:00:00",) in rows(starts)


def test_grid_weeks_start_on_monday_and_empty(spark):
    data = [("a", "", T0 + timedelta(7 * k), T0 + timedelta(7 * k + 7), 1.0, 168, T0) for k in (0, 2)]
    df = spark.createDataFrame(data, GRID)
    out = regular_grid.regular_grid(grid_cells(df), ("unsupported", "filled"))
    assert rows(out.select(instant_text(regular_grid.period_start(F.col("hours"), F.col("period"))))) == [("2024-01-08 00:00:00",)]
    assert regular_grid.regular_grid(grid_cells(df.limit(0))).count() == 0


def test_grid_fills_low_rank_cells(spark):
    rng = np.random.default_rng(0)
    sources, periods = 40, 120
    season = np.stack([np.sin(np.arange(periods) * 2 * np.pi / 24), np.cos(np.arange(periods) * 2 * np.pi / 24)])
    truth = 100 + rng.normal(size=(sources, 2)) @ season * 20 + rng.normal(size=(sources, periods)) * 0.2
    hidden = rng.random((sources, periods)) < 0.15
    hidden[:, 0] = hidden[:, -1] = False
    data = [([f"s{i}"], 1, p, float(truth[i, p])) for i in range(sources) for p in range(periods) if not hidden[i, p]]
    filled = spark.createDataFrame(data, "series array<string>, hours int, period bigint, value double")
    out = regular_grid.regular_grid(filled).collect()
    assert len(out) == sources * periods
    error = [abs(r["value"] - truth[int(r["series"][0][1:]), r["period"]]) for r in out if r["status"] == "filled"]
    exact = [r["value"] == truth[int(r["series"][0][1:]), r["period"]] for r in out if r["status"] == "observed"]
    assert len(error) == hidden.sum() and all(exact)
    assert np.median(error) < 3 < 0.3 * truth.std()


def test_grid_blocks_and_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(regular_grid, "BLOCK", 16)
    monkeypatch.setattr(regular_grid, "FACTOR_ROWS", 20)
    data = [(["a"], 1, p, float(p)) for p in (3, 5, 40, 41, 90)]
    out = regular_grid.regular_grid(spark.createDataFrame(data, "series array<string>, hours int, period bigint, value double"))
    got = {r["period"]: r["value"] for r in out.collect()}
    assert sorted(got) == list(range(3, 91)) and {p: v for p, v in got.items() if v is not None} == {p: float(p) for p in (3, 5, 40, 41, 90)}


# spikes


def judge(v, hours_=24, low=np.nan, high=np.nan):
    n = len(v)
    return spikes.judge(np.arange(n), np.asarray(v, float), hours_, np.full(n, low), np.full(n, high))


def noisy(n, rng, level=1000.0, weekly=0.3):
    dow = np.arange(n) % 7
    return level * np.where(dow >= 5, 1 - weekly, 1.0) * (1 + 0.02 * rng.normal(size=n))


def test_spikes_found_and_changes_of_level_kept():
    rng = np.random.default_rng(1)
    v = noisy(120, rng)
    v[60:] *= 1.8
    v[30] *= 1.6
    v[90:92] *= 0.4
    v[100:104] *= 1.7
    assert np.flatnonzero(judge(v) == 3).tolist() == [30, 90, 91]


def test_stuck_limits_and_quiet_series():
    rng = np.random.default_rng(2)
    v = noisy(100, rng)
    v[40:47] = v[40]
    v[70] = -5
    k = judge(v, low=0)
    assert np.flatnonzero(k == 2).tolist() == list(range(40, 47)) and k[70] == 1
    assert not judge(np.repeat([40.0, 41.0, 42.0], 40)).any()
    assert judge(np.full(8, 3.0), low=5).tolist() == [1] * 8
    assert judge([]).tolist() == [] and judge([1.0]).tolist() == [0]


def test_trend_and_daily_rhythm_are_normal():
    rng = np.random.default_rng(3)
    t = np.arange(24 * 20)
    v = (500 + t * 0.5) * (1 + 0.4 * np.sin(t * 2 * np.pi / 24)) * (1 + 0.01 * rng.normal(size=len(t)))
    v[200] *= 1.5
    assert np.flatnonzero(judge(v, 1)).tolist() == [200]


SPIKES = "id string, s string, b timestamp_ntz, e timestamp_ntz, h int, v double, u timestamp_ntz, m string"


def implausible(df):
    return spikes.implausible(df, F.col("id"), [F.col("s")], F.col("b"), F.col("e"), F.col("h"), F.col("v"), F.col("u"), F.col("m"))


def test_implausible_rows(spark):
    rng = np.random.default_rng(4)
    v = noisy(80, rng)
    v[50] = 5000
    data = [(f"i{k}", None, T0 + timedelta(k), T0 + timedelta(k + 1), 24, float(x), T0, "row_count") for k, x in enumerate(v)]
    data += [("i10", None, data[10][2], data[10][3], 24, 1e9, T0 - timedelta(1), "row_count"), (None, None, T0, hours(1), 24, -1.0, T0, "row_count")]
    data += [("p", "s", T0, hours(24), None, 101.0, None, "null_percent"), ("q", "s", None, hours(48), 24, None, T0, "null_percent"), ("a", "s", None, hours(72), 24, -3.0, T0, None)]
    df = spark.createDataFrame(data, SPIKES).withColumn("period", F.lit("clash"))
    assert rows(implausible(df)) == [("i50", "spike"), ("p", "limit")]
    assert implausible(df.limit(0)).count() == 0


def test_implausible_hot_series_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(spikes, "CHUNK", 200)
    monkeypatch.setattr(spikes, "HALO", 60)
    rng = np.random.default_rng(5)
    v = noisy(900, rng)
    for k in (150, 199, 200, 201, 640):
        v[k] *= 3 if k != 200 else 1
    data = [(f"i{k}", "hot", None, T0 + timedelta(k + 1), 24, float(x), T0, "average") for k, x in enumerate(v)]
    got = {r["id"] for r in implausible(spark.createDataFrame(data, SPIKES)).collect()}
    assert got == {"i150", "i199", "i201", "i640"}


def test_long_series_in_spans_equal_the_whole(spark):
    """A stuck run longer than a span, spikes at borders and changes of level: judged in spans as at once."""
    rng = np.random.default_rng(6)
    n = 30_000
    hour = np.arange(n) % 24
    v = 500 + 40 * np.sin(hour / 24 * 2 * np.pi) + 3 * rng.normal(size=n)
    v[20_000:] += 300
    v[9_000:15_000] = 512.0
    v[[100, 4096, 4097, 8192, 17_000, 19_998, 25_000]] += 90
    data = [(f"i{k}", "long", None, T0 + timedelta(hours=k + 1), 1, float(x), T0, "average") for k, x in enumerate(v)]
    data += [(f"j{k}", "short", None, T0 + timedelta(hours=k + 1), 1, float(k // 7), T0, "average") for k in range(200)]
    got = {(r["id"], r["kind"]) for r in implausible(spark.createDataFrame(data, SPIKES)).collect()}
    whole = spikes.judge(np.arange(1, n + 1), v, 1, np.full(n, np.nan), np.full(n, np.nan))
    assert got == {(f"i{k}", ["", "limit", "stuck", "spike"][whole[k]]) for k in np.flatnonzero(whole)}
    assert int((whole == 2).sum()) == 6000 and {k for k in np.flatnonzero(whole == 3)} >= {100, 4096, 4097, 8192, 17_000, 19_998, 25_000}


def test_flat_series_stays_flat_in_spans(spark, monkeypatch):
    monkeypatch.setattr(spikes, "CHUNK", 100)
    monkeypatch.setattr(spikes, "HALO", 30)
    rng = np.random.default_rng(7)
    flat = np.repeat(rng.integers(0, 5, 100), 9).astype(float)
    lively = np.concatenate([rng.normal(size=600), np.repeat(rng.normal(size=20), 15)])
    data = [(f"f{k}", "flat", None, T0 + timedelta(hours=k + 1), 1, float(x), T0, "average") for k, x in enumerate(flat)]
    data += [(f"l{k}", None, None, T0 + timedelta(hours=k + 1), 1, float(x), T0, "average") for k, x in enumerate(lively)]
    got = {r["id"] for r in implausible(spark.createDataFrame(data, SPIKES)).filter("kind = 'stuck'").collect()}
    assert got == {f"l{k}" for k in range(600, 900)}


def test_outliers_of_an_autoregressive_series():
    rng = np.random.default_rng(8)
    d = np.zeros(400)
    for k in range(1, 400):
        d[k] = 0.7 * d[k - 1] + rng.normal()
    v = 1000 + 10 * d
    v[150] += 300
    v[250:253] -= 300
    v[300:] += 500
    v[298] += 250
    assert np.flatnonzero(judge(v, 24) == 3).tolist() == [150, 250, 251, 252, 298]


def test_limits_by_metric(spark):
    df = spark.createDataFrame([("null_count",), ("NOT_NULL_PERCENT",), ("freshness_11",), ("max_length",), ("average",), ("sum",), (None,)], "m string")
    low, high = spikes.limits(F.col("m"))
    assert [tuple(r) for r in df.select(low, high).collect()] == [(0.0, None), (0.0, 100.0), (0.0, None), (0.0, None), (None, None), (None, None), (None, None)]
