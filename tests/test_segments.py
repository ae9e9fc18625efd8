"""Segmented scans: the same results as by brute force with segments of few rows, and a large subject over many tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals
from tidemark.operators import windows as Wn
from tidemark.operators.segments import Running, Segments

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """(k, ts, i, v): one subject holds half of all rows, one is null; times tie, values are missing."""
    rng = random.Random(3)
    out = []
    for i in range(64):
        k = None if i % 12 == 0 else 1 if i % 2 else rng.randrange(2, 9)
        ts = T0 + rng.randrange(24) * DAY / 2
        out.append((k, ts, i, None if rng.random() < 0.3 else float(rng.randrange(-50, 50))))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k int, ts timestamp, i int, v double").repartition(5)


def subjects(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by


MOSTS = [3, 1_000_000]


@pytest.mark.parametrize("most", MOSTS)
def test_numbers_fills_gaps_and_times(spark, df, rows, most):
    got = {r["i"]: r["n"] for r in Wn.number(df, ["k"], ["ts", "i"], "n", 0, most).collect()}
    filled = {r["i"]: r["v"] for r in Wn.fill(df, ["v"], "k", ["ts", "i"], most).collect()}
    counted = {r["i"]: r["c"] for r in Wn.running_count(df, "k", "v", ["ts", "i"], "c", most).collect()}
    spread = {r["i"]: r["ts"] for r in Wn.spread_times(df, "k", "ts", ["ts", "i"], most).collect()}
    stays = df.withColumn("e", F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    gaps = {r["i"]: r["gap_days"] for r in Wn.gap_days(stays, "k", "ts", "e", ["ts", "i"], most=most).collect()}
    picked = {r["k"]: r["i"] for r in Wn.pick_random(df, "k", ["ts", "i"], 7, most).collect()}
    for k, own in subjects(rows).items():
        for n, (_, ts, i, _) in enumerate(own):
            assert got[i] == n
            past, later = [r[3] for r in own[: n + 1] if r[3] is not None], [r[3] for r in own[n:] if r[3] is not None]
            assert filled[i] == (past[-1] if past else later[0] if later else None)
            assert counted[i] == len(past) - 1
            assert spread[i] == ts + dt.timedelta(seconds=n)
            assert gaps[i] == (max(0, (ts.date() - (own[n - 1][1] + 3 * DAY).date()).days) if n else 0)
        assert k not in picked or picked[k] in [r[2] for r in own]
    assert picked == {r["k"]: r["i"] for r in Wn.pick_random(df, "k", ["ts", "i"], 7).collect()}


@pytest.mark.parametrize("most", MOSTS)
def test_all_windows(spark, df, rows, most):
    specs = [("v", a) for a in ("has_values_count", "sum", "sum_sqd", "min", "max")] + [("i", "count")]
    windows = ["FULL", "-FULL", "3d", "-5d", "400d"]
    got = {r["i"]: r.asDict() for r in Wn.summarize_over_window(df, "k", "ts", specs, windows, ["i"], most).collect()}
    assert len(got) == len(rows)
    for own in subjects(rows).values():
        for n, (_, ts, i, _) in enumerate(own):
            inside = {
                "FULL": own[: n + 1], "-FULL": own[n:], "3d": [r for r in own if ts - 3 * DAY < r[1] <= ts],
                "-5d": [r for r in own if ts < r[1] <= ts + 5 * DAY], "400d": [r for r in own if r[1] <= ts],
            }
            for w, rs in inside.items():
                vs = [r[3] for r in rs if r[3] is not None]
                want = (len(vs), sum(vs) if vs else None, sum(v * v for v in vs) if vs else None, min(vs, default=None), max(vs, default=None), len(rs))
                assert tuple(got[i][f"{w}/{c}/{a}"] for c, a in specs) == want, (w, i)


@pytest.mark.parametrize("most", MOSTS)
@pytest.mark.parametrize("mode", ["running_max", "previous_row"])
def test_islands(spark, rows, most, mode):
    rng = random.Random(9)
    stays = [(k, (ts + rng.randrange(9) * DAY).date(), None) for k, ts, _, _ in rows]
    stays = [(k, s, s + dt.timedelta(days=rng.choice([0, 1, 2, 25]))) for k, s, _ in stays]
    df = spark.createDataFrame(stays, "k int, s date, e date")
    got = sorted((str(r["k"]), r["s"], r["e"], r["n"]) for r in intervals.merge(df, "k", "s", "e", mode=mode, most=most).collect())
    want = []
    for k in {r[0] for r in stays}:
        islands, before = [], None
        for _, s, e in sorted((r for r in stays if r[0] == k), key=lambda r: r[1:]):
            if before is None or s > before + DAY:
                islands.append([s, e, 0])
                before = None if mode == "running_max" else before
            islands[-1][1] = max(islands[-1][1], e)
            islands[-1][2] += 1
            before = e if mode == "previous_row" or before is None else max(before, e)
        want += [(str(k), *x) for x in islands]
    if mode == "running_max":
        assert got == sorted(want)
    else:
        assert got == sorted((str(r["k"]), r["s"], r["e"], r["n"]) for r in intervals.merge(df, "k", "s", "e", mode=mode).collect())


@pytest.mark.parametrize("most", MOSTS)
def test_equal_intervals_are_in_one_island_in_any_order(spark, monkeypatch, most):
    """Rows may reach the second window in another order than the first, as after a shuffle: here in a random one."""
    day = T0.date()
    stays = [(k, day + 10 * n * DAY, day + (10 * n + 2) * DAY) for k in range(9) for n in range(8) for _ in range(2)]
    changed = Segments.with_columns

    def mixed(self, *args):
        out = changed(self, *args)
        at = F.xxhash64(out.key[0], "s", "_new")
        return Segments(out.key, out.order, out.light.coalesce(1).sortWithinPartitions(at), out.heavy and out.heavy.coalesce(1).sortWithinPartitions(at))

    monkeypatch.setattr(Segments, "with_columns", mixed)
    got = sorted(tuple(r) for r in intervals.merge(spark.createDataFrame(stays, "k int, s date, e date"), "k", "s", "e", most=most).collect())
    assert got == [(k, n + 1, day + 10 * n * DAY, day + (10 * n + 2) * DAY, 2) for k in range(9) for n in range(8)]


def test_times_in_a_sequence(spark, rows):
    unique = {(k, ts): i for k, ts, i, _ in rows}
    df = spark.createDataFrame([(k, ts, i) for (k, ts), i in unique.items()], "k int, ts timestamp, i int")
    a, b = (sorted((r["i"], r["time"], str(r["time_delta"])) for r in Wn.times_in_sequence(df, "k", "ts", m).collect()) for m in MOSTS)
    assert a == b


def test_a_large_subject_is_spread_over_all_tasks(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") + 100_000).alias("k"), F.col("id").alias("at"))
    cut = Segments.of(df, "k", ["at"], 1000)
    assert cut.light.filter("k = 7").count() == 0
    sizes = [r["count"] for r in cut.heavy.groupBy("_segment").count().collect()]
    assert len(sizes) >= 20 and sum(sizes) == 20_000 and max(sizes) < 2_500
    top = cut.running(Running("n", "count", F.lit(1)), Running("s", "sum", F.col("at"))).frame().filter("k = 7").agg(F.max("n"), F.max("s"), F.count_distinct("n")).first()
    assert tuple(top) == (20_000, sum(range(0, 40_000, 2)), 20_000)


def test_empty_and_wrong(spark):
    empty = spark.createDataFrame([], "k int, ts timestamp, v double")
    assert Wn.fill(empty, ["v"], "k", ["ts"], 3).count() == 0
    assert Wn.summarize_over_window(empty, "k", "ts", [("v", "sum")], ["FULL", "7d"], most=3).count() == 0
    with pytest.raises(ValueError):
        Running("x", "last", F.col("v"), "after")
