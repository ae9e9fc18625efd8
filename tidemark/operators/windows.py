"""Window operators over a subject's ordered rows. Orders are column names; subjects of more than ``most`` rows are cut into segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import MICROS_PER_DAY, micros, portable_hash
from tidemark.operators.segments import MOST, Running, Segments, following, previous, rolling

UNITS = {"s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": MICROS_PER_DAY, "w": 7 * MICROS_PER_DAY}


def first_by(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """One row of each partition, the first in order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def number(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str, start: int = 1, most: int = MOST) -> DataFrame:
    n = Running("_n", "count", F.lit(1))
    return Segments.of(df, key, order, most).running(n).with_columns({name: F.col("_n") - 1 + start}, "_n").frame()


def fill(df: DataFrame, cols: Sequence[str], key: str, order: Sequence[str], most: int = MOST) -> DataFrame:
    """Each null takes the subject's last value before it, else the first after it."""
    past = [Running(f"_p{i}", "last", F.col(c), "upto") for i, c in enumerate(cols)]
    future = [Running(f"_f{i}", "first", F.col(c), "from") for i, c in enumerate(cols)]
    made = {c: F.coalesce(F.col(f"_p{i}"), F.col(f"_f{i}")) for i, c in enumerate(cols)}
    return Segments.of(df, key, order, most).running(*past, *future).with_columns(made, *[s.name for s in (*past, *future)]).frame()


def gap_days(df: DataFrame, key: str, start: str, end: str, order: Sequence[str], name: str = "gap_days", most: int = MOST) -> DataFrame:
    """Days since the end of the subject's row before, 0 at least and for the first."""
    gap = F.greatest(F.lit(0), F.coalesce(F.datediff(F.col(start), F.col("_prev.v")), F.lit(0)))
    return Segments.of(df, key, order, most).running(previous(end)).with_columns({name: gap}, "_prev").frame()


def running_count(df: DataFrame, key: str, c: str, order: Sequence[str], name: str, most: int = MOST) -> DataFrame:
    """Values so far, without the row's own."""
    return Segments.of(df, key, order, most).running(Running("_n", "count", F.col(c))).with_columns({name: F.col("_n") - 1}, "_n").frame()


def spread_times(df: DataFrame, key: str, ts: str, order: Sequence[str], most: int = MOST) -> DataFrame:
    """Add a row's number within the subject as seconds, so that times differ."""
    later = F.timestamp_micros(micros(ts) + (F.col("_n") - 1) * 1_000_000)
    return Segments.of(df, key, order, most).running(Running("_n", "count", F.lit(1))).with_columns({ts: later}, "_n").frame()


def pick_random(df: DataFrame, key: str, order: Sequence[str], seed: int, most: int = MOST) -> DataFrame:
    """One row per subject by a hash of the subject: the same on any partitioning and engine."""
    marked = Segments.of(df, key, order, most).running(Running("_at", "count", F.lit(1)), Running("_n", "count", F.lit(1), "all")).frame()
    return marked.filter(F.col("_at") - 1 == portable_hash(key, seed) % F.col("_n")).drop("_at", "_n")


def parse_window(window: str) -> tuple[int | None, bool]:
    """``FULL``, ``-FULL``, ``7d``, ``-7d`` -> (length in microseconds or None, forward)."""
    forward = window.startswith("-")
    body = window.lstrip("-")
    return (None if body == "FULL" else int(body[:-1]) * UNITS[body[-1]]), forward


def summarize_over_window(df: DataFrame, key: str, ts: str, specs: Sequence[tuple[str, str]], windows: Sequence[str], tie: Sequence[str] = (), most: int = MOST, counted: DataFrame | None = None) -> DataFrame:
    """Columns ``window/name/agg`` for (column, agg) pairs; agg is count, has_values_count, sum, sum_sqd, min or max (count: rows
    whose column, a count itself, adds up).

    FULL: the first row to this one; -FULL: this one to the last; 7d: times in (t - 7d, t]; -7d: (t, t + 7d]. All windows of whole
    subjects share the exchange on the key; a cut subject is cut once for the FULL windows and once more for each rolling one."""

    def runs(window, frame):
        out = []
        for i, (c, agg) in enumerate(specs):
            v = F.col(c)
            ok = F.when(v.isNotNull() & ~F.isnan(v.cast("double")), v)
            op, value = {"count": ("count", v), "has_values_count": ("count", ok), "sum": ("sum", ok), "sum_sqd": ("sum", ok * ok), "min": ("min", ok), "max": ("max", ok)}[agg]
            out.append(Running(f"_w{windows.index(window)}_{i}", op, value, frame))
        return out

    parts = Segments.of(df.withColumn("_micros", micros(ts)), key, [ts, *[c for c in tie if c != ts]], most, counted)
    whole = [s for w in windows if parse_window(w)[0] is None for s in runs(w, "from" if parse_window(w)[1] else "upto")]
    if whole:
        parts = parts.running(*whole)
    for w in windows:
        length, forward = parse_window(w)
        if length is not None:
            parts = rolling(parts, key, "_micros", length, forward, runs(w, "upto"), most)
    rows = parts.frame()
    out = [key, ts, *[c for c in tie if c not in (key, ts)]]
    return rows.select(*out, *[F.col(f"_w{k}_{i}").alias(f"{w}/{c}/{agg}") for k, w in enumerate(windows) for i, (c, agg) in enumerate(specs)])


def times_in_sequence(events: DataFrame, key: str, ts: str, most: int = MOST) -> DataFrame:
    """Minutes since the subject's first event, and to its next one (NaN for the last)."""
    rows = Segments.of(events.withColumn("_t", micros(ts)), key, ["_t"], most).running(Running("_start", "min", F.col("_t"), "all"), following("_t"))
    delta = F.coalesce((F.col("_next.v") - F.col("_t")) / 60e6, F.lit(float("nan")))
    return rows.with_columns({"time": (F.col("_t") - F.col("_start")) / 60e6, "time_delta": delta}, "_t", "_start", "_next").frame()


def before_last(events: DataFrame, key: str, ts: str, condition: Column) -> DataFrame:
    """Per subject the last row before its last row that meets the condition, by two aggregates."""
    last = events.filter(condition).groupBy(F.struct(key).alias("_k")).agg(F.max(ts).alias("_last"))
    marked = events.join(last, F.struct(F.col(key)) == F.col("_k")).filter(F.col(ts) < F.col("_last")).drop("_k", "_last")
    return marked.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct(ts)).alias("_r")).select("_r.*")


def cumulative_ratio(df: DataFrame, by: str, order: str, a: str, b: str) -> DataFrame:
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(f"cum_{a}", F.sum(a).over(w)).withColumn(f"cum_{b}", F.sum(b).over(w)).withColumn("ratio", F.try_divide(F.col(f"cum_{a}"), F.col(f"cum_{b}")))


def offsets(df: DataFrame, size: str, order: Sequence[str]) -> DataFrame:
    """start and end of consecutive ranges; for small tables (one row for each variable)."""
    end = F.sum(size).over(W.partitionBy().orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("end", end).withColumn("start", end - F.col(size))


def mark_best(df: DataFrame, by: Sequence[str], score: str, larger: bool = True) -> DataFrame:
    w = W.partitionBy(*by)
    return df.withColumn("is_best", F.col(score) == (F.max(score) if larger else F.min(score)).over(w))


def distinct_over(df: DataFrame, by: Sequence[str], c: str, name: str) -> DataFrame:
    """Distinct values of a partition as a column, by an aggregate and a join."""
    n = df.groupBy(*by).agg(F.count_distinct(c).alias(name))
    return df.join(n, list(by), "left")
