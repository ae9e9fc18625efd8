"""Join operators. Which side is sent to all tasks is left to Spark, which checks sizes at run time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators.segments import MOST, Running, Segments


def lookup(df: DataFrame, dim: DataFrame, on: str, key: str, value: str, out: str | None = None, default=None, keep: bool = False) -> DataFrame:
    """Replace ``on`` through a table key -> value. Unmapped: ``default``, or with ``keep`` the value itself.
    The table's keys are unique."""
    d = dim.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    miss = F.col(on) if keep else F.lit(default)
    return df.join(d, F.col(on) == F.col("_key"), "left").withColumn(out or on, F.coalesce("_value", miss)).drop("_key", "_value")


def lookup_array(df: DataFrame, dim: DataFrame, arr: str, key: str, value: str, row_id: str, default=None) -> DataFrame:
    """``lookup`` for each element of an array column, keeping order. ``row_id`` is unique."""
    one = df.select(row_id, F.posexplode(arr).alias("_at", "_item"))
    mapped = lookup(one, dim, "_item", key, value, default=default)
    lists = mapped.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_item"))), lambda s: s["_item"]).alias("_list"))
    return df.join(lists, row_id, "left").withColumn(arr, F.when(F.size(arr) == 0, F.array().cast(lists.schema["_list"].dataType)).otherwise(F.col("_list"))).drop("_list")


def update(df: DataFrame, other: DataFrame, on: str | Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Overwrite columns by key where the other table has a value."""
    on = [on] if isinstance(on, str) else list(on)
    right = other.select(*on, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = df.join(right, on, "left")
    for c in cols:
        joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c))
    return joined.select(df.columns)


def align(dfs: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Full outer join of several tables on their common key, the key coalesced. Keys are unique in each."""
    on = [on] if isinstance(on, str) else list(on)
    return reduce(lambda a, b: a.join(b, on, "full"), dfs)


def point_in_time(df: DataFrame, index: DataFrame, key: str, ts: str, index_ts: str, lookback_months: int | None = None) -> DataFrame:
    """Rows at or before the subject's index date and, with a look-back, at or after its start."""
    joined = df.join(index.select(key, index_ts), key).filter(F.col(ts) <= F.col(index_ts))
    if lookback_months is not None:
        joined = joined.filter(F.col(ts) >= F.add_months(F.col(index_ts), -lookback_months))
    return joined


def with_static(df: DataFrame, subjects: DataFrame, key: str, cols: Sequence[str], add) -> DataFrame:
    """Join static columns, apply ``add`` (DataFrame -> DataFrame), drop them again."""
    own = [c for c in cols if c not in df.columns]
    return add(df.join(subjects.select(key, *own), key, "left")).drop(*own)


def rekey(measurements: DataFrame, merged: DataFrame, old: str = "event_id", olds: str = "old_event_ids") -> DataFrame:
    """Measurements under the ids of merged events; ``merged`` lists the old ids of each."""
    ids = merged.select(F.col(old).alias("_new"), F.explode(olds).alias("_old"))
    return measurements.join(ids, F.col(old) == F.col("_old")).withColumn(old, F.col("_new")).drop("_new", "_old")


def as_of(events: DataFrame, bounds: DataFrame, key: str, at: str, *columns: Running, first: str = "bounds", most: int = MOST, counted: DataFrame | None = None) -> DataFrame:
    """The rows of ``bounds`` with columns that run over the subject's ``events`` up to each bound: their number, the last of their values.

    Both are put into one table and ordered once by subject and ``at`` (``first``: which comes first at equal times), so the rows
    between operators are events and bounds, not pairs of them. ``columns`` read the events' columns, which are null on bounds.
    A null ``at`` of a bound comes before all events; events without a key or time are left out. Large subjects are cut;
    ``counted`` as in ``Segments.of``, for events and bounds together."""
    early = first == "bounds"
    both = bounds.withColumn("_event", F.lit(not early)).withColumn("_bound", F.lit(True))
    known = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_event", F.lit(early)).withColumn("_bound", F.lit(False))
    rows = both.unionByName(known, allowMissingColumns=True)
    seen = Segments.of(rows, key, [at, "_event"], most, counted).running(*columns).frame()
    return seen.filter("_bound").select(*bounds.columns, *[c.name for c in columns])


def task_positions(events: DataFrame, tasks: DataFrame, key: str = "subject_id", ts: str = "timestamp", start: str = "start_time", end: str = "end_time", most: int = MOST) -> DataFrame:
    """For each task row the half-open range [start_idx, end_idx) of the subject's events with start <= time < end,
    counting distinct event times in order. A null bound is open. ``tasks`` needs a unique ``task_id``."""
    times = events.select(key, micros(ts).alias("_at")).distinct().withColumn("_hit", F.lit(1))
    ends = F.array(F.struct(micros(start).alias("at"), F.lit(False).alias("last")), F.struct(F.coalesce(micros(end), F.lit(2**63 - 1)).alias("at"), F.lit(True).alias("last")))
    bounds = tasks.select("task_id", key, F.explode(ends).alias("_b")).select("task_id", key, F.col("_b.at").alias("_at"), F.col("_b.last").alias("_last"))
    placed = as_of(times, bounds, key, "_at", Running("_n", "count", F.col("_hit")), most=most)
    pick = lambda last: F.max(F.when(F.col("_last") == last, F.col("_n")))
    return placed.groupBy("task_id", key).agg(pick(False).alias("start_idx"), pick(True).alias("end_idx"))


def join_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys of an inner join, computed from counts by key without building it."""
    a, b = left.groupBy(key).agg(F.count("*").alias("_a")), right.groupBy(key).agg(F.count("*").alias("_b"))
    return a.join(b, key).agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))


def on_keys(left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "inner") -> DataFrame:
    """Join on columns with different names, left name -> right name; the left ones stay."""
    cond = [left[a] == right[b] for a, b in keys.items()]
    joined = left.join(right, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[right[b] for b in keys.values()])
