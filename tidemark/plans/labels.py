"""Outcome labels over horizons after an index date. Rows have (key, start, end); the index has (key, index_date)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals


def horizons(index: DataFrame, months: Mapping[str, int], index_date: str = "index_date") -> DataFrame:
    """A row for each subject and horizon: horizon, endpoint (calendar months after the index)."""
    items = [F.struct(F.lit(n).alias("horizon"), F.add_months(F.col(index_date), m).alias("endpoint")) for n, m in months.items()]
    return index.withColumn("_h", F.explode(F.array(*items))).select(*index.columns, "_h.*")


def _zero_filled(base: DataFrame, found: DataFrame, on: Sequence[str], c: str) -> DataFrame:
    return base.select(*on).join(found, list(on), "left").withColumn(c, F.coalesce(F.col(c), F.lit(0)))


def episode_count(df: DataFrame, index: DataFrame, months: Mapping[str, int], key: str = "subject", start: str = "start") -> DataFrame:
    """Episodes that start in (index, endpoint], for every horizon in one pass."""
    base = horizons(index, months)
    hit = (F.col(start) > F.col("index_date")) & (F.col(start) <= F.col("endpoint"))
    found = df.select(key, start).join(base, key).filter(hit).groupBy(key, "horizon").agg(F.count("*").alias("n_episodes"))
    return _zero_filled(base, found, [key, "horizon"], "n_episodes")


def _after(df: DataFrame, base: DataFrame, key: str, start: str) -> DataFrame:
    return df.join(base, key).filter((F.col(start) > F.col("index_date")) & (F.col(start) <= F.col("endpoint")))


def length_of_stay(df: DataFrame, index: DataFrame, months: Mapping[str, int], key: str = "subject", start: str = "start", end: str = "end", cap: int | None = None) -> DataFrame:
    """Days in hospital after the index: ends are cut at the endpoint, overlaps merged, both ends counted, zero for none, capped."""
    base = horizons(index, months)
    rows = _after(df.select(key, start, end), base, key, start).withColumn(end, F.least(end, "endpoint"))
    days = intervals.total_days(rows, [key, "horizon"], start, end)
    out = _zero_filled(base, days, [key, "horizon"], "days")
    return out.withColumn("days", F.least("days", F.lit(cap))) if cap is not None else out


def cost(df: DataFrame, index: DataFrame, months: Mapping[str, int], key: str = "subject", start: str = "start", end: str = "end", amount: str = "cost") -> DataFrame:
    """Cost after the index: whole for stays that end by the endpoint, else the share of its days (at least one) before it."""
    base = horizons(index, months)
    rows = _after(df.select(key, start, end, amount), base, key, start)
    days = F.greatest(F.datediff(end, start), F.lit(1))
    part = F.when(F.col(end) <= F.col("endpoint"), F.col(amount)).otherwise(F.col(amount) * F.datediff("endpoint", start) / days)
    found = rows.groupBy(key, "horizon").agg(F.sum(part).alias("cost"))
    return _zero_filled(base, found, [key, "horizon"], "cost")


def label_matrix(df: DataFrame, index: DataFrame, months: Mapping[str, int], key: str = "subject", start: str = "start", end: str = "end", amount: str = "cost", cap: int | None = None) -> DataFrame:
    """Count, days and cost for every subject and horizon. Only the days need the ordered merge; count and cost share one aggregate."""
    base = horizons(index, months)
    rows = _after(df.select(key, start, end, amount), base, key, start)
    stay = F.greatest(F.datediff(end, start), F.lit(1))
    part = F.when(F.col(end) <= F.col("endpoint"), F.col(amount)).otherwise(F.col(amount) * F.datediff("endpoint", start) / stay)
    sums = rows.groupBy(key, "horizon").agg(F.count("*").alias("n_episodes"), F.sum(part).alias("cost"))
    days = intervals.total_days(rows.withColumn(end, F.least(end, "endpoint")), [key, "horizon"], start, end)
    out = base.select(key, "horizon").join(sums, [key, "horizon"], "left").join(days, [key, "horizon"], "left").fillna(0, ["n_episodes", "cost", "days"])
    return out.withColumn("days", F.least("days", F.lit(cap))) if cap is not None else out
