"""Merging of overlapping or adjacent intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import MOST, Running, Segments, previous


def merge(df: DataFrame, key: str | Sequence[str], start: str, end: str, gap_days: int = 1, mode: str = "running_max", most: int = MOST) -> DataFrame:
    """One row per island: key, start, end, n. An interval joins the island while it starts at most ``gap_days`` after the
    latest end so far (``mode="previous_row"``: after the end of the row before). Needs start <= end; rows with nulls go.
    Equal intervals are in one island, whichever of them a window meets first. Subjects of more than ``most`` rows are cut into segments, which carry their latest end and their number of islands."""
    keys = [key] if isinstance(key, str) else list(key)
    known = df.select(*keys, F.col(start).cast("date").alias(start), F.col(end).cast("date").alias(end)).dropna(subset=[start, end])
    before = Running("_prev", "max", F.col(end), "before") if mode == "running_max" else previous(end)
    prev = F.col("_prev") if mode == "running_max" else F.col("_prev.v")
    rows = Segments.of(known, keys, [start, end], most).running(before)
    rows = rows.with_columns({"_new": (prev.isNull() | (F.col(start) > F.date_add(prev, gap_days))).cast("int")}, "_prev")
    marked = rows.running(Running("island", "sum", F.col("_new"), "peers")).frame()
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def total_days(df: DataFrame, key: str | Sequence[str], start: str, end: str, **how) -> DataFrame:
    """Days covered per subject, both ends counted."""
    keys = [key] if isinstance(key, str) else list(key)
    return merge(df, keys, start, end, **how).groupBy(*keys).agg(F.sum(F.datediff(end, start) + 1).alias("days"))
