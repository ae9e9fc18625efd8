"""Helpers that several corpus operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import discard, materialize, scratch, shared_dir  # noqa: F401  (operators take them from here)

#: A word is a run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows of a batch of whole texts (or sets) that a Python function gets, where memory is short.
BATCH_ROWS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, other letters unchanged."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as no word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def send_if_small(df: DataFrame, what: str, most: int = 500_000) -> DataFrame:
    """Write ``df`` (a few narrow columns) as a table and count it; up to ``most`` rows are sent to all tasks by the join
    that uses it, a larger one is left to a shuffle."""
    written = materialize(df, what)
    return F.broadcast(written) if written.count() <= most else written


def text_bytes(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes (None for null)."""
    import pyarrow as pa

    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def by_bytes(texts: list, limit: int = 2 << 20):
    """Bounds (low, high) of runs of texts of about ``limit`` bytes together; a single text may be longer."""
    low = held = 0
    for i, t in enumerate(texts, 1):
        held += len(t or b"")
        if held >= limit:
            yield low, i
            low, held = i, 0
    if low < len(texts):
        yield low, len(texts)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
