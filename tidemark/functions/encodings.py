"""Dense integer codes of labels and cutoffs of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import materialize


#: Rows of a range that is numbered in one task.
RANGE = 1_000_000


def number_rows(df: DataFrame, order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in a global order, without a window over all rows: rows are dealt to ranges by sampled splitters and written,
    sorted, with the number of their range; each range is numbered by itself, after the sizes of the ranges before it (a row
    for each range). Rows that tie are numbered in any order, the same whenever the result is read again."""
    df = materialize(df, "to-number")  # counted and numbered without making it twice
    ranges = -(-df.count() // RANGE)
    if ranges > 1:
        df = materialize(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    else:
        df = df.withColumn("_range", F.lit(0))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order)) + F.lit(start - 1)
    if ranges <= 1:
        return df.withColumn(name, inside.cast("long")).drop("_range")
    sizes = df.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = sizes.select("_r", (F.sum("_n").over(W.orderBy("_r")) - F.col("_n")).alias("_before"))  # a row for each range
    return df.withColumn(name, inside).join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_r", "_before")


def dense_index(df: DataFrame, c: str) -> DataFrame:
    """(value, idx) of the sorted distinct values, from 0; of any number of them."""
    return number_rows(df.select(c).filter(F.col(c).isNotNull()).distinct(), [F.col(c).asc()], "idx").select(c, F.col("idx").cast("int").alias("idx"))


def to_int_index(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """Replace a column by its dense index; null stays null."""
    idx = dense_index(df, c).withColumnRenamed(c, "_v")
    return df.join(idx, F.col(c) == F.col("_v"), "left").withColumn(out or c, F.col("idx")).drop("_v", "idx")


def normalise_label(df: DataFrame, c: str) -> DataFrame:
    """Booleans to 0.0/1.0, text to a dense index, numbers unchanged."""
    kind = dict(df.dtypes)[c]
    if kind == "boolean":
        return df.withColumn(c, F.col(c).cast("int").cast("float"))
    return to_int_index(df, c) if kind == "string" else df


def threshold_label(df: DataFrame, c: str, high: bool, q: float = 0.9, threshold: float | None = None) -> DataFrame:
    """Boolean label: over the q quantile (nearest observed value) with ``high``, else over 0; the value stays as ``<c>_raw``."""
    from tidemark.functions.quantiles import quantile

    raw = f"{c}_raw"
    df = df.withColumn(raw, F.col(c))
    if threshold is not None or not high:
        return df.withColumn(c, F.col(raw) > (threshold if threshold is not None else 0))
    cut = quantile(df, raw, q)
    cut = cut.select(F.col(cut.columns[0]).alias("_cut"))
    return df.join(F.broadcast(cut)).withColumn(c, F.col(raw) > F.col("_cut")).drop("_cut")  # one row
