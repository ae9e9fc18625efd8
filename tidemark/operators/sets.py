"""Unions, distinct rows, key sets, repeatable order and choice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import portable_hash


def diagonal(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union of all columns; a table without a column gives null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def relaxed(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union of equal columns, each in the widest of its types."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def distinct_on(df: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row in order of each combination of ``cols``."""
    return df.groupBy(*cols).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def key_minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def key_and(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def key_or(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that depends on nothing but key and seed."""
    return df.orderBy(portable_hash(key, seed), key)


def nearest_row(df: DataFrame, key: str, c: str, target: float, tie: str) -> DataFrame:
    """Per key the row whose value is closest to the target, the smallest tie key first."""
    row = F.min_by(F.struct(*df.columns), F.struct(F.abs(F.col(c) - target), F.col(tie)))
    return df.groupBy(key).agg(row.alias("_r")).select("_r.*")
