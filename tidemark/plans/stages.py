"""Stages for MLlib pipelines that MLlib lacks: fills from neighbours or by a constant, and non-negative factors of a vector.

They are fitted and applied like any other stage, but are not saved with ``write``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.base import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.neighbours import nearest
from tidemark.sources.shared import materialize


def number(c: str) -> Column:
    """The column as a double, NaN as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def solve(gram: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row the x >= 0 that minimises x G x - 2 b x, by coordinate descent until nothing moves."""
    x = np.zeros_like(b)
    for _ in range(500):
        moved = 0.0
        for i in np.flatnonzero(np.diag(gram) > 1e-12):
            new = np.maximum(0.0, x[:, i] + (b[:, i] - x @ gram[i]) / gram[i, i])
            moved = max(moved, float(np.abs(new - x[:, i]).max(initial=0.0)))
            x[:, i] = new
        if moved <= 1e-10 * (1 + np.abs(x).max(initial=0.0)):
            break
    return x


class _Imputer:
    """Columns of imputers: each input's filled column and, with ``indicator``, a 0/1 column of what was missing."""

    def filled(self) -> list[str]:
        return [f"{c}_filled" for c in self.cols]

    def outputs(self) -> list[str]:
        return self.filled() + ([f"{c}_missing" for c in self.cols] if self.indicator else [])

    def put(self, df: DataFrame, values: Sequence[Column]) -> DataFrame:
        flags = {f"{c}_missing": number(c).isNull().cast("double") for c in self.cols} if self.indicator else {}
        return df.withColumns(dict(zip(self.filled(), values, strict=True)) | flags)


class ConstantImputer(_Imputer, Transformer):
    """Nulls and NaNs become ``value``."""

    def __init__(self, cols: Sequence[str], value: float = 0.0, indicator: bool = True):
        super().__init__()
        self.cols, self.value, self.indicator = list(cols), float(value), indicator

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.put(df, [F.coalesce(number(c), F.lit(self.value)) for c in self.cols])


class NeighbourImputer(_Imputer, Estimator):
    """A missing value becomes the mean of the ``k`` nearest fitted rows that have it.

    Nearest is by the Euclidean distance of all other columns, in their own units, where missing ones count as the fitted mean; ties by
    ``key``, unique integers. Neighbours are exact (see ``neighbours``). A value is the column's fitted mean where there is no other
    column, and null where no fitted row has it. The fitted rows stay a table in the shared folder."""

    def __init__(self, key: str, cols: Sequence[str], k: int = 5, indicator: bool = True, block: int = 4096):
        super().__init__()
        self.key, self.cols, self.k, self.indicator, self.block = key, list(cols), k, indicator, block

    def rows(self, df: DataFrame) -> DataFrame:
        """(key, c0, c1 ...), written once, as each column reads it."""
        return materialize(df.select(F.col(self.key).cast("long").alias("key"), *[number(c).alias(f"c{i}") for i, c in enumerate(self.cols)]), "neighbour-rows")

    def _fit(self, df: DataFrame) -> NeighbourImputerModel:
        known = self.rows(df)
        means = list(known.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(self.cols))]).first())
        return NeighbourImputerModel(self, known, means)


class NeighbourImputerModel(Model):
    def __init__(self, by: NeighbourImputer, known: DataFrame, means: list):
        super().__init__()
        self.by, self.known, self.means = by, known, means

    def _others(self, i: int) -> Column:
        return F.array(*[F.coalesce(f"c{j}", F.lit(m if m is not None else 0.0)) for j, m in enumerate(self.means) if j != i])

    def _transform(self, df: DataFrame) -> DataFrame:
        by, rows, fills = self.by, self.by.rows(df), None
        gaps = rows.agg(*[F.count_if(F.col(f"c{i}").isNull()).alias(f"c{i}") for i in range(len(by.cols))]).first()
        found = [i for i, n in enumerate(gaps) if n and len(by.cols) > 1]
        for i in found:
            asks = rows.filter(F.col(f"c{i}").isNull()).select("key", self._others(i).alias("v"))
            known = self.known.filter(F.col(f"c{i}").isNotNull()).select(F.col("key").alias("other"), self._others(i).alias("v"), F.col(f"c{i}").alias("y"))
            one = nearest(asks, known, by.k, by.block).select("key", F.lit(i).alias("i"), "y")
            fills = one if fills is None else fills.unionByName(one)
        values = [F.lit(m).cast("double") for m in self.means]
        if fills is None:
            return by.put(df, [F.coalesce(number(c), v) for c, v in zip(by.cols, values, strict=True)])
        per = fills.groupBy(F.col("key").alias("_key")).agg(*[F.avg(F.when(F.col("i") == i, F.col("y"))).alias(f"_fill{i}") for i in found])
        joined = df.join(per, F.col(by.key).cast("long") == F.col("_key"), "left")
        values = [F.coalesce(number(c), F.col(f"_fill{i}"), v) if i in found else F.coalesce(number(c), v) for i, (c, v) in enumerate(zip(by.cols, values, strict=True))]
        return by.put(joined, values).drop("_key", *[f"_fill{i}" for i in found])


def _sums(h: np.ndarray):
    """Sums of a partition's rows by position: W'W, W'X and the squared error, where W are the rows' best factors under ``h``."""
    gram = h @ h.T

    def sums(parts):
        total = np.zeros(h.shape[0] ** 2 + h.size + 1)
        for part in parts:
            if len(part):
                x = np.stack(part["x"].to_list())
                w = solve(gram, x @ h.T)
                total += np.concatenate(((w.T @ w).ravel(), (w.T @ x).ravel(), [((x - w @ h) ** 2).sum()]))
        yield pd.DataFrame({"at": np.arange(len(total)), "v": total})

    return sums


def _worst(h: np.ndarray):
    """A partition's row that is farthest from what ``h`` can make, ties by its values, with its squared distance."""

    def worst(parts):
        best = None
        for part in parts:
            if len(part):
                x = np.stack(part["x"].to_list())
                r = ((x - solve(h @ h.T, x @ h.T) @ h) ** 2).sum(axis=1)
                found = max((float(r[i]), x[i].tolist()) for i in np.flatnonzero(r == r.max()))
                best = found if best is None else max(best, found)
        if best is not None:
            yield pd.DataFrame({"r": [best[0]], "x": [best[1]]})

    return worst


class NonNegativeFactors(Estimator):
    """Factors W H of the rows of a non-negative vector column, ``k`` of each row, with W, H >= 0.

    H starts from rows of the table, each the farthest from what those before it can make. A round is one pass: rows are solved for where they are, and their sums over k x k and k x columns numbers give the next H. The
    squared error (``errors`` of the model) never rises; rounds end when it falls by less than the share ``least`` of the whole. Values below
    zero, NaN and null vectors are refused. An empty table gives factors of zero."""

    def __init__(self, inputCol: str, outputCol: str, k: int = 2, rounds: int = 50, least: float = 1e-5):
        super().__init__()
        self.inputCol, self.outputCol, self.k, self.rounds, self.least = inputCol, outputCol, k, rounds, least

    def _fit(self, df: DataFrame) -> NonNegativeFactorsModel:
        rows = materialize(df.select(vector_to_array(F.col(self.inputCol)).alias("x")), "vectors")
        ok = F.col("x").isNotNull() & F.forall("x", lambda v: (v >= 0) & ~F.isnan(v))
        square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
        r = rows.agg(F.max(F.size("x")).alias("d"), F.count_if(~ok).alias("bad"), F.sum(square).alias("ss")).first()
        if r["bad"]:
            raise ValueError(f"{r['bad']} vectors of {self.inputCol} are null, NaN or below zero")
        d, whole, k = r["d"] or 0, r["ss"] or 0.0, self.k
        h = np.zeros((0, d))
        while len(h) < k and whole:
            far = rows.mapInPandas(_worst(h), "r double, x array<double>").agg(F.max(F.struct("r", "x"))).first()[0]  # one row
            if far["r"] <= 1e-12 * whole:
                break
            h = np.concatenate((h, [np.array(far["x"])]))
        h = np.concatenate((h, np.zeros((k - len(h), d))))  # rows of fewer factors than k need no more
        errors = []
        for _ in range(self.rounds if whole else 0):
            found = rows.mapInPandas(_sums(h), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k x (k + columns) + 1 numbers
            total = np.array([v for _, v in sorted(map(tuple, found))])
            errors.append(float(total[-1]))
            if len(errors) > 1 and errors[-2] - errors[-1] < self.least * whole:
                break
            h = solve(total[: k * k].reshape(k, k), total[k * k : -1].reshape(k, d).T.copy()).T
        return NonNegativeFactorsModel(self.inputCol, self.outputCol, h, errors)


class NonNegativeFactorsModel(Model):
    def __init__(self, inputCol: str, outputCol: str, h: np.ndarray, errors: list):
        super().__init__()
        self.inputCol, self.outputCol, self.h, self.errors = inputCol, outputCol, h, errors

    def _transform(self, df: DataFrame) -> DataFrame:
        h = self.h

        @F.pandas_udf("array<double>")
        def factors(x: pd.Series) -> pd.Series:
            if not len(x) or not h.size:
                return pd.Series([np.zeros(len(h))] * len(x), dtype=object)
            return pd.Series(list(solve(h @ h.T, np.stack(x.to_list()) @ h.T)))

        return df.withColumn(self.outputCol, array_to_vector(factors(vector_to_array(F.col(self.inputCol)))))
