"""Exact nearest neighbours by a pivot index, in two rounds.

Known rows are dealt by their nearest pivot and the distance to it to rings of about ``block`` rows, and each ring knows the range of its
rows' distances to every pivot. By the triangle inequality a ring can be skipped where its least possible distance to a row is
above the distance of that row's k-th best so far. The first round visits each row's nearest rings until they hold k rows; the second those that may still hold a better one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import materialize


class _Rings:
    """Pivots and the table of rings: a row for each, so known rows / ``block`` of them."""

    def __init__(self, pivots: np.ndarray, rings: Sequence):
        self.pivots = pivots
        self.ids = np.array([r["ring"] for r in rings])
        self.low, self.high = (np.array([r[c] for r in rings], dtype=float).reshape(len(rings), len(pivots)) for c in ("low", "high"))
        self.size = np.array([r["n"] for r in rings], dtype=float)

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(((v[:, None, :] - self.pivots[None]) ** 2).sum(axis=2))

    def least(self, d: np.ndarray) -> np.ndarray:
        """The least distance that a row with these distances to the pivots can have to a row of each ring."""
        bound = np.maximum(d[None] - self.high, self.low - d[None]) - 1e-9 * (1 + d[None] + self.high)  # rounding must not hide a ring
        return np.maximum(bound.max(axis=1), 0.0)

    def first(self, d: np.ndarray, k: int) -> np.ndarray:
        """The rings of the first visit."""
        order = np.lexsort((self.ids, np.abs(d[None] - (self.low + self.high) / 2).sum(axis=1), self.least(d)))
        enough = int(np.searchsorted(np.cumsum(self.size[order]), k)) + 1
        return order[:enough]


def _compare(k: int):
    def compare(asks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"key": [], "other": [], "d": [], "y": [], "compared": []})
        if asks.empty or known.empty:
            return empty
        a, b = np.stack(asks["v"].to_list()), np.stack(known["v"].to_list())
        keys, others, ys = asks["key"].to_numpy(), known["other"].to_numpy(), known["y"].to_numpy()
        out = []
        for low in range(0, len(a), 1024):
            part = a[low : low + 1024]
            scale = (part**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None]
            near = scale - 2 * (part @ b.T)
            top = min(k, len(b))
            kth = np.partition(near, top - 1, axis=1)[:, top - 1 : top]
            i, j = np.nonzero(near <= kth + 1e-9 * (1 + scale))  # the product rounds: what may tie is measured again
            d = np.sqrt(((part[i] - b[j]) ** 2).sum(axis=1))
            order = np.lexsort((others[j], d, i))
            i, j, d = i[order], j[order], d[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, d = (x[rank < top] for x in (i, j, d))
            out.append(pd.DataFrame({"key": keys[low + i], "other": others[j], "d": d, "y": ys[j], "compared": len(b)}))
        return pd.concat(out)

    return compare


def nearest(asks: DataFrame, known: DataFrame, k: int = 5, block: int = 4096, pivots: int = 16) -> DataFrame:
    """(key, other, d, y, compared): for each row of ``asks`` (key, v) the ``k`` rows of ``known`` (other, v, y) at the least Euclidean distance, ties
    by ``other``; ``compared`` is the number of known rows that the row was compared with, all visits together.

    Keys are integers and unique. Fewer known rows than ``k`` give as many. No task holds more than about a ring and ``block`` rows of
    ``asks``; rows that visit one ring are dealt to several tasks. What is broadcast is the pivots and a row for each ring."""
    spark = asks.sparkSession
    schema = "key long, other long, d double, y double, compared long"
    chosen = known.orderBy(F.xxhash64("other"), "other").limit(pivots).select("v").collect()
    if not chosen:
        return spark.createDataFrame([], schema)
    points = np.unique(np.array([r["v"] for r in chosen], dtype=float), axis=0)
    bare = _Rings(points, [])

    def index(parts: Iterator[pd.DataFrame]):
        for part in parts:
            if len(part):
                d = bare.distances(np.stack(part["v"].to_list()))
                yield part.assign(p=d.argmin(axis=1).astype("int32"), d=d.min(axis=1), ds=list(d))

    n = known.count()
    placed = known.select("other", "v", "y").mapInPandas(index, "other long, v array<double>, y double, p int, d double, ds array<double>")
    placed = materialize(placed.repartitionByRange(-(-n // block), "p", "d", F.xxhash64("other")).withColumn("part", F.spark_partition_id()), "rings")
    table = placed.groupBy("p", "part").agg(*[F.array(*[f(F.col("ds")[j]) for j in range(len(points))]).alias(c) for c, f in (("low", F.min), ("high", F.max))], F.count("*").alias("n")).orderBy("p", "part").collect()  # a row for each ring
    table = [r.asDict() | {"ring": i} for i, r in enumerate(table)]
    rings = _Rings(points, table)
    names = spark.createDataFrame([(r["p"], r["part"], r["ring"]) for r in table], "rp int, rpart int, ring int")
    members = placed.join(names, (F.col("p") == F.col("rp")) & (F.col("part") == F.col("rpart"))).select("ring", "other", "v", "y")

    def visit(later: bool):
        def rows(parts: Iterator[pd.DataFrame]):
            for part in parts:
                if not len(part):
                    continue
                dist = rings.distances(np.stack(part["v"].to_list()))
                seen = []
                for i, d in enumerate(dist):
                    first = rings.first(d, k)
                    if later:
                        want = np.flatnonzero(rings.least(d) <= part["bound"].iloc[i])
                        first = want[~np.isin(want, first)]
                    seen.append(rings.ids[first])
                at = np.repeat(np.arange(len(part)), [len(s) for s in seen])
                yield pd.DataFrame({"key": part["key"].to_numpy()[at], "v": part["v"].to_numpy()[at], "ring": np.concatenate(seen).astype("int32") if seen else []})

        return rows

    def met(visits: DataFrame) -> DataFrame:
        visits = materialize(visits, "visits")
        counts = visits.groupBy(F.col("ring").alias("cr")).agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))  # a row for each ring
        left = visits.join(counts, F.col("ring") == F.col("cr")).select("ring", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"), "key", "v")
        right = members.join(counts, F.col("ring") == F.col("cr")).select("ring", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "other", "v", "y")
        return left.groupBy("ring", "chunk").cogroup(right.groupBy("ring", "chunk")).applyInPandas(_compare(k), schema)

    order = W.partitionBy("key").orderBy("d", "other")
    best = lambda df: df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
    one = met(asks.select("key", "v").mapInPandas(visit(False), "key long, v array<double>, ring int"))
    one = materialize(one, "first-visits")
    bounds = best(one).groupBy(F.col("key").alias("bk")).agg(F.when(F.count("*") == k, F.max("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    two = met(asks.join(bounds, F.col("key") == F.col("bk")).select("key", "v", "bound").mapInPandas(visit(True), "key long, v array<double>, ring int"))
    # A ring of n rows that was visited gave min(n, k) rows, each of which stands for n / min(n, k) comparisons.
    total = F.sum(F.col("compared") / F.least(F.col("compared"), F.lit(k))).over(W.partitionBy("key"))
    return best(one.unionByName(two).withColumn("compared", F.round(total).cast("long")))
