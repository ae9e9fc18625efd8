"""Folds, cross-validated MLlib models, and configurable pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import portable_hash
from tidemark.operators.neighbours import nearest
from tidemark.plans.stages import ConstantImputer, NeighbourImputer, NonNegativeFactors, solve
from tidemark.sources.shared import materialize


def folds(df: DataFrame, key: str, label: str | None, k: int, seed: int) -> DataFrame:
    """(key, fold): rows numbered in the order of a hash, within each label if given, modulo k. The numbering runs in
    buckets of the hash that go on counting from one another, so no label is numbered in one task."""
    by = [label] if label else []
    rows = df.select(key, *by).withColumn("_h", portable_hash(key, seed)).withColumn("_b", F.shiftright("_h", 22))
    n = rows.groupBy(*by, "_b").count()  # 1,024 buckets at most for each label
    before = F.coalesce(F.sum("count").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = n.select(*by, "_b", before.alias("_before"))
    rn = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_h", key)) - 1
    joined = rows.withColumn("_rn", rn).join(F.broadcast(offsets), [*by, "_b"])
    return joined.select(key, ((F.col("_before") + F.col("_rn")) % k).cast("int").alias("fold"))


def models(seed: int = 1) -> dict:
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    return {
        "logistic": LogisticRegression(maxIter=30),
        "elastic_net": LogisticRegression(maxIter=30, regParam=0.01, elasticNetParam=0.5),
        "boosted": GBTClassifier(maxIter=10, maxDepth=3, seed=seed),
        "forest": RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed),
        "prior": None,
    }


def cross_validate(df: DataFrame, key: str, features: str, label: str, fold_of: DataFrame, use: Mapping, path: str | None = None) -> DataFrame:
    """Out-of-fold predictions (key, y, p, model, fold) of each model; with ``path`` also written by model and fold.

    ``None`` as a model predicts the share of positives of the training folds."""
    from pyspark.ml.functions import vector_to_array

    rows = df.select(key, features, F.col(label).cast("double").alias("label")).join(fold_of, key).withColumnRenamed(features, "features")
    rows = materialize(rows, "folds")  # each fold and model reads them
    k = [r[0] for r in fold_of.select("fold").distinct().orderBy("fold").collect()]  # the folds
    out = None
    for name, model in use.items():
        for f in k:
            train, test = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
            if model is None:
                p = F.lit(train.agg(F.avg("label")).first()[0])
                scored = test.select(key, F.col("label").alias("y"), p.alias("p"))
            else:
                scored = model.fit(train).transform(test).select(key, F.col("label").alias("y"), F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
            scored = scored.select("*", F.lit(name).alias("model"), F.lit(f).cast("int").alias("fold"))
            out = scored if out is None else out.unionByName(scored)
    if path:
        out.write.partitionBy("model", "fold").parquet(path)
        return df.sparkSession.read.parquet(path)
    return out


def stages(config: Sequence[tuple[str, Mapping]], features: Sequence[str], label: str = "label"):
    """An MLlib pipeline from (name, options): impute, constant or neighbours; standard, minmax, pca, factors, select; and a model by name.

    ``constant`` and ``neighbours`` (which needs ``key``) add columns of what was missing unless ``indicator`` is false."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, Imputer, MinMaxScaler, StandardScaler, UnivariateFeatureSelector, VectorAssembler

    out, cols = [], list(features)
    names = dict(config)
    if "impute" in names:
        filled = [f"{c}_filled" for c in cols]
        out.append(Imputer(inputCols=cols, outputCols=filled, **names["impute"]))
        cols = filled
    for name, kind in (("constant", ConstantImputer), ("neighbours", NeighbourImputer)):
        if name in names:
            out.append(kind(cols=cols, **names[name]))
            cols = out[-1].outputs()
    out.append(VectorAssembler(inputCols=cols, outputCol="_v0", handleInvalid="keep"))
    at = "_v0"
    for i, (name, options) in enumerate(config, 1):
        to = f"_v{i}"
        if name in ("impute", "constant", "neighbours"):
            continue
        if name == "standard":
            out.append(StandardScaler(inputCol=at, outputCol=to, withMean=True, **options))
        elif name == "minmax":
            out.append(MinMaxScaler(inputCol=at, outputCol=to, **options))
        elif name == "pca":
            out.append(PCA(inputCol=at, outputCol=to, **options))
        elif name == "factors":
            out.append(NonNegativeFactors(inputCol=at, outputCol=to, **options))
        elif name == "select":
            top = options.get("k", 10)
            out.append(UnivariateFeatureSelector(featuresCol=at, outputCol=to, labelCol=label, selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(top))
        else:
            out.append(models()[name].copy().setFeaturesCol(at).setLabelCol(label))
            continue
        at = to
    return Pipeline(stages=out)


def constant_impute(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """Fill nulls and NaNs with a constant and add 0/1 indicators ``<c>_missing``."""
    miss = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return df.withColumns({f"{c}_missing": miss(c).cast("int") for c in cols}).withColumns({c: F.when(miss(c), F.lit(value)).otherwise(F.col(c)) for c in cols})


def knn_impute(df: DataFrame, key: str, target: str, vector: str, k: int = 5, block: int = 4096) -> DataFrame:
    """Fill missing targets with the mean target of the k nearest known rows (Euclidean, ties by ``key``, an integer).

    ``vector`` is an array column. Neighbours are exact; only blocks of known rows that can hold one are compared (see
    ``neighbours``). Without a known row targets stay null."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y"))
    known = rows.filter(F.col("y").isNotNull()).withColumnRenamed("key", "other")
    best = nearest(rows.filter(F.col("y").isNull()), known, k, block)
    fill = best.groupBy(F.col("key").alias("_key")).agg(F.avg("y").alias("_fill"))
    return df.join(fill, F.col(key).cast("long") == F.col("_key"), "left").withColumn(target, F.coalesce(target, "_fill")).drop("_fill", "_key")


def _nonnegative(gram: np.ndarray):
    """Each row's best factors, and by how much they lower the error."""

    def rows(parts):
        for part in parts:
            if len(part):
                b = np.stack(part["b"].to_list())
                x = solve(gram, b)
                yield pd.DataFrame({"id": part["id"], "x": list(x), "fit": 2 * (b * x).sum(axis=1) - ((x @ gram) * x).sum(axis=1)})

    return rows


def factors(df: DataFrame, row: str, col: str, value: str, rank: int = 4, seed: int = 1, rounds: int = 30, least: float = 1e-4) -> tuple[DataFrame, DataFrame, list[float]]:
    """Non-negative factorisation of a long (row, column, value) table whose other entries are zero: (id, x) of rows and of columns, and the
    squared error after each round, which never rises.

    Rows and columns are solved for in turn. One side's best values depend on its entries' sums over the other side's factors and on
    that side's ``rank`` x ``rank`` Gram matrix alone, so a half round is a join, an aggregate and a solution row by row; its factors are
    written to the shared folder. Ends when a round lowers the error by less than the share ``least`` of the whole."""
    entries = materialize(df.filter(F.col(value).isNotNull()).groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(F.sum(F.col(value).cast("double")).alias("v")), "entries")
    square = entries.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    kind = {c: entries.schema[c].dataType.simpleString() for c in "rc"}
    start = F.array(*[portable_hash(F.concat_ws("/", F.col("r").cast("string"), F.lit(i)), seed) / float(2**32) + 0.1 for i in range(rank)])
    left = materialize(entries.select("r").distinct().select(F.col("r").alias("id"), start.alias("x")), "factors")
    right, errors = None, []

    def half(known: DataFrame, on: str, other: str) -> tuple[DataFrame, float]:
        outer = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i in range(rank) for j in range(rank)]
        gram = np.array([v or 0.0 for v in known.agg(*outer).first()], dtype=float).reshape(rank, rank)
        sums = entries.join(known, F.col(on) == F.col("id")).groupBy(F.col(other).alias("id")).agg(F.array(*[F.sum(F.col("v") * F.col("x")[i]) for i in range(rank)]).alias("b"))
        found = materialize(sums.mapInPandas(_nonnegative(gram), f"id {kind[other]}, x array<double>, fit double"), "factors")
        return found.select("id", "x"), square - (found.agg(F.sum("fit")).first()[0] or 0.0)

    for _ in range(rounds):
        right, _ = half(left, "r", "c")
        left, error = half(right, "c", "r")
        errors.append(max(0.0, error))
        if len(errors) > 1 and errors[-2] - errors[-1] < least * square:
            break
    return left, right, errors


def factorise(df: DataFrame, row: str, col: str, value: str, rank: int = 4, seed: int = 1) -> DataFrame:
    """(row, features): the non-negative factors of the rows."""
    return factors(df, row, col, value, rank, seed)[0].select(F.col("id").alias(row), F.col("x").alias("features"))


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """(feature, mi) in nats from the counts of equal-width bins and label values, in one pass over all features."""
    r = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(features) for f, p in ((F.min, "l"), (F.max, "h"))]).first()
    def code(i, c):
        low, high = float(r[f"l{i}"]), float(r[f"h{i}"])
        return F.least(F.floor((F.col(c) - low) / ((high - low) or 1.0) * bins), F.lit(bins - 1)).cast("int")
    items = F.array(*[F.struct(F.lit(c).alias("feature"), code(i, c).alias("x")) for i, c in enumerate(features)])
    n = df.select(F.col(label).alias("y"), F.explode(items).alias("f")).groupBy("f.feature", "f.x", "y").count()
    w = W.partitionBy("feature")
    total, nx, ny = F.sum("count").over(w), F.sum("count").over(W.partitionBy("feature", "x")), F.sum("count").over(W.partitionBy("feature", "y"))
    return n.withColumn("t", F.col("count") / total * F.ln(F.col("count") * total / (nx * ny))).groupBy("feature").agg(F.sum("t").alias("mi"))


def project(df: DataFrame, key: str, arr: str, k: int = 2) -> DataFrame:
    """(key, c1 .. ck): principal components of an array column."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select(key, array_to_vector(F.col(arr).cast("array<double>")).alias("_v"))
    out = PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v)
    return out.select(key, *[F.get(vector_to_array("_p"), F.lit(i)).alias(f"c{i + 1}") for i in range(k)])
