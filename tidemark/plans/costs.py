"""Costs: loading, inflation, winsorising, imputation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import quantile, wide
from tidemark.operators.filters import fold_rare, lower_names
from tidemark.operators.segments import MOST, Running, Segments
from tidemark.sources.shared import discard, materialize, scratch


def load(df: DataFrame, record: str, cost: str) -> DataFrame:
    """(record, cost): names lower-cased, cost as a number, one row per record (the largest cost)."""
    d = lower_names(df)
    return d.select(F.col(record.lower()).cast("string").alias("record"), F.col(cost.lower()).try_cast("double").alias("cost")).groupBy("record").agg(F.max("cost").alias("cost"))


def inflate(df: DataFrame, cost: str, year: str, cpi: DataFrame, ref_year: int, out: str = "adjusted") -> DataFrame:
    """Costs at the prices of ``ref_year``. ``cpi``: (year, cpi), a row for each year, which ``ref_year`` must be one of. Another
    year without an index gives null."""
    ref = cpi.filter(F.col("year") == ref_year).select(F.col("cpi").alias("_ref"))
    if ref.count() != 1:
        raise ValueError(f"cpi has not one row for {ref_year}")
    factors = cpi.join(F.broadcast(ref)).select(F.col("year").alias("_y"), (F.col("_ref") / F.col("cpi")).alias("_f"))  # one row on the right
    return df.join(factors, F.col(year) == F.col("_y"), "left").withColumn(out, F.col(cost) * F.col("_f")).drop("_y", "_f")


def winsorize(df: DataFrame, cost: str, low: float = 0.025, high: float = 0.975, interpolation: str = "nearest") -> DataFrame:
    """Costs beyond two quantiles become the quantile; both come from one aggregate."""
    q = quantile(df, cost, [low, high], interpolation=interpolation).toDF("_low", "_high")
    return df.join(F.broadcast(q)).withColumn(cost, F.when(F.col(cost).isNotNull(), F.least(F.greatest(F.col(cost), "_low"), "_high"))).drop("_low", "_high")  # one row


def impute(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], rare: int = 20, seed: int = 1, match: str | None = None, iterations: int = 20) -> DataFrame:
    """Fill missing targets by boosted trees fitted on the rows that have one; adds ``<target>_imputed``.

    With ``match`` (a unique id) a missing row takes the observed value of the row whose prediction is nearest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = fold_rare(df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in categorical}), categorical, rare)
    rows = rows.withColumns({f"_n_{c}": F.col(c).cast("double") for c in numeric})
    stages = [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep") for c in categorical]
    stages.append(Imputer(inputCols=[f"_n_{c}" for c in numeric], outputCols=[f"_m_{c}" for c in numeric], strategy="median"))
    stages.append(VectorAssembler(inputCols=[*[f"_m_{c}" for c in numeric], *[f"_i_{c}" for c in categorical]], outputCol="_x"))
    stages.append(GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="_p", maxIter=iterations, seed=seed, maxBins=256))
    known = rows.filter(F.col(target).isNotNull())
    scored = Pipeline(stages=stages).fit(known).transform(rows).withColumn(f"{target}_imputed", F.col(target).isNull())
    if match is None:
        return scored.withColumn(target, F.coalesce(target, "_p")).select(*df.columns, f"{target}_imputed")
    filled = _nearest_donor(scored, F.col(target), match)
    return filled.withColumn(target, F.coalesce(F.col(target), "_donor", F.col("_p"))).select(*df.columns, f"{target}_imputed")


def _nearest_donor(scored: DataFrame, value: Column, match: str, most: int = MOST) -> DataFrame:
    """Adds ``_donor``: the ``value`` of the row whose prediction ``_p`` is nearest among the rows that have one (the lower of two as near).
    Rows are one scan in the order of (prediction, ``match``), cut into segments when there are more than ``most``."""
    donor = F.when(value.isNotNull(), F.struct(F.col("_p").alias("p"), value.alias("y")))
    scan = Segments.of(scored.withColumn("_all", F.lit(0)), "_all", ["_p", match], most)
    rows = scan.running(Running("_before", "last", donor), Running("_after", "first", donor, "from")).frame("_all")
    near_before = F.col("_after").isNull() | (F.col("_p") - F.col("_before.p") <= F.col("_after.p") - F.col("_p"))
    return rows.withColumn("_donor", F.when(F.col("_before").isNotNull() & near_before, F.col("_before.y")).otherwise(F.col("_after.y"))).drop("_before", "_after")


def trees(nominal: bool, bins: int, seed: int):
    """The default models of chained equations: boosted trees for numbers, a forest for categories."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor

    if nominal:
        return RandomForestClassifier(numTrees=10, maxDepth=6, minInstancesPerNode=20, maxBins=bins, seed=seed)
    return GBTRegressor(maxIter=10, maxDepth=6, minInstancesPerNode=20, maxBins=bins, seed=seed)


#: Up to so many cells, counted, are sent to all tasks.
SENT = 200_000


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SENT else df


def _ends(rows: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """By column the upper ends of its cells but the last: all its values if there are at most ``bins`` of them, else exact quantiles of
    them, from which trees would choose their splits as well (MLlib takes them from a sample)."""
    near = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    own = {c: sorted(r[0] for r in rows.select(c).dropna().distinct().limit(bins + 1).collect()) for c in columns if near[c] <= 2 * bins}
    many = [c for c in columns if len(own.get(c, range(bins + 1))) > bins]
    cuts = wide(rows, {f"{i}_{k}": (c, k / bins, "lower") for i, c in enumerate(many) for k in range(1, bins)}).first() if many else {}
    return {c: sorted({cuts[f"{many.index(c)}_{k}"] for k in range(1, bins)}) if c in many else own[c][:-1] for c in columns}


def _celled(rows: DataFrame, ends: dict[str, list[float]]) -> DataFrame:
    """Adds ``_b_<column>``: the number of ends below the value."""
    from pyspark.ml.feature import Bucketizer

    cut = [c for c in ends if ends[c]]
    out = rows.withColumns({f"_b_{c}": F.lit(0.0) for c in ends if c not in cut})
    if not cut:
        return out
    splits = [[-math.inf, *[math.nextafter(e, math.inf) for e in ends[c]], math.inf] for c in cut]
    return Bucketizer(splitsArray=splits, inputCols=cut, outputCols=[f"_b_{c}" for c in cut]).transform(out)


def _weighted(estimator, weight: str, total: float, column: str = "_y"):
    """The estimator for rows that stand for ``weight`` rows each: a node needs as much weight as it needed rows."""
    least = estimator.getMinInstancesPerNode()
    out = estimator.copy().setWeightCol(weight).setMinInstancesPerNode(1).setFeaturesCol("_x").setLabelCol(column).setPredictionCol("_p")
    return out.setMinWeightFractionPerNode((least - 0.5) / total) if total >= 2 * least else out.setMaxDepth(0)


def _cell_numbers(cells: DataFrame, estimator) -> DataFrame:
    """Predictions ``_p`` for cells (_x, _w: known rows, _y: their mean): with squared errors the splits and leaves of trees are those of the rows."""
    return _weighted(estimator, "_w", cells.agg(F.sum("_w")).first()[0]).fit(cells.filter("_w > 0")).transform(cells)


def _cell_categories(cells: DataFrame, counts: DataFrame, estimator, classes: int, seed: int) -> DataFrame:
    """Predictions ``_p`` for ``cells`` (_x) by a forest over ``counts`` (_x, _y, _w, _h). A tree's bootstrap draws each row a Poisson(1) number of
    times, so ``_w`` equal rows together a Poisson(_w) number, here by the cell's hash ``_h``; the trees' shares of classes are averaged."""
    from pyspark.ml.functions import vector_to_array

    n = estimator.getNumTrees()

    @F.pandas_udf("array<double>")
    def draws(h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(x) & (2**64 - 1)]).poisson(y, n).astype(float) for x, y in zip(h, w, strict=True)])

    drawn = materialize(counts.withColumn("_k", draws("_h", "_w")), "draws")
    totals = drawn.agg(*[F.sum(F.col("_k")[i]).alias(f"k{i}") for i in range(n)]).first()
    one = estimator.copy().setNumTrees(1).setBootstrap(False)
    if one.getFeatureSubsetStrategy() == "auto":
        one = one.setFeatureSubsetStrategy("sqrt")  # what auto is for a forest
    votes, shares = cells, []
    label = drawn.schema["_y"].metadata
    for i in range(n):
        if not totals[f"k{i}"]:
            continue
        own = drawn.withColumn("_k", F.col("_k")[i]).filter("_k > 0").withColumn("_y", F.col("_y").alias("_y", metadata=label))
        tree = _weighted(one, "_k", totals[f"k{i}"]).setSeed(seed * 1000 + i).setProbabilityCol("_q").setRawPredictionCol("").fit(own)
        votes = tree.transform(votes).withColumn(f"_q{i}", vector_to_array("_q")).drop("_q", "_p")
        shares.append(f"_q{i}")
    summed = votes.withColumn("_s", F.array(*[sum((F.col(q)[j] for q in shares), F.lit(0.0)) for j in range(classes)]))
    return summed.withColumn("_p", (F.array_position("_s", F.array_max("_s")) - 1).cast("double")).drop("_s", *shares)


def _cell_donors(scored: DataFrame, sizes: DataFrame, value: Column, match: str, most: int = MOST) -> DataFrame:
    """Adds ``_donor`` as ``_nearest_donor`` does, where many rows have one prediction (``sizes``: (_p, _n) of all rows): inside a prediction the
    value of the row before by ``match`` that has one, else of the first; a prediction without values takes the nearer neighbour's."""
    edges = scored.filter(value.isNotNull()).groupBy(F.col("_p").alias("_e")).agg(F.min_by(value, match).alias("_first"), F.max_by(value, match).alias("_last"))
    each = sizes.groupBy("_p").agg(F.sum("_n").alias("_n"))
    known = each.join(edges, F.col("_p") == F.col("_e"), "left").select(F.lit(0).alias("_all"), "_p", "_first", "_last", F.col("_e").isNotNull().alias("_has"))
    near = lambda c: F.when(F.col("_has"), F.struct(F.col("_p").alias("p"), F.col(c).alias("y")))
    scan = Segments.of(materialize(known, "predictions"), "_all", ["_p"], most)
    ordered = scan.running(Running("_before", "last", near("_last"), "before"), Running("_after", "first", near("_first"), "after")).frame("_all")
    lower = F.col("_after").isNull() | (F.col("_p") - F.col("_before.p") <= F.col("_after.p") - F.col("_p"))
    other = F.when(F.col("_before").isNotNull() & lower, F.col("_before.y")).otherwise(F.col("_after.y"))
    fill = materialize(ordered.select(F.col("_p").alias("_e"), F.when(F.col("_has"), F.col("_first")).otherwise(other).alias("_fill")), "fills")
    rows = Segments.of(scored, "_p", [match], most, each.filter(F.col("_n") > most)).running(Running("_own", "last", value)).frame()
    joined = rows.join(_sent(fill, fill.count()), F.col("_p") == F.col("_e"), "left")
    return joined.withColumn("_donor", F.coalesce("_own", "_fill")).drop("_own", "_e", "_fill")


def chained(
    df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str] = (), rounds: int = 3, rare: int = 20, seed: int = 1, match: bool = True, model: Callable = trees, most: int = MOST
) -> tuple[DataFrame, list[dict[str, float]]]:
    """Fill the missing values of all the columns by chained equations. Gives ``df`` with them filled and ``<column>_imputed`` flags, and
    for each round the mean of the numbers filled in, by column.

    Missing numbers (null or NaN) start at the column's median, missing categories at the most frequent one. Then, ``rounds`` times,
    each incomplete column in turn (the fewest missing first, ties in the given order) is fitted by ``model(nominal, bins, seed)`` on the rows
    that have it, from the present values of all others, and its missing values are predicted anew. With ``match`` a number becomes
    the observed value whose prediction is nearest. ``key`` is a unique id without nulls.

    Categories of fewer than ``rare`` rows become "other"; numbers come out as doubles. A column without any value stays null and predicts
    nothing, and so does everything if fewer than two columns have values.

    The default models see a number as one of ``bins`` cells, as trees do (``_ends``, from its present values), so rows in the same cells are
    one row with a weight: they are counted in one pass over the table, and trees are fitted and read on the cells, of which there are at
    most as many as rows. A model of one's own is fitted on the rows. The table is written to the shared folder after each
    column and the one before deleted, so no plan grows with the rounds and a lost executor repeats one column at most."""
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    spark, others = df.sparkSession, [c for c in df.columns if c not in (key, *numeric, *categorical)]
    rows = df.select(key, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])
    rows = fold_rare(rows, categorical, rare)
    n = rows.agg(F.count("*").alias("*"), *[F.count(c).alias(c) for c in (*numeric, *categorical)]).first()
    used = [c for c in (*numeric, *categorical) if n[c]]
    todo = sorted((c for c in used if n[c] < n["*"]), key=lambda c: n["*"] - n[c]) if len(used) > 1 else []
    labels, meta = {}, {}
    for c in (c for c in categorical if c in used):
        indexer = StringIndexer(inputCol=c, outputCol="_i", handleInvalid="skip").fit(rows)  # by falling frequency, ties by name
        labels[c], meta[c] = indexer.labels, indexer.transform(rows).schema["_i"].metadata
        rows = indexer.setHandleInvalid("keep").transform(rows).withColumn(c, F.when(F.col(c).isNotNull(), F.col("_i"))).drop("_i")
    bins = max(64, *[len(x) + 1 for x in labels.values()], 64)
    middle = wide(rows, {f"m{i}": (c, 0.5, "lower") for i, c in enumerate(numeric) if c in todo}).first() if any(c in todo for c in numeric) else {}
    start = {c: 0.0 if c in labels else middle[f"m{list(numeric).index(c)}"] for c in todo}
    state = rows.withColumns({f"_miss_{c}": F.col(c).isNull() for c in (*numeric, *categorical)}).fillna(start)
    marked = lambda d: d.withColumns({c: F.col(c).alias(c, metadata=meta[c]) for c in labels})
    ends = _ends(rows, [c for c in numeric if c in used], bins) if todo and model is trees else None
    path, means = None, []

    def predicted(c: str, k: int) -> tuple[DataFrame, DataFrame | None]:
        """The rows with ``_p``; and (_p, _n), predictions and their numbers of rows, if they come by cells."""
        miss, estimator = F.col(f"_miss_{c}"), model(c in labels, bins, seed + k)
        if ends is None:
            d = VectorAssembler(inputCols=[x for x in used if x != c], outputCol="_x").transform(state)
            fitted = estimator.setFeaturesCol("_x").setLabelCol(c).setPredictionCol("_p").fit(d.filter(~miss))
            return fitted.transform(d).select(*state.columns, "_p"), None
        of = [x if x in labels else f"_b_{x}" for x in used if x != c]
        d = _celled(state, {x: e for x, e in ends.items() if x != c})
        shape = lambda t: VectorAssembler(inputCols=of, outputCol="_x").transform(t.withColumns({x: F.col(x).alias(x, metadata=meta[x]) for x in of if x in labels}))
        if c in labels:
            counts = materialize(d.groupBy(*of, F.when(~miss, F.col(c)).alias("_y")).agg(F.count("*").cast("double").alias("_w")), "cells")
            cells = counts.groupBy(*of).agg(F.sum("_w").cast("long").alias("_n"))
            known = shape(counts.filter("_y IS NOT NULL").withColumn("_h", F.xxhash64(*of, "_y")).withColumn("_y", F.col("_y").alias("_y", metadata=meta[c])))
            read = _cell_categories(shape(cells), known.select("_x", "_y", "_w", "_h"), estimator, len(labels[c]), seed + k)
        else:
            cells = d.groupBy(*of).agg(F.count("*").alias("_n"), F.count_if(~miss).cast("double").alias("_w"), F.avg(F.when(~miss, F.col(c))).alias("_y"))
            read = _cell_numbers(shape(materialize(cells, "cells")), estimator)
        found = materialize(read.select(*[F.col(x).alias(f"_c{i}") for i, x in enumerate(of)], "_p", "_n"), "cell-predictions")
        same = [F.col(x) == F.col(f"_c{i}") for i, x in enumerate(of)]
        return d.join(_sent(found.drop("_n"), found.count()), same).select(*state.columns, "_p"), found.select("_p", "_n")

    def write(d: DataFrame) -> DataFrame:
        nonlocal path
        old, path = path, scratch(spark, "chained")
        d.write.parquet(path)
        if old:
            discard(spark, old)
        return marked(spark.read.schema(d.schema).parquet(path))

    state = write(state)
    for k in range(rounds if todo else 0):
        for c in todo:
            miss = F.col(f"_miss_{c}")
            d, sizes = predicted(c, k)
            if match and c not in labels:
                value = F.when(~miss, F.col(c))
                d = (_nearest_donor(d, value, key, most) if sizes is None else _cell_donors(d, sizes, value, key, most)).withColumn("_p", F.col("_donor"))
            state = write(d.withColumn(c, F.when(miss, F.col("_p")).otherwise(F.col(c))).select(*state.columns))
        numbers = [c for c in todo if c not in labels]
        if numbers:
            means.append(state.agg(*[F.avg(F.when(F.col(f"_miss_{c}"), F.col(c))).alias(c) for c in numbers]).first().asDict())
    for c in labels:
        state = IndexToString(inputCol=c, outputCol="_s", labels=labels[c]).transform(state).withColumn(c, F.col("_s")).drop("_s")
    state = state.withColumnsRenamed({f"_miss_{c}": f"{c}_imputed" for c in (*numeric, *categorical)})
    return (df.select(key, *others).join(state, key) if others else state), means


def combine(parts: Sequence[DataFrame], keys: Sequence[str], record: str = "record") -> DataFrame:
    """Union of imputed sources with one record key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn(record, F.coalesce(*[F.col(k).cast("string") for k in keys])).drop(*[k for k in keys if k != record])
