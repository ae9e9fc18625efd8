"""Chained equations against the same rounds in numpy, and on planted rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import costs


def linear(nominal, bins, seed):
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(solver="normal", standardization=False)


def chain(x, rounds, match):
    """The rounds in numpy: columns by their number of missing values, least squares from all others, nearest prediction's value."""
    x, miss = x.copy(), np.isnan(x)
    order = sorted((c for c in range(x.shape[1]) if miss[:, c].any()), key=lambda c: miss[:, c].sum())
    for c in order:
        own = np.sort(x[~miss[:, c], c])
        x[miss[:, c], c] = own[max(int(np.ceil(len(own) * 0.5 - 1e-9)) - 1, 0)]
    means = []
    for _ in range(rounds):
        for c in order:
            a = np.column_stack([np.delete(x, c, axis=1), np.ones(len(x))])
            p = a @ np.linalg.lstsq(a[~miss[:, c]], x[~miss[:, c], c], rcond=None)[0]
            if match:
                known = np.flatnonzero(~miss[:, c])
                for i in np.flatnonzero(miss[:, c]):
                    x[i, c] = x[known[np.argmin(np.abs(p[known] - p[i]))], c]
            else:
                x[miss[:, c], c] = p[miss[:, c]]
        means.append([x[miss[:, c], c].mean() for c in order])
    return x, means, order


def table(spark, x):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, "i long, " + ", ".join(f"c{k} double" for k in range(x.shape[1])))


@pytest.mark.parametrize(("match", "most"), [(False, 10**6), (True, 10**6), (True, 40)])
def test_rounds_are_those_of_numpy(spark, match, most):
    rng = np.random.default_rng(7)
    z = rng.normal(size=(150, 4))
    z[:, 1] += 2 * z[:, 0]
    z[:, 2] -= z[:, 1]
    for c, share in ((0, 0.1), (1, 0.2), (2, 0.3)):
        z[rng.random(150) < share, c] = np.nan
    want, means, order = chain(z, 2, match)
    out, got_means = costs.chained(table(spark, z).repartition(3), "i", [f"c{k}" for k in range(4)], rounds=2, match=match, model=linear, most=most)
    got = {r["i"]: r for r in out.collect()}
    assert len(got) == 150
    for i in range(150):
        assert [got[i][f"c{k}"] for k in range(4)] == pytest.approx(want[i].tolist(), rel=1e-6, abs=1e-6)
        assert [got[i][f"c{k}_imputed"] for k in range(4)] == np.isnan(z[i]).tolist()
    assert [[m[f"c{c}"] for c in order] for m in got_means] == pytest.approx(np.array(means), rel=1e-6)


def test_categories_follow_a_rule_and_other_columns_stay(spark):
    d = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("x"), F.concat(F.lit("g"), F.col("id") % 3).alias("g"), F.lit("kept").alias("note"))
    holes = d.withColumn("x", F.when(F.col("k") % 10 != 0, F.col("x"))).withColumn("g", F.when(F.col("k") % 10 != 5, F.col("g")))
    out, _ = costs.chained(holes, "k", ["x"], ["g"], rounds=2)
    rows = out.collect()
    assert len(rows) == 600 and all(r["x"] == r["k"] % 3 and r["g"] == f"g{r['k'] % 3}" and r["note"] == "kept" for r in rows)
    assert sum(r["x_imputed"] for r in rows) == 60 and sum(r["g_imputed"] for r in rows) == 60


def test_nothing_to_fill_or_nothing_to_learn_from(spark):
    whole = table(spark, np.arange(20.0).reshape(10, 2))
    out, means = costs.chained(whole, "i", ["c0", "c1"], model=linear)
    assert means == [] and sorted(tuple(r)[:3] for r in out.select("i", "c0", "c1").collect()) == sorted(map(tuple, whole.collect()))
    empty, _ = costs.chained(whole.filter("false"), "i", ["c0", "c1"], model=linear)
    assert empty.count() == 0
    never = whole.withColumn("c2", F.lit(None).cast("double")).withColumn("c1", F.when(F.col("i") > 2, F.col("c1")))
    rows = costs.chained(never, "i", ["c0", "c1", "c2"], rounds=1, match=False, model=linear)[0].collect()
    assert all(r["c2"] is None and r["c1"] == pytest.approx(2 * r["i"] + 1, abs=1e-6) for r in rows)


@pytest.mark.parametrize("n", [30, 40, 900])
def test_trees_of_weighted_cells_are_those_of_the_rows(spark, n):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(n)
    rows = [(int(a), int(b), float(3 * a - b + rng.normal())) for a, b in rng.integers(0, 6, (n, 2))]
    d = VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(spark.createDataFrame(rows, "a int, b int, y double"))
    cells = d.groupBy("a", "b").agg(F.first("_x").alias("_x"), F.count("*").cast("double").alias("_w"), F.avg("y").alias("_y"))
    plain = costs.trees(False, 64, 1).setFeaturesCol("_x").setLabelCol("y").setPredictionCol("_p").fit(d).transform(d).select("a", "b", "_p").distinct()
    want = {(r["a"], r["b"]): r["_p"] for r in plain.collect()}
    got = {(r["a"], r["b"]): r["_p"] for r in costs._cell_numbers(cells, costs.trees(False, 64, 1)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want)


@pytest.mark.parametrize("most", [10**6, 40])
def test_donors_by_predictions_are_the_nearest(spark, most):
    rng = np.random.default_rng(3)
    rows = [(i, float(p), None if p in (0, 3, 4, 9) or rng.random() < 0.4 else float(i)) for i, p in enumerate(rng.integers(0, 10, 300))]
    d = spark.createDataFrame(rows, "i long, _p double, y double").repartition(3)
    sizes = d.groupBy("_p").agg(F.count("*").alias("_n"))
    want = {r["i"]: r["_donor"] for r in costs._nearest_donor(d, F.col("y"), "i").collect()}
    assert {r["i"]: r["_donor"] for r in costs._cell_donors(d, sizes, F.col("y"), "i", most).collect()} == want
    assert all(v is not None for v in want.values())


def test_models_are_fitted_on_cells_of_all_rows(spark, monkeypatch):
    """Columns of few values, and one of very many that fills as many cells as there are bins."""
    from pyspark.ml.regression import GBTRegressor

    fit, seen = GBTRegressor.fit, []
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: seen.append((df.count(), df.agg(F.sum("_w")).first()[0] if "_w" in df.columns else None)) or fit(self, df))
    d = spark.range(6000).select("id", (F.col("id") % 4).alias("a"), (F.col("id") % 4 * 10 + F.col("id") % 3).alias("b"), F.when(F.col("id") % 10 != 0, F.col("id") * 1.5).alias("c"))
    holes = d.withColumn("b", F.when(F.col("id") % 8 != 0, F.col("b")))
    rows = costs.chained(holes, "id", ["a", "b", "c"], rounds=1)[0].collect()
    assert len(rows) == 6000 and all(r["b"] is not None and r["c"] is not None for r in rows)
    # The fewest missing first: c (600) from 4 x 12 cells at most, then b (750) from 4 x 64.
    assert [w for _, w in seen] == [5400, 5250] and seen[0][0] <= 48 and seen[1][0] <= 256
    ends = costs._ends(d, ["a", "c"], 64)
    assert ends["a"] == [0, 1, 2] and len(ends["c"]) == 63
    sizes = costs._celled(d.dropna(), ends).groupBy("_b_c").count().collect()
    assert len(sizes) == 64 and max(r["count"] for r in sizes) <= 86
    assert all(r["_b_a"] == r["a"] for r in costs._celled(d.dropna(), ends).collect())
