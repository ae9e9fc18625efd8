"""Values of the jobs that fit models or draw replicates, against numpy and plain Python."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.quantiles import quantile
from tidemark.operators import evaluation as E
from tidemark.operators import eventstream as ES
from tidemark.operators import sequences as Q
from tidemark.plans import datasets
from tidemark.plans import modelling as M
from tidemark.queries import collect_all

SF = "/root/testdata/sf0.001"


def auc(y, p):
    y, p = np.array(y), np.array(p)
    a, b = p[y == 1], p[y == 0]
    return ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()).item()


@pytest.fixture(scope="module")
def separable(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.normal(size=300) > 0.3).astype(float)
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(300)]
    return spark.createDataFrame(rows, "id long, a array<double>, label double").withColumn("x", array_to_vector("a")).cache()


def test_cross_validation_predicts_each_row_once_without_its_fold(spark, separable, tmp_path):
    folds = M.folds(separable, "id", "label", 3, 1)
    use = {k: v for k, v in M.models().items() if k in ("logistic", "prior")}
    for path in (None, f"file://{tmp_path}/p"):
        rows = M.cross_validate(separable, "id", "x", "label", folds, use, path).collect()
        fold = {r["id"]: r["fold"] for r in folds.collect()}
        label = {r["id"]: r["label"] for r in separable.collect()}
        for name in use:
            own = [r for r in rows if r["model"] == name]
            assert sorted(r["id"] for r in own) == sorted(fold) and all(r["fold"] == fold[r["id"]] and r["y"] == label[r["id"]] for r in own)
        for r in rows:
            if r["model"] == "prior":
                rest = [label[i] for i in fold if fold[i] != r["fold"]]
                assert r["p"] == pytest.approx(sum(rest) / len(rest))
        own = [r for r in rows if r["model"] == "logistic"]
        assert auc([r["y"] for r in own], [r["p"] for r in own]) > 0.95


@pytest.mark.parametrize("name", ["logistic", "elastic_net", "boosted", "forest"])
def test_models_learn_a_rule_on_rows_they_have_not_seen(separable, name):
    from pyspark.ml.functions import vector_to_array

    d = separable.withColumnRenamed("x", "features")
    model = M.models()[name].fit(d.filter("id % 3 <> 0"))
    rows = model.transform(d.filter("id % 3 = 0")).select("label", F.get(vector_to_array("probability"), F.lit(1)).alias("p")).collect()
    assert auc([r["label"] for r in rows], [r["p"] for r in rows]) > 0.9


def test_stages_follow_numpy(spark, separable):
    d = separable.select("id", "label", *[F.get("a", F.lit(i)).alias(f"c{i}") for i in range(3)]).withColumn("c2", F.when(F.col("id") % 10 != 0, F.col("c2")))
    out = M.stages([("impute", {}), ("standard", {}), ("pca", {"k": 2}), ("select", {"k": 2}), ("logistic", {})], ["c0", "c1", "c2"]).fit(d).transform(d).orderBy("id").collect()
    x = np.array([[np.nan if r[c] is None else r[c] for c in ("c0", "c1", "c2")] for r in d.orderBy("id").collect()])
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert np.allclose(np.array([r["_v2"].toArray() for r in out]), z)
    _, _, v = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(np.array([r["_v3"].toArray() for r in out])), np.abs(z @ v[:2].T), atol=1e-6)
    assert auc([r["label"] for r in out], [r["probability"][1] for r in out]) > 0.6
    low = M.stages([("minmax", {}), ("logistic", {})], ["c0", "c1"]).fit(d).transform(d).select("_v1").collect()
    assert np.array([r["_v1"].toArray() for r in low]).min() == 0 and np.array([r["_v1"].toArray() for r in low]).max() == 1


def test_projection_is_that_of_numpy(spark, separable):
    rows = M.project(separable, "id", "a").orderBy("id").collect()
    x = np.array([r["a"] for r in separable.orderBy("id").collect()])
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(np.array([[r["c1"], r["c2"]] for r in rows])), np.abs(x @ v[:2].T), atol=1e-6)


def test_bootstrap_band_holds_the_share_and_has_its_width(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.random()), 0.0) for i in range(3000)]
    rows = [(i, p, float(rng.random() < p)) for i, p, _ in rows]
    d = spark.createDataFrame(rows, "id long, p double, y double")
    for r in E.bootstrap_band(d, "y", "p", 5, 100).collect():
        own = [y for _, p, y in rows if min(int(p * 5), 4) == r["bin"]]
        share = sum(own) / len(own)
        width = 2 * 1.96 * (share * (1 - share) / len(own)) ** 0.5
        assert r["frac_pos"] == pytest.approx(share) and r["low"] < share < r["high"] and 0.6 < (r["high"] - r["low"]) / width < 1.5


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_neighbours_brute_force(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)).round(1)
    y = [None if i % 4 == 0 else float(i % 9) for i in range(120)]
    d = spark.createDataFrame([(i, [float(v) for v in x[i]], y[i]) for i in range(120)], "id long, v array<double>, y double").repartition(4)
    got = {r["id"]: r["y"] for r in M.knn_impute(d, "id", "y", "v", 5, block).collect()}
    known = [i for i in range(120) if y[i] is not None]
    for i in range(120):
        want = y[i] if y[i] is not None else np.mean([y[j] for j in sorted(known, key=lambda j: (np.sqrt(((x[j] - x[i]) ** 2).sum()), j))[:5]])
        assert got[i] == pytest.approx(want)
    assert M.knn_impute(d.filter("y is null"), "id", "y", "v").filter("y is not null").count() == 0
    assert M.knn_impute(d.filter("false"), "id", "y", "v").count() == 0


def test_factors_rebuild_the_table(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random((12, 2)) + 0.2, rng.random((8, 2)) + 0.2
    full = a @ b.T
    d = spark.createDataFrame([(i, j, float(full[i, j])) for i in range(12) for j in range(8)], "r int, c int, n float")
    rows = {r["r"]: np.array(r["features"]) for r in M.factorise(d, "r", "c", "n", 2).collect()}
    f = np.stack([rows[i] for i in range(12)])
    assert (f >= 0).all()
    rest = full - f @ np.linalg.lstsq(f, full, rcond=None)[0]
    assert np.abs(rest).max() < 0.1 * full.max()


def test_factors_of_a_table_with_zeros(spark):
    rng = np.random.default_rng(11)
    full = (rng.random((15, 3)) @ rng.random((3, 9))) * (rng.random((15, 9)) < 0.4)
    d = spark.createDataFrame([(f"r{i}", j, float(full[i, j])) for i in range(15) for j in range(9) if full[i, j]], "r string, c int, n double")
    left, right, errors = M.factors(d, "r", "c", "n", 3, rounds=12, least=1e-6)
    assert len(errors) > 2 and all(b <= a + 1e-9 for a, b in zip(errors, errors[1:], strict=False))
    w, h = {r["id"]: np.array(r["x"]) for r in left.collect()}, {r["id"]: np.array(r["x"]) for r in right.collect()}
    error = sum((full[i, j] - (w[f"r{i}"] @ h[j] if f"r{i}" in w and j in h else 0)) ** 2 for i in range(15) for j in range(9))
    assert error == pytest.approx(errors[-1], rel=1e-6) and all((x >= 0).all() for x in [*w.values(), *h.values()])
    u, s, v = np.linalg.svd(full)
    best = float((s[3:] ** 2).sum())  # no factors of rank 3 are nearer, with any signs
    assert best - 1e-9 <= error <= best + 0.35 * float((full**2).sum())


def test_texts_to_vectors(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, None), (3, "A  b\na")], "k long, t string").repartition(2)
    rows = {r["k"]: np.array(r["features"]) for r in Q.encode_texts(d, "k", "t", 32).collect()}
    assert rows[1].sum() == 3 and sorted(rows[1][rows[1] > 0]) == [1, 2] and (rows[1] == rows[3]).all()

    def encoder():
        return lambda texts: [[float(len(x)), float(x.count("a"))] for x in texts]

    wide = {r["k"]: (r["feature_1"], r["feature_2"]) for r in Q.encode_texts(d, "k", "t", 2, encoder, wide=True).collect()}
    assert wide == {1: (5.0, 2.0), 2: (0.0, 0.0), 3: (6.0, 1.0)}


@pytest.mark.parametrize("name", ["ML02", "ML03", "ML05"])
def test_registered_models_give_a_probability_for_every_document(spark, name):
    rows = collect_all().queries[name](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").count()
    per = collections.Counter(r.asDict().get("model") for r in rows)
    assert set(per.values()) == {n} and all(0 <= r["p"] <= 1 for r in rows)


@pytest.mark.parametrize("how", ["nearest", "lower", "linear"])
def test_quantiles_of_skewed_groups(spark, how):
    rng = np.random.default_rng(5)
    groups = {"a": rng.integers(0, 3, 500).astype(float), "b": rng.lognormal(0, 3, 333), None: np.array([7.0]), "c": np.full(50, 2.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("d", None), ("b", float("nan"))]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {r["g"]: tuple(r)[1:] for r in quantile(d, "v", qs, ["g"], how).collect()}
    assert set(got) == {"a", "b", None, "c"}
    for g, x in groups.items():
        x = np.sort(x)
        for q, v in zip(qs, got[g], strict=True):
            if how == "linear":
                want = np.quantile(x, q)
            else:
                k = int((len(x) - 1) * q + 0.5) if how == "nearest" else max(int(np.ceil(len(x) * q - 1e-9)) - 1, 0)
                want = x[k]
            assert v == pytest.approx(want)
    assert quantile(d.filter("v is null"), "v", 0.5, interpolation=how).collect()[0][0] is None


def test_fitted_dataset_survives_saving(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2], float(i % 17)) for i in range(200)] + [(900, "b", 1e6), (901, "new", 1.0)], "id long, k string, q double")
    m = ES.Measurement("k", modality="multivariate_regression", values_column="q")
    fitted = datasets.Dataset({"subjects": rows.select("id")}, [m]).fit(rows.filter("id < 200"))
    fitted.save(f"file://{tmp_path}/d")
    again = datasets.load(spark, f"file://{tmp_path}/d")
    assert again.measures == [m] and again.tables["subjects"].count() == rows.count()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(again.transform(rows)) == key(fitted.transform(rows))
    assert again.transform(rows).filter("id = 901").first()["k"] == ES.UNK
