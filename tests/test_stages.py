"""Pipeline stages of the library's own, against numpy and plain Python."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.plans import modelling as M
from tidemark.plans.stages import ConstantImputer, NeighbourImputer, NonNegativeFactors
from tidemark.queries import collect_all


def filled_by_hand(train, rows, k):
    """{key: values} with the means of the k nearest training rows, column by column."""
    means = [np.mean([r[1 + i] for r in train if r[1 + i] is not None]) for i in range(3)]
    others = lambda r, i: np.array([means[j] if r[1 + j] is None else r[1 + j] for j in range(3) if j != i])
    out = {}
    for r in rows:
        values = list(r[1:])
        for i in range(3):
            if r[1 + i] is None:
                near = sorted((np.linalg.norm(others(r, i) - others(o, i)), o[0], o[1 + i]) for o in train if o[1 + i] is not None)
                values[i] = np.mean([y for _, _, y in near[:k]])
        out[r[0]] = values
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_fills_from_neighbours(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 3))
    x[:20] = x[20:40]  # ties
    rows = [(i, *[None if rng.random() < 0.15 else float(v) for v in r]) for i, r in enumerate(x)]
    train, test = rows[:120], rows[120:]
    schema = "id int, a double, b double, c double"
    nan = lambda part: [tuple(float("nan") if v is None and r[0] % 2 else v for v in r) for r in part]
    model = NeighbourImputer("id", ["a", "b", "c"], k=4, block=block).fit(spark.createDataFrame(nan(train), schema))
    for part in (train, test):
        out = model.transform(spark.createDataFrame(nan(part), schema).withColumn("key", F.lit("clash")).withColumn("y", F.lit(0)))
        want = filled_by_hand(train, part, 4)
        got = {r["id"]: r for r in out.collect()}
        assert got.keys() == want.keys() and {"key", "y"} <= set(out.columns) and not [c for c in out.columns if c.startswith("_")]
        for r in part:
            assert [got[r[0]][f"{c}_filled"] for c in "abc"] == pytest.approx(want[r[0]])
            assert [got[r[0]][f"{c}_missing"] for c in "abc"] == [float(v is None) for v in r[1:]]


def test_fills_without_a_neighbour(spark):
    d = spark.createDataFrame([(1, 2.0, None), (2, None, None), (3, 4.0, None)], "id long, a double, b double")
    got = NeighbourImputer("id", ["a", "b"], k=5).fit(d).transform(d).orderBy("id").collect()
    assert [r["a_filled"] for r in got] == [2.0, 3.0, 4.0] and [r["b_filled"] for r in got] == [None] * 3
    alone = NeighbourImputer("id", ["a"], indicator=False).fit(d).transform(d).orderBy("id").collect()
    assert [r["a_filled"] for r in alone] == [2.0, 3.0, 4.0]
    empty = d.filter("id > 9")
    assert NeighbourImputer("id", ["a", "b"]).fit(d).transform(empty).count() == 0
    assert [r["a_filled"] for r in NeighbourImputer("id", ["a", "b"]).fit(empty).transform(d).orderBy("id").collect()] == [2.0, None, 4.0]
    flat = ConstantImputer(["a"], value=-1).transform(d).orderBy("id").collect()
    assert [(r["a_filled"], r["a_missing"]) for r in flat] == [(2.0, 0.0), (-1.0, 1.0), (4.0, 0.0)]


def test_non_negative_factors(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(90, 2)) @ rng.uniform(size=(2, 5))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, a array<double>").withColumn("v", array_to_vector("a")).repartition(7)
    model = NonNegativeFactors("v", "w", k=2, rounds=60, least=1e-9).fit(d)
    w = np.array([r["w"].toArray() for r in model.transform(d).orderBy("id").collect()])
    assert (w >= 0).all() and (model.h >= 0).all()
    assert all(b <= a * (1 + 1e-9) for a, b in zip(model.errors, model.errors[1:], strict=False))
    assert ((x - w @ model.h) ** 2).sum() < 1e-3 * (x**2).sum()
    one = d.filter("id = 5")  # a row alone has the factors that it has among others
    assert model.transform(one).first()["w"].toArray() == pytest.approx(w[5])
    with pytest.raises(ValueError):
        NonNegativeFactors("v", "w").fit(d.withColumn("v", array_to_vector(F.transform("a", lambda v: -v))))
    nothing = NonNegativeFactors("v", "w", k=2).fit(d.filter("id < 0")).transform(one).first()["w"].toArray()
    assert nothing.tolist() == [0.0, 0.0]


def test_pipeline_with_all_stages_learns_a_rule(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    rows = [(i, *[None if rng.random() < 0.1 else float(v) for v in r], float(r[0] + r[1] > 0)) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "id long, a double, b double, c double, label double")
    for first in (("neighbours", {"key": "id"}), ("constant", {"value": 0.0})):
        pipe = M.stages([first, ("minmax", {}), ("factors", {"k": 4, "rounds": 8}), ("boosted", {})], ["a", "b", "c"])
        out = pipe.fit(d.filter("id % 3 <> 0")).transform(d.filter("id % 3 = 0")).select("label", "prediction").collect()
        assert np.mean([r["label"] == r["prediction"] for r in out]) > 0.7


def test_registered_query_has_every_labelled_document(spark):
    sf = "/root/testdata/sf0.001"
    got = collect_all().queries["ML05_stages"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect())
    assert all(0 <= r["p"] <= 1 for r in got)
