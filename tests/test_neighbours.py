"""The pivot index against brute force, and the pairs it spares on clustered data."""

import numpy as np
import pytest

from tidemark.operators.neighbours import nearest


@pytest.mark.parametrize(("block", "repeat"), [(16, False), (5, True)])
def test_equal_to_brute_force_with_ties(spark, block, repeat):
    rng = np.random.default_rng(6)
    known = rng.integers(0, 4, (90, 3)).astype(float) if repeat else rng.normal(size=(90, 3))
    if repeat:
        known[::3] = known[0]  # one point holds a third of the rows
    asks = np.concatenate((rng.normal(size=(20, 3)) * 3, known[:5]))
    k = spark.createDataFrame([(i, v.tolist(), float(i)) for i, v in enumerate(known)], "other long, v array<double>, y double").repartition(3)
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asks)], "key long, v array<double>")
    got = {}
    for r in nearest(a, k, 4, block, 5).collect():
        got.setdefault(r["key"], []).append((r["d"], r["other"]))
    for i, v in enumerate(asks):
        d = np.sqrt(((known - v) ** 2).sum(axis=1))
        assert sorted(got[i]) == [(pytest.approx(d[j]), j) for j in sorted(range(90), key=lambda j: (d[j], j))[:4]]


def test_few_pairs_on_clustered_data(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 6)) * 100
    points = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 6))
    k = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(points[:2800])], "other long, v array<double>, y double")
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points[2800:])], "key long, v array<double>")
    rows = nearest(a, k, 3, 50, 40).collect()
    assert len(rows) == 600
    pairs = sum({r["key"]: r["compared"] for r in rows}.values())
    assert pairs < 0.25 * 200 * 2800
    for r in rows[:50]:
        assert r["d"] == pytest.approx(np.sqrt(((points[r["other"]] - points[2800 + r["key"]]) ** 2).sum()))


def test_without_known_rows_or_with_few(spark):
    a = spark.createDataFrame([(1, [0.0])], "key long, v array<double>")
    k = spark.createDataFrame([(5, [2.0], 1.0), (6, [1.0], 2.0)], "other long, v array<double>, y double")
    assert nearest(a, k.filter("false"), 3).count() == 0
    assert nearest(a.filter("false"), k, 3).count() == 0
    assert sorted((r["other"], r["d"]) for r in nearest(a, k, 3).collect()) == [(5, 2.0), (6, 1.0)]
