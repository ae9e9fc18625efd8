"""Radix selection against sorting, and the number of scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import quantiles as Q


def nearest(values, q):
    values = sorted(values)
    k = int((len(values) - 1) * q + 0.5)
    return values[k]


@pytest.mark.parametrize("most", [5, 1_000_000])
@pytest.mark.parametrize("how", ["nearest", "linear", "lower"])
def test_ten_columns_of_a_skewed_group(spark, monkeypatch, how, most):
    monkeypatch.setattr(Q, "MOST", most)
    rng = random.Random(1)
    make = [
        lambda: rng.gauss(0, 1), lambda: rng.randrange(5) - 2.0, lambda: 10 ** rng.uniform(-300, 300), lambda: -(2.0 ** rng.randrange(-50, 50)), lambda: 7.5, lambda: rng.choice([0.0, -0.0, 1e-320]),
        lambda: rng.uniform(100, 100.001), lambda: float(rng.randrange(10**15)), lambda: rng.choice([float("nan"), 3.0, float("inf"), float("-inf")]), lambda: 1 + rng.randrange(4) * 2.0**-52,
    ]
    rows = [(None if i % 10 == 0 else "big" if i % 3 else f"g{i % 4}", *[None if rng.random() < 0.1 else f() for f in make]) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"c{i} double" for i in range(10))).repartition(4)
    qs = [0, 0.1, 0.5, 0.975, 1]
    used = range(10) if how != "linear" else [0, 1, 3, 4, 6, 7, 9]
    got = {r["g"]: r for r in Q.wide(df, {f"c{i}_{q}": (f"c{i}", q) for i in used for q in qs}, ["g"], how).collect()}
    for g in {r[0] for r in rows}:
        for i in used:
            vs = sorted(r[i + 1] for r in rows if r[0] == g and r[i + 1] is not None and r[i + 1] == r[i + 1])
            for q in qs:
                want = nearest(vs, q) if how == "nearest" else float(np.quantile(vs, q)) if how == "linear" else vs[max(0, int(np.ceil(len(vs) * q - 1e-9)) - 1)]
                assert got[g][f"c{i}_{q}"] == pytest.approx(want, rel=1e-12, abs=1e-320), (g, i, q)


def test_types_empty_tables_and_two_scans(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("int").alias("a"), F.col("id").cast("decimal(20,2)").alias("b"))
    row = Q.quantile(df, "a", [0.5], interpolation="nearest")
    assert dict(row.dtypes) == {"q50": "int"} and row.first()[0] == 47
    assert Q.wide(df, {"x": ("a", 0.25), "y": ("b", 0.25)}).first() == (22.0, 249.75)
    assert Q.quantile(df.limit(0), "a", 0.5).first()[0] is None
    assert Q.quantile(df.limit(0).withColumn("k", F.lit(1)), "a", 0.5, ["k"]).count() == 0


def test_the_plan_reads_the_table_once_more(spark, tmp_path):
    spark.range(5000).selectExpr("id % 7 AS k", "cast(id AS double) AS a", "id * 0.5D AS b", "-id AS c").write.parquet(f"{tmp_path}/t")
    out = Q.wide(spark.read.parquet(f"{tmp_path}/t"), {f"{c}{q}": (c, q) for c in "abc" for q in (0.1, 0.5, 0.9)}, ["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [id") + plan.count("Relation [k#") == 1  # the first scan is done; its result is a small table
