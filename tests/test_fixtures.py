"""Small literal inputs with known results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import encodings, scalars
from tidemark.functions.quantiles import quantile
from tidemark.operators import evaluation as E
from tidemark.operators import eventstream as ES
from tidemark.operators import filters as P
from tidemark.operators import intervals
from tidemark.operators import sequences as Q
from tidemark.operators import windows as Wn
from tidemark.operators.aggs import task_summary
from tidemark.plans import cohort, costs, features, labels


def col(df, c):
    return [r[c] for r in df.collect()]


def test_single_episode_subjects_go(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,)], "ppn_int int")
    assert sorted(col(P.min_rows(df, "ppn_int", 2), "ppn_int")) == [1, 1, 3, 3]


def test_newborns_go(spark):
    df = spark.createDataFrame([("74", 0.0), ("75", 0.1), ("74", 0.0), ("76", 1.0), ("77", 5.0)], "srg string, age_recode double")
    assert P.exclude(df, P.unqualified_newborns()).count() == 3


def test_activity_after_death(spark):
    d = lambda m, x: dt.date(2020, m, x)
    e = spark.createDataFrame([(1, d(1, 2)), (1, d(3, 1)), (2, d(5, 1)), (3, d(6, 1))], "k int, e date")
    died = spark.createDataFrame([(1, d(2, 1)), (2, d(4, 1)), (3, d(7, 1))], "k int, died date")
    assert col(P.drop_after_event(e, "k", "e", died, "died"), "k") == [3]


def test_all_null_age(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, None), (3, 1.0)], "k int, age double")
    assert sorted(col(P.drop_all_null(df, "k", "age"), "k")) == [1, 1, 3]


def test_private_peer_group_rule(spark):
    df = spark.createDataFrame([(1, None), (2, "A"), (3, None), (2, "B")], "hospital_type int, peer_group string")
    rule = (F.col("hospital_type") > 1) & F.col("peer_group").isNull()
    assert col(df.select(P.recode("peer_group", [(rule, "PRIV")]).alias("g")), "g") == [None, "A", "PRIV", "B"]


def test_rare_values(spark):
    df = spark.createDataFrame([("M",), ("M",), ("F",), (None,)], "sex string")
    assert sorted(map(str, col(P.fold_rare(df, ["sex"], 2), "sex"))) == ["M", "M", "None", "other"]
    assert sorted(map(str, col(P.fold_rare(df, ["sex"], 0), "sex"))) == ["F", "M", "M", "None"]


@pytest.mark.parametrize(("pred", "want"), [([0, 0, 1, 0, 1, 0], 0.75), ([0, 1, 0, 0, 1, 0], 1.0), ([1, 0, 1, 1, 0, 1], 0.0)])
def test_specificity(spark, pred, want):
    df = spark.createDataFrame(list(zip([0, 1, 0, 0, 1, 0], map(float, pred), strict=True)), "y int, p double")
    assert df.agg(E.confusion(0.5)["specificity"].alias("s")).first()["s"] == want


def test_metric_bundle(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.8), (0, 0.2), (1, 0.9), (0, 0.3), (1, 0.7)], "y int, p double")
    r = E.metrics(df, "y", "p").first()
    assert r["roc_auc"] == 1 and r["average_precision"] == 1 and r["accuracy"] == 1 and r["n"] == 6
    one = E.metrics(df.withColumn("y", F.lit(0)), "y", "p").first()
    assert one["n"] == 6 and one["roc_auc"] is None and one["brier"] is None
    assert E.metrics(df.filter("false"), "y", "p").count() == 0


def test_auc_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), rng.randrange(50) / 50) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, p double").repartition(5)
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert E.roc_auc(df, "y", "p").first()["roc_auc"] == pytest.approx(want)


def test_threshold_label(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 6)], "label int")
    out = encodings.threshold_label(df, "label", high=True)
    assert {r["label_raw"]: r["label"] for r in out.collect()} == {1: False, 2: False, 3: False, 4: False, 5: False} or dict(out.dtypes)["label"] == "boolean"
    assert all(r["label"] == (r["label_raw"] > 0) for r in encodings.threshold_label(df, "label", high=False).collect())


def test_alignment(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "k int, v int")
    assert P.is_aligned({"a": a, "b": a}, "k")
    assert not P.is_aligned({"a": a, "b": a.filter("k = 1")}, "k")
    assert not P.is_aligned({"a": a, "b": a.union(a.filter("k = 1"))}, "k")


def test_code_prefixes(spark):
    df = spark.createDataFrame([(1, ["A1.0", "A1.2", "B"]), (2, None)], "k int, codes array<string>")
    out = {r["k"]: (r["d_A1"], r["d_B"]) for r in features.code_prefix_counts(df, "k", "codes", "d_").collect()}
    assert out == {1: (2, 1), 2: (0, 0)}


def test_vocabulary_and_filter(spark):
    counts = spark.createDataFrame([("apple", 3), ("banana", 5), ("UNK", 2)], "element string, count long")
    v = sorted((r["idx"], r["element"], r["freq"]) for r in ES.rank_vocabulary(counts, "m").collect())
    assert v == [(0, "UNK", 0.2), (1, "banana", 0.5), (2, "apple", 0.3)]
    counts = spark.createDataFrame([("apple", 5), ("banana", 3), ("UNK", 2)], "element string, count long")
    for cut in (0.4, 4):
        v = sorted((r["idx"], r["element"], r["freq"]) for r in ES.filter_vocabulary(ES.rank_vocabulary(counts, "m"), cut, "m").collect())
        assert v == [(0, "UNK", 0.5), (1, "apple", 0.5)]


def test_time_of_day(spark):
    df = spark.sql("select explode(array(timestamp'2020-01-01 00:00:00', timestamp'2020-01-01 06:00:00', timestamp'2020-01-01 12:00:00', timestamp'2020-01-01 18:00:00', timestamp'2020-01-01 23:59:59')) t")
    assert col(df.select(scalars.time_of_day("t").alias("x")), "x") == ["EARLY_AM", "AM", "PM", "PM", "LATE_PM"]


def test_dense_index(spark):
    values = ["foo", "bar", "foo", "bar", "baz", None, "bar", "aba"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    assert col(encodings.to_int_index(df, "c").orderBy("i"), "c") == [3, 1, 3, 1, 2, None, 1, 0]


def test_task_summary(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (3, 0), (3, 1), (4, 0)], "s int, y int")
    r = task_summary(df, "s", "y").first()
    assert r["n_samples"] == 7 and r["median_per_subject"] == 1.5
    assert r["macro_mean"] == pytest.approx((0.5 + 1 + 1 / 3 + 0) / 4) and r["weighted_mean"] == pytest.approx(3 / 7)


def test_depad_and_pad(spark):
    df = spark.createDataFrame([([1, 3, 0, 4, 0, 0], [10, 0, 5, 8, 1, 0])], "a array<int>, b array<int>")
    r = Q.depad(df, "a", ["b"]).first()
    assert (r["a"], r["b"]) == ([1, 3, 4], [10, 0, 8])
    r = Q.pad(spark.createDataFrame([([1.0, float("nan")],)], "a array<double>"), ["a"], 4, "left").first()
    assert r["a"] == [0, 0, 1, 0] and r["mask"] == [False, False, True, True]
    r = Q.pad_nested(spark.createDataFrame([([[1], [2, 3, 4]],)], "a array<array<int>>"), "a", 2).first()
    assert r["a"] == [[1, 0], [2, 3]]


def test_cutoffs():
    assert scalars.count_or_share(100, 0.1) == 10 and scalars.count_or_share(100, 0.116) == 12 and scalars.count_or_share(None, 11) == 11
    assert scalars.below_cutoff(5, 0.1, 100) and not scalars.below_cutoff(10, 0.1, 100) and not scalars.below_cutoff(1, None)


def test_source_schema():
    from tidemark.sources.schema import InputSchema

    with pytest.raises(ValueError):
        InputSchema(None, "static", "id", event_type="X")
    with pytest.raises(ValueError):
        InputSchema(None, "range", "id", start_col="a", event_type="X")
    s = InputSchema(None, "range", "id", {"c": ("d", "float")}, start_col="a", end_col="b", event_type="VISIT")
    assert s.range_types() == ("VISIT", "VISIT_START", "VISIT_END") and s.names() == {"c": ("d", "float")}


def test_interval_merge_brute_force(spark):
    rng = random.Random(2)
    day = dt.date(2020, 1, 1)
    rows = [(k, day + dt.timedelta(s), day + dt.timedelta(s + rng.randrange(9))) for k in range(5) for s in (rng.randrange(120) for _ in range(12))]
    df = spark.createDataFrame(rows, "k int, s date, e date").repartition(4)
    want = {k: len({d for kk, s, e in rows if kk == k for d in range(s.toordinal(), e.toordinal() + 1)}) for k in range(5)}
    assert {r["k"]: r["days"] for r in intervals.total_days(df, "k", "s", "e").collect()} == want


def test_rolling_windows_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, t, float(rng.randrange(10)) if rng.random() < 0.8 else None) for k in range(3) for t in sorted(rng.sample(range(40), 15))]
    df = spark.createDataFrame(rows, "k int, d int, v double").withColumn("ts", F.timestamp_seconds(F.col("d") * 86_400))
    out = Wn.summarize_over_window(df, "k", "ts", [("v", "sum"), ("v", "has_values_count")], ["7d", "-7d", "FULL", "-FULL"]).collect()
    for r in out:
        at = int(r["ts"].timestamp() // 86_400)
        own = [(d, v) for k, d, v in rows if k == r["k"] and v is not None]
        for w, test in (("7d", lambda d: at - 7 < d <= at), ("-7d", lambda d: at < d <= at + 7), ("FULL", lambda d: d <= at), ("-FULL", lambda d: d >= at)):
            got = [v for d, v in own if test(d)]
            assert r[f"{w}/v/has_values_count"] == len(got) and (r[f"{w}/v/sum"] or 0) == sum(got)


@pytest.mark.parametrize("q", [0.025, 0.25, 0.5, 0.9])
def test_nearest_quantile_brute_force(spark, q):
    rng = random.Random(4)
    values = [float(rng.randrange(40)) for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert quantile(df, "v", q).first()[0] == sorted(values)[int(100 * q + 0.5)]


def test_results_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 7, i, float(i % 5)) for i in range(200)], "k int, i int, v double")
    shuffled = df.orderBy(F.md5(F.col("i").cast("string")))
    for f in (lambda d: Wn.pick_random(d, "k", ["i"], 3), lambda d: ES.split_subjects(d.select(F.col("i").alias("subject_id")), [0.5, 0.3, 0.2], seed=4)):
        a, b = (sorted(map(tuple, f(d).collect())) for d in (df.repartition(1), shuffled.repartition(8)))
        assert a == b


def test_range_events(spark):
    from tidemark.sources.schema import InputSchema

    ts = lambda d: dt.datetime(2020, 1, d)
    df = spark.createDataFrame([(1, ts(1), ts(1), "a"), (1, ts(2), ts(4), "b"), (1, ts(5), ts(3), "c"), (None, ts(1), ts(2), "d")], "k int, s timestamp, e timestamp, c string")
    e, m = ES.extract_events(InputSchema(df, "range", "k", {"c": "categorical"}, start_col="s", end_col="e", event_type="V"))
    assert sorted(col(e, "event_type")) == ["V", "V_END", "V_START"] and m.count() == 3


def test_sequences_round_trip(spark):
    people = spark.createDataFrame([(1,), (2,)], "subject_id long")
    e = spark.createDataFrame([(10, 1, dt.datetime(2020, 1, 1), "a"), (11, 1, dt.datetime(2020, 1, 1, 1), "b")], "event_id long, subject_id long, timestamp timestamp, event_type string")
    dyn = spark.createDataFrame([(10, 1, 3, None), (11, 1, 2, 0.5), (11, 1, 4, None)], "event_id long, measurement_index int, index long, value double")
    static = spark.createDataFrame([(1, 2, 9)], "subject_id long, measurement_index int, index long")
    rows = {r["subject_id"]: r for r in ES.sequences(people, e, static, dyn).collect()}
    assert rows[1]["dynamic_indices"] == [[3], [2, 4]] and rows[1]["time"] == [0, 60] and rows[1]["time_delta"][0] == 60
    assert rows[1]["static_indices"] == [9] and rows[2]["time"] is None


def test_labels_small(spark):
    d = lambda x: dt.date(2020, 1, 1) + dt.timedelta(x)
    e = spark.createDataFrame([(1, d(10), d(12), 30.0), (1, d(11), d(15), 10.0), (1, d(170), d(190), 20.0), (2, d(0), d(3), 5.0)], "subject int, start date, end date, cost double")
    idx = spark.createDataFrame([(1, d(0)), (2, d(0))], "subject int, index_date date")
    r = {x["subject"]: x for x in labels.label_matrix(e, idx, {"6mo": 6}).collect()}
    assert (r[1]["n_episodes"], r[1]["days"], r[1]["cost"]) == (3, 6 + 13, 30 + 10 + 20 * 12 / 20)
    assert (r[2]["n_episodes"], r[2]["days"], r[2]["cost"]) == (0, 0, 0)


def test_inflation_needs_its_reference_year(spark):
    from tidemark.plans import costs

    df = spark.createDataFrame([(1.0, 2000)], "c double, y int")
    for rows in ([(2000, 1.0)], [(2021, 1.0), (2021, 2.0)]):
        with pytest.raises(ValueError):
            costs.inflate(df, "c", "y", spark.createDataFrame(rows, "year int, cpi double"), 2021)


def test_costs(spark):
    df = spark.createDataFrame([("r1", "100"), ("r2", "x"), ("r1", "90")], "RecNum string, Total string")
    assert {r["record"]: r["cost"] for r in costs.load(df, "RecNum", "Total").collect()} == {"r1": 100.0, "r2": None}
    o = spark.createDataFrame([(i, float(i % 3) if i % 4 else None, "ab"[i % 2]) for i in range(60)], "i int, y double, c string").withColumn("x", (F.col("i") % 3).cast("double"))
    out = costs.impute(o, "y", ["x"], ["c"], rare=1, match="i", iterations=3)
    assert out.filter("y is null").count() == 0 and out.filter("y_imputed").count() == 15
    assert out.filter("y_imputed and abs(y - i % 3) > 0.01").count() == 0


def test_imputed_values_are_those_of_the_nearest_donors(spark):
    import random as rd

    rng = rd.Random(6)
    rows = []
    for i in range(400):
        x, c = rng.random(), "ab"[i % 2]
        y = None if (c == "b" and x > 0.5) or i % 10 == 0 else 100 * x + 30 * (c == "b") + i / 1e6
        rows.append((i, x, c, y))
    kind = "i long, x double, c string, y double"
    frame = lambda r: spark.createDataFrame(r, kind).coalesce(1)
    got = {r["i"]: r["y"] for r in costs.impute(frame(rows), "y", ["x"], ["c"], rare=1, match="i", iterations=3).collect()}
    p = {r["i"] - 1000: r["y"] for r in costs.impute(frame(rows + [(i + 1000, x, c, None) for i, x, c, _ in rows]), "y", ["x"], ["c"], rare=1, iterations=3).collect() if r["i"] >= 1000}
    donors = {y: i for i, _, _, y in rows if y is not None}
    for i, _, _, y in rows:
        if y is None:
            assert got[i] in donors
            assert abs(p[donors[got[i]]] - p[i]) <= min(abs(p[d] - p[i]) for d in donors.values()) + 1e-9
        else:
            assert got[i] == y


def test_empty_tables(spark):
    e = spark.createDataFrame([], "subject int, start date, end date, cost double")
    idx = spark.createDataFrame([], "subject int, index_date date")
    assert labels.label_matrix(e, idx, {"6mo": 6}).count() == 0
    assert intervals.merge(e, "subject", "start", "end").count() == 0
    assert cohort.select_cohort(e.withColumn("age", F.lit(1)), spark.createDataFrame([], "subject int, died date"), "2000-01-01", "2020-01-01").count() == 0


def test_chi_square_tail():
    assert E.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert E.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert E.chi_square_tail(0, 3) == 1


def test_kruskal_and_contingency(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    h, dof, _ = E.kruskal(df, "g", "v")
    assert h == pytest.approx(3.857142857) and dof == 1
    x, dof, _ = E.contingency_chi_square(spark.createDataFrame([("a", 1)] * 10 + [("a", 0)] * 5 + [("b", 1)] * 5 + [("b", 0)] * 10, "a string, b int"), "a", "b")
    assert x == pytest.approx(10 / 3) and dof == 1


def test_database_query_options(tmp_path):
    from tidemark.sources.io import Query

    f = tmp_path / "q.sql"
    f.write_text("select * from t;")
    q = Query("jdbc:x", query_path=str(f), partition_on="id", bounds=(0, 10), partition_num=4)
    assert q.options()["dbtable"] == "(select * from t) q" and q.options()["numPartitions"] == "4"
    with pytest.raises(ValueError):
        Query("jdbc:x").text()


def test_streaming_row_local_operators(spark, tmp_path):
    """Row-local operators and joins to small tables work on a stream."""
    from tidemark.streaming import apply

    src = str(tmp_path / "in")
    spark.range(5).select(F.col("id").alias("subject_id"), F.timestamp_seconds(F.col("id") * 3600).alias("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("subject_id long, timestamp timestamp").parquet(src)
    out = apply.run_once(stream, lambda d: ES.add_functors(d, d, ["time_of_day"]), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert out.count() == 5 and set(col(out, "time_of_day")) == {"EARLY_AM"}


def test_database_source(spark):
    """Write a table to an in-memory database and read it by two queries, one in ranges."""
    from tidemark.sources.io import Query, read_jdbc

    url = "jdbc:derby:memory:tide;create=true"
    driver = (("driver", "org.apache.derby.jdbc.EmbeddedDriver"),)
    df = spark.range(20).select(F.col("id").cast("int").alias("ID"), (F.col("id") * 2).cast("int").alias("V"))
    df.write.jdbc(url, "T", mode="overwrite", properties=dict(driver))
    parts = [Query(url, "SELECT ID, V FROM T WHERE ID < 10", partition_on="ID", bounds=(0, 10), partition_num=3, properties=driver), Query(url, "SELECT ID, V FROM T WHERE ID >= 10", properties=driver)]
    got = read_jdbc(spark, parts)
    assert sorted(tuple(r) for r in got.collect()) == [(i, 2 * i) for i in range(20)]
    assert got.rdd.getNumPartitions() == 4
