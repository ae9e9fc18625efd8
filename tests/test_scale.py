"""As-of ranking, numbering by ranges and the crash-safe cache against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import encodings
from tidemark.operators import eventstream as ES
from tidemark.operators import joins as J
from tidemark.operators.segments import Segments
from tidemark.queries import eventstreams as Q
from tidemark.sources import io
from tidemark.sources.schema import InputSchema

T0 = dt.datetime(2021, 1, 1)
HOUR = dt.timedelta(hours=1)


@pytest.mark.parametrize("most", [4, 1_000_000])
def test_positions_of_many_tasks(spark, most):
    rng = random.Random(2)
    events = [(rng.choice([1, 1, 1, 2, None]), T0 + rng.randrange(20) * HOUR) for _ in range(60)]
    tasks = [(i, rng.choice([1, 1, 2, 3, None]), rng.choice([None, T0 + rng.randrange(-1, 21) * HOUR]), rng.choice([None, T0 + rng.randrange(-1, 21) * HOUR])) for i in range(80)]
    e = spark.createDataFrame(events, "subject_id int, timestamp timestamp")
    t = spark.createDataFrame(tasks, "task_id int, subject_id int, start_time timestamp, end_time timestamp")
    got = {r["task_id"]: (r["start_idx"], r["end_idx"]) for r in J.task_positions(e, t, most=most).collect()}
    for i, k, s, x in tasks:
        times = {ts for kk, ts in events if kk == k and kk is not None}
        assert got[i] == (sum(s is not None and ts < s for ts in times), sum(x is None or ts < x for ts in times)), i


def test_rows_between_operators_are_tasks_and_events(spark):
    e = spark.range(3000).select(F.lit(1).alias("subject_id"), F.timestamp_seconds("id").alias("timestamp"))
    t = spark.range(2000).select(F.col("id").alias("task_id"), F.lit(1).alias("subject_id"), F.timestamp_seconds("id").alias("start_time"), F.lit(None).cast("timestamp").alias("end_time"))
    out = J.task_positions(e, t)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Union" in plan
    assert out.agg(F.sum("start_idx"), F.sum("end_idx")).first() == (sum(range(2000)), 2000 * 3000)


def test_last_event_of_a_task(spark):
    d = spark.createDataFrame([(1, T0 + i * HOUR, float(i)) for i in (0, 2, 5)] + [(2, T0, 7.0)], "subject_id int, timestamp timestamp, `dynamic/a/b/sum` double")
    tasks = spark.createDataFrame([(1, T0 + 2 * HOUR, "at"), (1, T0 + 4 * HOUR, "between"), (1, None, "open"), (1, T0 - HOUR, "early"), (2, T0, "two"), (2, T0, "two"), (3, None, "none")], "subject_id int, end_time timestamp, label string")
    rows = ES.load_flat(spark.createDataFrame([(1,), (2,)], "subject_id int"), d, {}, tasks).collect()
    assert sorted((r["label"], r["dynamic/a/b/sum"]) for r in rows) == [("at", 2.0), ("between", 2.0), ("open", 5.0), ("two", 7.0)]


@pytest.mark.parametrize("size", [7, 1_000_000])
def test_numbering(spark, monkeypatch, size):
    monkeypatch.setattr(encodings, "RANGE", size)
    rng = random.Random(4)
    counts = [(f"w{i}", rng.randrange(5)) for i in range(60)] + [("UNK", 3)]
    got = ES.rank_vocabulary(spark.createDataFrame(counts, "element string, count long").repartition(4), "m").collect()
    order = sorted((c for c in counts if c[0] != "UNK"), key=lambda c: c[0], reverse=True)
    order.sort(key=lambda c: -c[1])
    assert {r["element"]: r["idx"] for r in got} == {"UNK": 0} | {w: i + 1 for i, (w, _) in enumerate(order)}
    total = sum(n for _, n in counts)
    assert {r["element"]: (r["count"], r["freq"]) for r in got} == {w: (n, n / total) for w, n in counts}
    words = [rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(200)] + [None]
    idx = encodings.dense_index(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    assert {r["w"]: r["idx"] for r in idx} == {w: i for i, w in enumerate(sorted(set(words) - {None}))}
    assert encodings.dense_index(spark.createDataFrame([], "w string"), "w").count() == 0


def test_cache_survives_a_crash_at_each_step(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)] + [(99, None)], "v int, chunk string")
    path = f"{tmp_path}/cache"
    with pytest.raises(Exception):  # while data is written
        io.write_missing(df.withColumn("v", F.when(F.col("v") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))), path, "chunk", {"p": 1})
    with monkeypatch.context() as m:  # after the data, before the manifest
        m.setattr(io, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            io.write_missing(df.filter("chunk = 'a'"), path, "chunk", {"p": 1})
    assert io.manifests(spark, path) == []
    first = io.write_missing(df.filter("chunk = 'a'"), path, "chunk", {"p": 1})
    assert sorted(r["v"] for r in first.collect()) == [0, 2, 4, 6, 8]
    whole = io.write_missing(df, path, "chunk", {"p": 1})
    assert sorted(r["v"] for r in whole.collect()) == [*range(10), 99]
    again = io.write_missing(df, path, "chunk", {"p": 1})
    assert again.count() == 11
    with pytest.raises(ValueError):
        io.write_missing(df, path, "chunk", {"p": 2})


def test_two_writers_at_once_give_each_value_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, chunk string")
    path = f"{tmp_path}/cache"
    io.write_missing(df, path, "chunk", {})
    df.filter("chunk = 'a'").write.partitionBy("chunk").parquet(f"{path}/data/other")
    io.commit(spark, path, "other", {"params": {}, "data": "other", "at": 1e12})
    assert sorted(r["v"] for r in io.write_missing(df, path, "chunk", {}).collect()) == [1, 2]


def test_fit_and_transform_of_all_kinds_of_measures(spark):
    from tidemark.plans import datasets, fitting

    rng = random.Random(8)
    subjects = spark.createDataFrame([(i, rng.choice("xy")) for i in range(20)], "subject_id long, sex string")
    events = spark.createDataFrame([(i, i % 20, float(i % 30)) for i in range(200)], "event_id long, subject_id long, age double")
    rows = spark.createDataFrame([(i % 200, "a" if i % 3 else "b", float(i % 2), rng.gauss(10, 2), None, "ab"[i % 2]) for i in range(400)], "event_id long, test string, result double, pulse double, never string, code string")
    measures = [
        ES.Measurement("sex", "static"), ES.Measurement("age", "functional", "univariate_regression"), ES.Measurement("test", modality="multivariate_regression", values_column="result"),
        ES.Measurement("pulse", modality="univariate_regression"), ES.Measurement("never"), ES.Measurement("missing"),
    ]
    data = datasets.Dataset({}, measures).fit({"subjects": subjects, "events": events, "measurements": rows}, min_observed=0.1)
    assert [m.name for m in data.measures] == ["sex", "age", "test", "pulse"]
    status = fitting.fit_measures({"measurements": rows}, measures).status.collect()
    assert {r["measure"]: r["status"] for r in status} == {"sex": "absent", "age": "absent", "test": "kept", "pulse": "kept", "never": "absent", "missing": "absent"}
    assert {r["element"] for r in data.vocabularies["test"].collect()} == {"UNK", "a__EQ_0", "a__EQ_1", "b__EQ_0", "b__EQ_1"}
    ages = [r["age"] for r in data.transform(events).collect()]
    assert abs(sum(ages) / len(ages)) < 1e-9 and max(ages) < 2
    out = data.transform(rows).filter("pulse is not null and not isnan(pulse)").agg(F.avg("pulse"), F.stddev_samp("pulse")).first()
    assert abs(out[0]) < 1e-9 and out[1] == pytest.approx(1)
    assert data.transform(subjects).columns == ["subject_id", "sex"]


def test_schema_of_nested_documents(spark):
    subjects = spark.createDataFrame([(1, "x", 2.0), (2, None, None)], "subject_id int, sex string, weight double")
    events = spark.createDataFrame([(7, 1, T0, "visit", 3.0), (8, 1, T0 - HOUR, "visit", 2.0)], "event_id long, subject_id int, timestamp timestamp, event_type string, age double")
    rows = spark.createDataFrame([(7, 1, T0, "bp", "high", T0, 5)], "event_id long, subject_id int, timestamp timestamp, code string, word string, seen timestamp, dose int")
    measures = [
        ES.Measurement("sex", "static", modifiers=("weight",)), ES.Measurement("age", "functional", "univariate_regression"),
        ES.Measurement("code", modality="multivariate_regression", values_column="word", modifiers=("seen", "dose")),
    ]
    d = ES.nested_documents(subjects, events, rows, measures)
    item = "struct<code:string,numeric_value:float,text_value:string,datetime_value:timestamp,modifiers:struct<dose:int,seen:timestamp,weight:double>>"
    assert d.schema.simpleString() == f"struct<patient_id:bigint,static_measurements:array<{item}>,events:array<struct<time:timestamp,measurements:array<{item}>>>>"
    assert ES.nested_schema({"subjects": subjects, "events": events, "measurements": rows}, measures).simpleString() == d.schema.simpleString()
    by = {r["patient_id"]: r for r in d.collect()}
    assert [e["time"] for e in by[1]["events"]] == [T0 - HOUR, T0]
    assert [(m["code"], m["numeric_value"], m["text_value"], m["modifiers"]["dose"]) for m in by[1]["events"][1]["measurements"]] == [("age", 3.0, None, None), ("code/bp", None, "high", 5), ("event_type/visit", None, None, None)]
    assert by[1]["static_measurements"][0]["modifiers"]["weight"] == 2.0 and by[2]["static_measurements"] == [] and by[2]["events"] == []
    plain = ES.nested_documents(subjects, events, rows, [ES.Measurement("sex", "static")])
    assert "modifiers" not in plain.schema.simpleString()
    with pytest.raises(ValueError):
        ES.nested_schema({"subjects": subjects}, [ES.Measurement("sex", "static", modifiers=("nothing",))])


def test_flat_features_of_a_source_need_one_exchange(spark):
    """Equal to extraction, merging and flattening one after another; subjects whole or, where one is large, by time."""
    rows = [(k, None if i % 11 == 5 else T0 + (i % 5) * 24 * HOUR, None if i % 13 == 3 else T0 + (i % 7) * 24 * HOUR, "ARN"[i % 3] if i % 4 else None, float(i % 3), "xy"[i % 2]) for k in (1, 2, None) for i in range(60)] + [(3, T0, T0, "A", float("nan"), None)] * 4
    df = spark.createDataFrame(rows, "k long, s timestamp, e timestamp, flag string, quantity double, line string").repartition(4)
    schema = InputSchema(df, "range", "k", {"flag": ("flag", "categorical")}, start_col="s", end_col="e", start_columns={"line": ("line", "categorical")}, end_columns={"quantity": ("quantity", "float")}, event_type=("DAY", "ADMIT", "LEAVE"))
    want = ES.flat_dynamic(*ES.agg_by_time(*ES.extract_events(schema)), Q.FLAG, ["A", "R"])
    large = ES.large_subjects(schema, 100)
    assert sorted(tuple(r) for r in large.collect()) == [(1, 120), (2, 120)]
    in_order = lambda d: sorted(map(repr, d.select(*want.columns).collect()))
    for sizes in (large, ES.large_subjects(schema), None):
        assert in_order(ES.flat_source(schema, Q.FLAG, ["A", "R"], sizes)) == in_order(want)
    whole = ES.flat_source(schema, Q.FLAG, ["A", "R"], ES.large_subjects(schema))
    cut, plain = (ES.flat_windows(whole, ["FULL", "3d"], counted=c) for c in (large, None))
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, plain.collect()))
    assert Segments.of(whole, "subject_id", ["timestamp"], 100, counted=large).heavy is not None


def test_queries_on_flat_features_shuffle_their_rows_once(spark):
    """The join of line items and orders, and one exchange of its rows by subject."""
    plan = Q.R.queries["ES25"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
    plan = Q.R.queries["ES26"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 9
    reads = Q.R.queries["ES27"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in reads and "lineitem" not in reads
