"""ES01-ES28 on the test tables: customers as subjects, ``events`` as point events, line items as stays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators import eventstream as ES
from tidemark.plans import fitting
from tidemark.queries import Registry, t
from tidemark.queries.aggregations import rounded
from tidemark.queries.joining import H
from tidemark.sources.schema import DatasetSchema, InputSchema
from tidemark.sources.shared import materialize

R = Registry()
KIND = ES.Measurement("kind")
FLAG = ES.Measurement("flag", modality="multivariate_regression", values_column="quantity")


def static_schema(spark, sf):
    return InputSchema(t(spark, sf, "customer"), "static", "c_custkey", {"c_mktsegment": ("segment", "categorical"), "c_acctbal": ("balance", "float")})


def point_schema(spark, sf, **more):
    return InputSchema(t(spark, sf, "events"), "event", "user_id", {"event_type": ("kind", "categorical"), "value": ("value", "float")}, ts_col="ts", event_type="COL:event_type", **more)


def stays(spark, sf, of=None):
    """Line items as stays; ``of``: (subject_id) of the customers wanted, if not all."""
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    o = o if of is None else o.join(of, o["o_custkey"] == of["subject_id"], "left_semi")
    d = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    end = F.timestamp_micros(micros("l_shipdate") + (F.col("l_quantity").cast("long") - 1) * 86_400_000_000)
    return d.select("o_custkey", F.col("l_shipdate").cast("timestamp").alias("s"), end.alias("e"), "l_returnflag", "l_quantity", "l_linestatus")


def range_schema(spark, sf, of=None):
    return InputSchema(stays(spark, sf, of), "range", "o_custkey", {"l_returnflag": ("flag", "categorical")}, start_col="s", end_col="e", start_columns={"l_linestatus": ("line", "categorical")}, end_columns={"l_quantity": ("quantity", "float")}, event_type=("DAY", "ADMIT", "LEAVE"))


def points(spark, sf):
    return ES.extract_events(point_schema(spark, sf))


PTS = "pts AS (SELECT DISTINCT user_id AS subject_id, ts, event_type, CAST(value AS FLOAT) AS value FROM events)"
RNG = """rng AS (SELECT DISTINCT o_custkey AS subject_id, epoch_us(l_shipdate) AS s, epoch_us(l_shipdate) + (CAST(l_quantity AS BIGINT) - 1) * 86400000000 AS e, l_returnflag AS flag, l_linestatus AS line, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 rp AS (SELECT subject_id, s AS us, 'DAY' AS event_type, flag, line, quantity FROM rng WHERE s = e UNION SELECT subject_id, s, 'ADMIT', flag, line, NULL FROM rng WHERE s < e UNION SELECT subject_id, e, 'LEAVE', flag, NULL, quantity FROM rng WHERE s < e)"""


@R.add("ES01", "SELECT c_custkey AS subject_id, c_mktsegment AS segment, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS balance FROM customer")
def es01(spark, sf):
    return ES.build_subjects(static_schema(spark, sf)).withColumn("balance", F.col("balance").cast("double"))


@R.add("ES02", f"WITH {PTS}, e AS (SELECT DISTINCT subject_id, ts, event_type FROM pts WHERE event_type <> 'view'), a AS (SELECT event_type, count(*) AS n_events FROM e GROUP BY 1) SELECT event_type, n_events, n_measurements FROM a JOIN (SELECT event_type, count(*) AS n_measurements FROM pts GROUP BY 1) USING (event_type)")
def es02(spark, sf):
    kinds = [r[0] for r in t(spark, sf, "events").select("event_type").distinct().collect() if r[0] != "view"]
    e, m = ES.extract_events(point_schema(spark, sf, must_have={"event_type": kinds}))
    n = e.join(m.groupBy("event_id").agg(F.count("*").alias("k")), "event_id", "left")
    return n.groupBy("event_type").agg(F.count("*").alias("n_events"), F.sum("k").alias("n_measurements"))


@R.add("ES03", f"WITH {RNG} SELECT subject_id, us, event_type, count(*) AS n, count(line) AS n_line, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS q FROM rp GROUP BY subject_id, us, event_type")
def es03(spark, sf):
    e, m = ES.extract_events(range_schema(spark, sf))
    per = m.groupBy("event_id").agg(F.count("*").alias("n"), F.count("line").alias("n_line"), F.coalesce(F.sum("quantity"), F.lit(0)).cast("long").alias("q"))
    return e.join(per, "event_id").select("subject_id", micros("timestamp").alias("us"), "event_type", "n", "n_line", "q")


@R.add("ES04", f"WITH {PTS}, {RNG}, u AS (SELECT subject_id, epoch_us(ts) AS us, event_type, 'p' AS src FROM pts UNION ALL SELECT subject_id, us, event_type, 'r' FROM rp) SELECT event_type, count(DISTINCT (subject_id, us)) AS n_events, count(*) AS n_measurements FROM u GROUP BY 1")
def es04(spark, sf):
    _, e, m = ES.extract(DatasetSchema(static_schema(spark, sf), [point_schema(spark, sf), range_schema(spark, sf)]))
    n = e.join(m.groupBy("event_id").agg(F.count("*").alias("k")), "event_id", "left")
    return n.groupBy("event_type").agg(F.count("*").alias("n_events"), F.sum("k").alias("n_measurements"))


@R.add("ES05", f"WITH {PTS}, b AS (SELECT subject_id, event_type, f + CAST(floor((epoch_us(ts) - f) / 604800000000) AS BIGINT) * 604800000000 AS us FROM (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY subject_id) AS f FROM pts)) SELECT subject_id, us, string_agg(DISTINCT event_type, '&' ORDER BY event_type) AS event_type, count(*) AS n FROM b GROUP BY subject_id, us")
def es05(spark, sf):
    e, m = ES.agg_by_time(*points(spark, sf), "7d")
    return e.join(m.groupBy("event_id").agg(F.count("*").alias("n")), "event_id").select("subject_id", micros("timestamp").alias("us"), "event_type", "n")


@R.add("ES06", f"WITH {PTS} SELECT DISTINCT subject_id, epoch_us(ts) AS us, round((epoch_us(ts) - epoch_us(TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * (subject_id % 9000))) / 31557600e6, 6) AS age, CASE WHEN hour(ts) < 6 THEN 'EARLY_AM' WHEN hour(ts) < 12 THEN 'AM' WHEN hour(ts) < 21 THEN 'PM' ELSE 'LATE_PM' END AS time_of_day FROM pts")
def es06(spark, sf):
    e = points(spark, sf)[0].select("subject_id", "timestamp").distinct()
    people = e.select("subject_id").distinct().withColumn("birth_date", F.timestamp_micros(F.col("subject_id") % 9000 * 86_400_000_000))
    d = ES.add_functors(e, people, ["age", "time_of_day"])
    return d.select("subject_id", micros("timestamp").alias("us"), F.round("age", 6).alias("age"), "time_of_day")


_ES07 = f"SELECT c_custkey AS subject_id, CASE WHEN r < round(0.8 * n) THEN 'train' WHEN r < round(0.9 * n) THEN 'tuning' ELSE 'held_out' END AS split FROM (SELECT c_custkey, row_number() OVER (ORDER BY {H('c_custkey', 1)}, c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer)"


def _splits(spark, sf):
    return ES.split_subjects(t(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id")), [0.8, 0.1, 0.1])


@R.add("ES07", _ES07)
def es07(spark, sf):
    return _splits(spark, sf)


@R.add("ES08", f"WITH {PTS}, s AS ({_ES07}), e AS (SELECT DISTINCT subject_id, ts, event_type FROM pts) SELECT 'subjects' AS what, count(*) AS n FROM s WHERE split = 'train' UNION ALL SELECT 'events', count(*) FROM e JOIN s USING (subject_id) WHERE split = 'train' UNION ALL SELECT 'measurements', count(*) FROM pts JOIN s USING (subject_id) WHERE split = 'train'")
def es08(spark, sf):
    subjects = t(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"))
    e, m = points(spark, sf)
    view = ES.split_view({"subjects": subjects, "events": e, "measurements": m}, _splits(spark, sf), "train")
    parts = [view[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k in ("subjects", "events", "measurements")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


FIT = (
    ES.Measurement("flag"), ES.Measurement("big", modality="univariate_regression"), ES.Measurement("k", modality="multivariate_regression", values_column="v"), ES.Measurement("price", modality="univariate_regression"),
    ES.Measurement("part"), ES.Measurement("segment", "static"), ES.Measurement("month", "functional", "univariate_regression"), ES.Measurement("none"),
)

_FIT_SQL = f"""WITH s AS ({_ES07}), tr AS (SELECT subject_id FROM s WHERE split = 'train'),
 li AS (SELECT l_orderkey AS u, nullif(l_returnflag, 'N') AS flag, CASE WHEN l_quantity > 49 THEN l_quantity END AS big, CASE WHEN l_orderkey = 1 THEN 'rare' ELSE l_returnflag END AS k,
   CASE WHEN l_returnflag = 'R' THEN l_extendedprice WHEN l_returnflag = 'A' THEN l_linenumber % 3 ELSE l_quantity END AS v, l_extendedprice AS price, l_partkey AS part
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT subject_id FROM tr)),
 od AS (SELECT o_orderkey AS u, month(o_orderdate) AS m FROM orders WHERE o_custkey IN (SELECT subject_id FROM tr)), cu AS (SELECT c_custkey AS u, c_mktsegment AS g FROM customer WHERE c_custkey IN (SELECT subject_id FROM tr)),
 lo AS (SELECT 'flag' AS measure, u, flag AS k, CAST(NULL AS DOUBLE) AS v FROM li UNION ALL SELECT 'big', u, CASE WHEN big IS NOT NULL THEN 'big' END, big FROM li UNION ALL SELECT 'k', u, k, v FROM li UNION ALL SELECT 'price', u, 'price', price FROM li
   UNION ALL SELECT 'part', u, CAST(part AS VARCHAR), NULL FROM li UNION ALL SELECT 'segment', u, g, NULL FROM cu UNION ALL SELECT 'month', u, 'month', m FROM od),
 ra AS (SELECT measure, count(DISTINCT u) AS possible, count(DISTINCT CASE WHEN k IS NOT NULL THEN u END) AS observed, count(k) AS total FROM lo GROUP BY 1),
 st AS (SELECT *, CASE WHEN observed < CAST(round_even(possible * 0.2, 0) AS BIGINT) THEN 'rare' ELSE 'kept' END AS status FROM ra),
 ke AS (SELECT lo.* FROM lo JOIN st USING (measure) WHERE status = 'kept' AND k IS NOT NULL),
 se AS (SELECT measure, k, count(*) AS n, avg(CAST(v = round(v) AS INT)) AS sh, count(DISTINCT v) AS d, count(DISTINCT round(v)) AS dr FROM ke WHERE measure IN ('k', 'price', 'month') GROUP BY 1, 2),
 ty AS (SELECT measure, k, CASE WHEN n < 50 THEN 'dropped' WHEN sh > 0.9 AND dr < 5 THEN 'categorical_integer' WHEN sh <= 0.9 AND d < 5 THEN 'categorical_float' WHEN sh > 0.9 THEN 'integer' ELSE 'float' END AS t FROM se),
 nu AS (SELECT measure, k, CASE WHEN t = 'integer' THEN round(v) ELSE v END AS v FROM ke JOIN ty USING (measure, k) WHERE t IN ('integer', 'float')),
 th AS (SELECT measure, k, avg(v) - 1.5 * stddev_samp(v) AS lo, avg(v) + 1.5 * stddev_samp(v) AS hi FROM nu GROUP BY 1, 2),
 ms AS (SELECT measure, k, avg(v) AS mean, stddev_samp(v) AS std FROM nu JOIN th USING (measure, k) WHERE v > lo AND v < hi GROUP BY 1, 2),
 el AS (SELECT measure, CASE WHEN t = 'categorical_integer' THEN k || '__EQ_' || CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE k END AS e FROM ke LEFT JOIN ty USING (measure, k) WHERE measure NOT IN ('price', 'month')),
 co AS (SELECT measure, CASE WHEN n < CAST(round_even(total * 0.05, 0) AS BIGINT) THEN 'UNK' ELSE e END AS e, sum(n) AS n FROM (SELECT measure, e, count(*) AS n FROM el GROUP BY 1, 2) JOIN ra USING (measure) GROUP BY 1, 2),
 al AS (SELECT * FROM co UNION ALL SELECT DISTINCT measure, 'UNK', 0 FROM co WHERE measure NOT IN (SELECT measure FROM co WHERE e = 'UNK')),
 nb AS (SELECT *, CASE WHEN e = 'UNK' THEN 0 ELSE row_number() OVER (PARTITION BY measure, e = 'UNK' ORDER BY n DESC, e DESC) END AS i, sum(n) OVER (PARTITION BY measure) AS t FROM al),
 go AS (SELECT measure FROM nb GROUP BY 1 HAVING max(i) = 0)
SELECT measure, 'measure' AS what, CASE WHEN measure IN (SELECT measure FROM go) THEN 'unknown only' ELSE status END AS name, CAST(possible AS DOUBLE) AS a, CAST(observed AS DOUBLE) AS b, CAST(total AS DOUBLE) AS c, CAST(NULL AS DOUBLE) AS d FROM st
UNION ALL SELECT 'none', 'measure', 'absent', 0, 0, 0, NULL
UNION ALL SELECT ty.measure, 'numeric', ty.k || ':' || t, round(lo, 3), round(hi, 3), round(mean, 3), round(std, 3) FROM ty LEFT JOIN th ON th.measure = ty.measure AND th.k = ty.k LEFT JOIN ms ON ms.measure = ty.measure AND ms.k = ty.k
UNION ALL SELECT measure, 'element', e, CAST(i AS DOUBLE), CAST(n AS DOUBLE), round(n / t, 6), NULL FROM nb WHERE measure NOT IN (SELECT measure FROM go)"""


@R.add("ES09", _FIT_SQL)
def es09(spark, sf):
    rows = _values(spark, sf).join(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("subject_id"), F.col("l_orderkey").alias("event_id"), F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.when(F.col("l_quantity") > 49, F.col("l_quantity")).alias("big"), "k", "v", F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("part"))
    subjects = t(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"))
    events = t(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("event_id"), F.month("o_orderdate").alias("month"))
    train = ES.split_view({"subjects": subjects, "events": events, "measurements": rows}, _splits(spark, sf), "train")
    fitted = fitting.fit_measures(train, FIT, min_observed=0.2, min_key=50, min_element=0.05, outlier_c=1.5)
    d = lambda c, digits=3: F.round(F.col(c).cast("double"), digits)
    status = fitted.status.select("measure", F.lit("measure").alias("what"), F.col("status").alias("name"), d("possible").alias("a"), d("observed").alias("b"), d("total").alias("c"), F.lit(None).cast("double").alias("d"))
    numeric = fitted.numeric.select("measure", F.lit("numeric").alias("what"), F.concat_ws(":", "key", "value_type").alias("name"), d("thresh_low").alias("a"), d("thresh_high").alias("b"), d("mean").alias("c"), d("std").alias("d"))
    words = fitted.vocabulary.select("measure", F.lit("element").alias("what"), F.col("element").alias("name"), d("idx").alias("a"), d("count").alias("b"), d("freq", 6).alias("c"), F.lit(None).cast("double").alias("d"))
    return status.unionByName(numeric).unionByName(words)


def _values(spark, sf):
    """A key with whole values, one with few, one with fractions and one that is rare."""
    v = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).when(F.col("l_returnflag") == "A", F.pmod("l_linenumber", F.lit(3)).cast("double")).otherwise(F.col("l_quantity"))
    key = F.when(F.col("l_orderkey") == 1, "rare").otherwise(F.col("l_returnflag"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice", key.alias("k"), v.alias("v"))


VALS = "vals AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_orderkey = 1 THEN 'rare' ELSE l_returnflag END AS k, CASE WHEN l_returnflag = 'R' THEN l_extendedprice WHEN l_returnflag = 'A' THEN l_linenumber % 3 ELSE l_quantity END AS v FROM lineitem)"
META = f"""{VALS}, seen AS (SELECT k AS "key", count(*) AS n, avg(CAST(v = round(v) AS INT)) AS sh, count(DISTINCT v) AS d, count(DISTINCT round(v)) AS dr FROM vals GROUP BY 1),
 typ AS (SELECT "key", CASE WHEN n < 50 THEN 'dropped' WHEN sh > 0.9 AND dr < 5 THEN 'categorical_integer' WHEN sh <= 0.9 AND d < 5 THEN 'categorical_float' WHEN sh > 0.9 THEN 'integer' ELSE 'float' END AS value_type FROM seen),
 num AS (SELECT "key", CASE WHEN value_type = 'integer' THEN round(v) ELSE v END AS v FROM vals JOIN typ ON k = "key" WHERE value_type IN ('integer', 'float')),
 th AS (SELECT "key", avg(v) - 1.5 * stddev_samp(v) AS thresh_low, avg(v) + 1.5 * stddev_samp(v) AS thresh_high FROM num GROUP BY 1),
 ms AS (SELECT "key", avg(v) AS mean, stddev_samp(v) AS std FROM num JOIN th USING ("key") WHERE v > thresh_low AND v < thresh_high GROUP BY 1)"""


def _meta(spark, sf):
    return ES.fit_numeric(_values(spark, sf), "k", "v", min_key=50, outlier_c=1.5)


@R.add("ES10", f'WITH {META} SELECT "key", value_type, round(thresh_low, 4) AS thresh_low, round(thresh_high, 4) AS thresh_high, round(mean, 4) AS mean, round(std, 4) AS std FROM typ LEFT JOIN th USING ("key") LEFT JOIN ms USING ("key")')
def es10(spark, sf):
    return rounded(_meta(spark, sf), "thresh_low", "thresh_high", "mean", "std")


@R.add("ES11", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity > m - 1.5 * s AND l_quantity < m + 1.5 * s) AS n_inliers FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m, stddev_samp(l_quantity) OVER (PARTITION BY l_returnflag) AS s FROM lineitem) GROUP BY 1")
def es11(spark, sf):
    from tidemark.operators.aggs import key_stats

    li = t(spark, sf, "lineitem")
    d = li.join(key_stats(li, "l_returnflag", "l_quantity", 1.5), "l_returnflag")
    inlier = (F.col("l_quantity") > F.col("thresh_low")) & (F.col("l_quantity") < F.col("thresh_high"))
    return d.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(inlier).alias("n_inliers"))


VOC = "voc AS (SELECT event_type AS element, count(*) AS count FROM events GROUP BY 1)"


def _vocab(spark, sf):
    return ES.fit_vocabulary(t(spark, sf, "events"), "event_type", "kind")


@R.add("ES12", f"WITH {VOC} SELECT 'kind' AS measure, element, count, round(count / sum(count) OVER (), 6) AS freq, CAST(row_number() OVER (ORDER BY count DESC, element DESC) AS INT) AS idx FROM voc UNION ALL SELECT 'kind', 'UNK', 0, 0, 0")
def es12(spark, sf):
    return _vocab(spark, sf).withColumn("freq", F.round("freq", 6))


@R.add("ES13", f"WITH {VOC}, c AS (SELECT quantile_disc(count, 0.5) AS cut FROM voc), f AS (SELECT CASE WHEN count < cut THEN 'UNK' ELSE element END AS element, sum(count) AS count FROM voc, c GROUP BY 1), g AS (SELECT * FROM f UNION ALL SELECT 'UNK', 0 WHERE NOT EXISTS (SELECT 1 FROM f WHERE element = 'UNK')) SELECT 'kind' AS measure, element, CAST(count AS BIGINT) AS count, CASE WHEN element = 'UNK' THEN 0 ELSE CAST(row_number() OVER (ORDER BY element = 'UNK', count DESC, element DESC) AS INT) END AS idx FROM g")
def es13(spark, sf):
    v = _vocab(spark, sf)
    cut = v.filter("idx > 0").agg(F.expr("percentile_disc(0.5) within group (order by count)")).first()[0]
    return ES.filter_vocabulary(v, cut, "kind").select("measure", "element", "count", "idx")


@R.add("ES14", f"""WITH {META} SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN value_type = 'categorical_integer' THEN k || '__EQ_' || CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE k END AS k,
 CASE WHEN value_type IN ('integer', 'float') AND v > thresh_low AND v < thresh_high THEN round((v - mean) / std, 6) END AS v, CASE WHEN value_type IN ('integer', 'float') THEN v > thresh_low AND v < thresh_high END AS v_is_inlier FROM vals JOIN typ ON k = typ."key" LEFT JOIN th ON k = th."key" LEFT JOIN ms ON k = ms."key\"""")
def es14(spark, sf):
    d = ES.transform_numeric(_values(spark, sf).drop("l_returnflag", "l_quantity", "l_extendedprice"), "k", "v", _meta(spark, sf))
    return d.withColumn("v", F.round(F.nanvl("v", F.lit(None).cast("double")), 6))


@R.add("ES15", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'UNK' END AS kind, event_type NOT IN ('click', 'view') AS lost FROM events")
def es15(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), "value")
    v = ES.fit_vocabulary(e.filter("kind in ('click', 'view')"), "kind")
    return ES.transform_categorical(e, "kind", v, "value").select("event_id", "kind", F.isnan("value").alias("lost"))


@R.add("ES16", f"WITH {META} SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(v, 3) AS v FROM vals JOIN typ ON k = typ.\"key\" JOIN th ON k = th.\"key\" WHERE value_type IN ('integer', 'float') AND v > thresh_low AND v < thresh_high")
def es16(spark, sf):
    meta = _meta(spark, sf)
    d = ES.denormalise(ES.transform_numeric(_values(spark, sf), "k", "v", meta), "k", "v", meta).filter("v_is_inlier")
    return d.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round("v", 3).alias("v"))


def _unified(spark, sf):
    return ES.unify([_vocab(spark, sf), ES.fit_vocabulary(t(spark, sf, "customer"), "c_mktsegment", "segment")])


UNI = f"""{VOC}, seg AS (SELECT c_mktsegment AS element, count(*) AS count FROM customer GROUP BY 1),
 al AS (SELECT 'kind' AS measure, element, row_number() OVER (ORDER BY count DESC, element DESC) AS idx FROM voc UNION ALL SELECT 'kind', 'UNK', 0 UNION ALL SELECT 'segment', element, row_number() OVER (ORDER BY count DESC, element DESC) FROM seg UNION ALL SELECT 'segment', 'UNK', 0),
 uni AS (SELECT measure, element, idx, CASE measure WHEN 'kind' THEN 1 ELSE 2 END AS measurement_index, 1 + idx + CASE measure WHEN 'kind' THEN 0 ELSE (SELECT count(*) + 1 FROM voc) END AS global_idx FROM al)"""


@R.add("ES17", f"WITH {UNI} SELECT measure, element, CAST(idx AS INT) AS idx, measurement_index, CAST(global_idx AS BIGINT) AS global_idx FROM uni")
def es17(spark, sf):
    return _unified(spark, sf).select("measure", "element", "idx", "measurement_index", "global_idx")


@R.add("ES18", f"WITH {UNI} SELECT event_id, measurement_index, CAST(global_idx AS BIGINT) AS index, NULL::DOUBLE AS value FROM events JOIN uni ON measure = 'kind' AND element = event_type")
def es18(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"))
    return ES.melt(e, ["event_id"], [KIND], _unified(spark, sf))


def _sequences(spark, sf):
    v = _unified(spark, sf)
    people = ES.build_subjects(static_schema(spark, sf))
    e, m = ES.agg_by_time(*points(spark, sf))
    static = ES.melt(people, ["subject_id"], [ES.Measurement("segment", "static")], v)
    return ES.sequences(people, e, static, ES.melt(m, ["event_id"], [KIND], v))


@R.add("ES19", f"WITH {PTS}, e AS (SELECT subject_id, ts, count(*) AS m FROM pts GROUP BY ALL), g AS (SELECT subject_id, count(*) AS n, CAST(sum(m) AS BIGINT) AS n_measurements, epoch_us(min(ts)) AS us, round(date_diff('microsecond', min(ts), max(ts)) / 60e6, 4) AS span FROM e GROUP BY 1) SELECT c_custkey AS subject_id, n, n_measurements, us, span FROM customer LEFT JOIN g ON subject_id = c_custkey")
def es19(spark, sf):
    s = _sequences(spark, sf)
    inner = F.aggregate(F.col("dynamic_indices"), F.lit(0), lambda a, x: a + F.size(x)).cast("long")
    n = F.when(F.col("time").isNotNull(), F.size("time").cast("long"))
    return s.select("subject_id", n.alias("n"), inner.alias("n_measurements"), micros("start_time").alias("us"), F.round(F.element_at("time", -1), 4).alias("span"))


NESTED = (
    ES.Measurement("kind", modifiers=("value", "late")), ES.Measurement("value", modality="univariate_regression", modifiers=("late",)), ES.Measurement("kind2", modality="multivariate_regression", values_column="note"),
    ES.Measurement("hour", "functional", "univariate_regression"), ES.Measurement("segment", "static", modifiers=("balance",)), ES.Measurement("balance", "static", "univariate_regression"),
)

_NESTED_SQL = f"""WITH {PTS}, e AS (SELECT DISTINCT subject_id, ts, event_type FROM pts), c AS (SELECT c_custkey AS subject_id, c_mktsegment AS g, CAST(c_acctbal AS FLOAT) AS b FROM customer),
 p AS (SELECT subject_id, ts, event_type, event_type AS kind, CAST(value AS FLOAT) AS v, ts >= TIMESTAMP '2024-01-15' AS late FROM pts WHERE subject_id IN (SELECT subject_id FROM c)), z AS (
 SELECT subject_id, NULL AS us, 'segment/' || g AS code, CAST(NULL AS FLOAT) AS x, CAST(NULL AS VARCHAR) AS t, b AS mb, CAST(NULL AS BOOLEAN) AS ml, CAST(NULL AS FLOAT) AS mv FROM c WHERE g IS NOT NULL
 UNION ALL SELECT subject_id, NULL, 'balance', b, NULL, NULL, NULL, NULL FROM c WHERE b IS NOT NULL
 UNION ALL SELECT subject_id, epoch_us(ts), 'event_type/' || event_type, NULL, NULL, NULL, NULL, NULL FROM e WHERE subject_id IN (SELECT subject_id FROM c)
 UNION ALL SELECT subject_id, epoch_us(ts), 'hour', hour(ts), NULL, NULL, NULL, NULL FROM e WHERE subject_id IN (SELECT subject_id FROM c)
 UNION ALL SELECT subject_id, epoch_us(ts), 'kind/' || kind, NULL, NULL, NULL, late, v FROM p WHERE kind IS NOT NULL
 UNION ALL SELECT subject_id, epoch_us(ts), 'value', v, NULL, NULL, late, NULL FROM p WHERE v IS NOT NULL
 UNION ALL SELECT subject_id, epoch_us(ts), 'kind2/' || kind, NULL, upper(kind), NULL, NULL, NULL FROM p WHERE kind IS NOT NULL)
SELECT subject_id AS patient_id, us, code, round(CAST(x AS DOUBLE), 3) AS numeric_value, t AS text_value, round(CAST(mb AS DOUBLE), 3) AS mod_balance, ml AS mod_late, round(CAST(mv AS DOUBLE), 3) AS mod_value FROM z"""


@R.add("ES20", _NESTED_SQL)
def es20(spark, sf):
    events, rows = points(spark, sf)
    rows = rows.withColumn("late", F.col("timestamp") >= F.lit("2024-01-15").cast("timestamp")).withColumn("kind2", F.col("kind")).withColumn("note", F.upper("kind"))
    d = ES.nested_documents(ES.build_subjects(static_schema(spark, sf)), events.withColumn("hour", F.hour("timestamp")), rows, NESTED)
    none = F.struct(F.lit(None).cast("timestamp").alias("time"), F.col("static_measurements").alias("measurements"))
    parts = d.select("patient_id", F.explode(F.concat(F.array(none), "events")).alias("e")).select("patient_id", micros("e.time").alias("us"), F.explode("e.measurements").alias("m"))
    r = lambda c, name: F.round(F.col(c).cast("double"), 3).alias(name)
    return parts.select("patient_id", "us", "m.code", r("m.numeric_value", "numeric_value"), "m.text_value", r("m.modifiers.balance", "mod_balance"), F.col("m.modifiers.late").alias("mod_late"), r("m.modifiers.value", "mod_value"))


@R.add("ES21", f"WITH {VOC} SELECT 'dynamic/kind/' || element || '/count' AS feature FROM voc UNION ALL SELECT '7d/kind/' || element || '/count' FROM voc UNION ALL SELECT 'static/segment/' || c_mktsegment || '/present' FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def es21(spark, sf):
    v = _unified(spark, sf)
    return ES.feature_catalogue(v, [KIND, ES.Measurement("segment", "static")], ["7d"])


@R.add("ES22", "SELECT c_custkey AS subject_id, CASE WHEN c_mktsegment = 'BUILDING' THEN true END AS building, CASE WHEN c_mktsegment = 'MACHINERY' THEN true END AS machinery FROM customer")
def es22(spark, sf):
    d = ES.flat_static(ES.build_subjects(static_schema(spark, sf)), "segment", ["BUILDING", "MACHINERY"])
    return d.toDF("subject_id", "building", "machinery")


def _flat(spark, sf):
    e, m = ES.agg_by_time(*ES.extract_events(range_schema(spark, sf)))
    return ES.flat_dynamic(e, m, FLAG, ["A", "R"])


def _flat_by_subject(schema):
    """(flat rows, large subjects) of a source."""
    large = ES.large_subjects(schema)
    return ES.flat_source(schema, FLAG, ["A", "R"], large), large


FLAT = f"{RNG}, fl AS (SELECT subject_id, us, count(*) FILTER (flag = 'A') AS a_count, count(quantity) FILTER (flag = 'A') AS a_n, sum(quantity) FILTER (flag = 'A') AS a_sum, sum(quantity * quantity) FILTER (flag = 'A') AS a_sqd, max(quantity) FILTER (flag = 'R') AS r_max FROM rp GROUP BY ALL)"


@R.add("ES23", f"WITH {FLAT} SELECT subject_id, us, a_count, a_n, a_sum, a_sqd, r_max FROM fl")
def es23(spark, sf):
    c = lambda f, a: F.col(f"`dynamic/flag/{f}/{a}`")
    return _flat(spark, sf).select("subject_id", micros("timestamp").alias("us"), c("A", "count").alias("a_count"), c("A", "has_values_count").alias("a_n"), c("A", "sum").alias("a_sum"), c("A", "sum_sqd").alias("a_sqd"), c("R", "max").alias("r_max"))


@R.add("ES24", f"WITH {FLAT} SELECT subject_id, us, nullif(a_count, 0) AS a_count, a_sum, NULL::BIGINT AS z_count FROM fl")
def es24(spark, sf):
    d = ES.normalise_columns(_flat(spark, sf), ["dynamic/flag/A/count", "dynamic/flag/A/sum", "dynamic/flag/Z/count"], ["subject_id", "timestamp"], True)
    return d.toDF("subject_id", "timestamp", "a_count", "a_sum", "z_count").withColumn("us", micros("timestamp")).drop("timestamp")


_WIN = "PARTITION BY subject_id ORDER BY us"


@R.add("ES25", f"WITH {FLAT} SELECT subject_id, us, CAST(sum(a_count) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS full_count, sum(a_sum) OVER (w RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS past_sum, max(r_max) OVER (w RANGE BETWEEN 1 FOLLOWING AND 604800000000 FOLLOWING) AS next_max FROM fl WINDOW w AS ({_WIN})")
def es25(spark, sf):
    flat, large = _flat_by_subject(range_schema(spark, sf))
    w = ES.flat_windows(flat, ["FULL", "7d", "-7d"], counted=large)
    return w.select("subject_id", micros("timestamp").alias("us"), F.col("`FULL/flag/A/count`").alias("full_count"), F.col("`7d/flag/A/sum`").alias("past_sum"), F.col("`-7d/flag/R/max`").alias("next_max"))


@R.add("ES26", f"WITH {FLAT}, w AS (SELECT subject_id, us, CAST(sum(a_count) OVER ({_WIN} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS full_count FROM fl), k AS (SELECT c_custkey AS subject_id, epoch_us(TIMESTAMP '1996-01-01') AS e, c_acctbal > 0 AS label, c_mktsegment FROM customer WHERE c_custkey % 2 = 0), l AS (SELECT subject_id, max(us) AS us, any_value(label) AS label, any_value(c_mktsegment) AS seg FROM fl JOIN k USING (subject_id) WHERE us <= e GROUP BY 1) SELECT subject_id, us, label, full_count, CASE WHEN seg = 'BUILDING' THEN true END AS building FROM l JOIN w USING (subject_id, us)")
def es26(spark, sf):
    people = ES.build_subjects(static_schema(spark, sf))
    tasks = people.filter("subject_id % 2 = 0").select("subject_id", F.lit("1996-01-01").cast("timestamp").alias("end_time"), (F.col("balance") > 0).alias("label"))
    flat, large = _flat_by_subject(range_schema(spark, sf, tasks.select("subject_id")))
    full = ES.flat_windows(flat, ["FULL"], counted=large)
    d = ES.load_flat(ES.flat_static(people, "segment", ["BUILDING"]), flat.drop("event_id"), {"FULL": full}, tasks, large=large)
    return d.select("subject_id", micros("timestamp").alias("us"), "label", F.col("`FULL/flag/A/count`").alias("full_count"), F.col("`static/segment/BUILDING/present`").alias("building"))


@R.add("ES27", f"WITH {FLAT} SELECT subject_id, us, a_count, round(a_sum / nullif(a_n, 0), 4) AS a_mean, round(a_sqd / nullif(a_n, 0) - pow(a_sum / nullif(a_n, 0), 2), 4) AS a_var FROM fl")
def es27(spark, sf):
    flat, _ = _flat_by_subject(range_schema(spark, sf))
    rows = materialize(ES.mean_and_variance(flat.drop("event_id")), "flat")  # read twice: to find empty columns, and for the rest
    d = ES.drop_empty(rows, ["subject_id", "timestamp"])
    return d.select("subject_id", micros("timestamp").alias("us"), F.col("`dynamic/flag/A/count`").alias("a_count"), F.round(F.col("`dynamic/flag/A/mean`"), 4).alias("a_mean"), F.round(F.col("`dynamic/flag/A/variance`"), 4).alias("a_var"))


@R.add("ES28", f"WITH {PTS}, {VOC} SELECT 'size' AS what, 'subjects' AS name, CAST(count(*) AS VARCHAR) AS value FROM customer UNION ALL SELECT 'size', 'events', CAST(count(DISTINCT (subject_id, ts, event_type)) AS VARCHAR) FROM pts UNION ALL SELECT 'size', 'measurements', CAST(count(*) AS VARCHAR) FROM pts UNION ALL SELECT 'vocabulary', 'kind', CAST(count(*) AS VARCHAR) FROM voc UNION ALL SELECT 'head', 'kind', string_agg(element, ', ' ORDER BY i) FROM (SELECT element, row_number() OVER (ORDER BY count DESC, element DESC) AS i FROM voc) WHERE i <= 3 UNION ALL SELECT 'tail', 'kind', string_agg(element, ', ' ORDER BY i DESC) FROM (SELECT element, row_number() OVER (ORDER BY count, element) AS i FROM voc) WHERE i <= 3")
def es28(spark, sf):
    e, m = points(spark, sf)
    return ES.describe(ES.build_subjects(static_schema(spark, sf)), e, m, _vocab(spark, sf))
