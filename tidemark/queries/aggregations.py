"""AG01-AG30 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.quantiles import with_quantiles
from tidemark.functions.scalars import years_between
from tidemark.operators import aggs as A
from tidemark.queries import Registry, t
from tidemark.queries.filtering import EPISODES, episodes

R = Registry()
r4 = lambda c: F.round(c, 4)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


@R.add("AG01", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS subjects FROM orders")
def ag01(spark, sf):
    return t(spark, sf, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("subjects"))


@R.add("AG02", "WITH o AS (SELECT nullif(o_orderstatus, 'P') AS s, CASE WHEN o_totalprice < 1000 THEN 'nan'::DOUBLE ELSE o_totalprice END AS p FROM orders) SELECT 's' AS \"column\", count(*) FILTER (s IS NULL) AS n_null, 0::BIGINT AS n_nan FROM o UNION ALL SELECT 'p', count(*) FILTER (p IS NULL), count(*) FILTER (isnan(p)) FROM o")
def ag02(spark, sf):
    o = t(spark, sf, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.when(F.col("o_totalprice") < 1000, float("nan")).otherwise(F.col("o_totalprice")).alias("p"))
    return A.null_report(o)


@R.add("AG03", "SELECT o_orderstatus, CAST(min(o_orderdate) AS DATE) AS min_d, CAST(max(o_orderdate) AS DATE) AS max_d, min(o_totalprice) AS min_p, max(o_totalprice) AS max_p FROM orders GROUP BY 1")
def ag03(spark, sf):
    return A.extent(t(spark, sf, "orders").select("o_orderstatus", F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("p")), ["d", "p"], ["o_orderstatus"])


@R.add("AG04", "SELECT year(o_orderdate) AS \"year\", count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, round(avg(CAST(o_totalprice < 1 AS INT)), 4) AS below_1, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY 1")
def ag04(spark, sf):
    return rounded(A.cost_summary(t(spark, sf, "orders"), "o_totalprice", F.year("o_orderdate")), "mean", "q25", "q50", "q75", "below_1", "share")


@R.add("AG05", "SELECT year(o_orderdate) AS \"year\", count(*) FILTER (o_orderstatus = 'P') AS n_null, round(avg(CAST(o_orderstatus = 'P' AS INT)), 4) AS null_rate, round(quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus = 'P'), 4) AS median_of_null FROM orders GROUP BY 1")
def ag05(spark, sf):
    o = t(spark, sf, "orders").withColumn("c", F.nullif("o_orderstatus", F.lit("P")))
    no = F.col("c").isNull()
    o = o.withColumn("year", F.year("o_orderdate"))
    rates = o.groupBy("year").agg(F.count_if(no).alias("n_null"), r4(F.avg(no.cast("int"))).alias("null_rate"))
    return with_quantiles(rates, o.filter(no), "o_totalprice", {"median_of_null": 0.5}, ["year"]).withColumn("median_of_null", r4(F.col("median_of_null")))


@R.add("AG06", "SELECT o_orderstatus, count(*) FILTER (o_totalprice < 0) AS below_0, count(*) FILTER (o_totalprice < 1) AS below_1, count(*) FILTER (o_totalprice < 5000) AS below_5000, count(*) FILTER (o_totalprice < 100000) AS \"below_100000\" FROM orders GROUP BY 1")
def ag06(spark, sf):
    return A.threshold_counts(t(spark, sf, "orders"), "o_totalprice", [0, 1, 5000, 100000], ["o_orderstatus"]).withColumnRenamed("below_1e+05", "below_100000")


@R.add("AG07", "SELECT x AS o_orderpriority, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM (SELECT nullif(o_orderpriority, '1-URGENT') AS x FROM orders) GROUP BY 1")
def ag07(spark, sf):
    return rounded(A.value_counts(t(spark, sf, "orders").select(F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority")), "o_orderpriority", percent=True), "percent")


@R.add("AG08", "SELECT o_orderstatus, count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.05), 4) AS p5, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, max(o_totalprice) AS max FROM orders GROUP BY 1")
def ag08(spark, sf):
    return rounded(A.describe(t(spark, sf, "orders"), "o_totalprice", [0.05, 0.95], ["o_orderstatus"]), "mean", "std", "p5", "p95")


@R.add("AG09", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def ag09(spark, sf):
    return A.edge_row(t(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "last").select("o_custkey", "o_orderkey", "o_totalprice")


@R.add("AG10", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def ag10(spark, sf):
    return A.edge_row(t(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "first").select("o_custkey", "o_orderkey")


@R.add("AG11", "SELECT o_custkey, string_agg(x, ',' ORDER BY o_orderdate, o_orderkey, i) AS codes FROM (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus AS x, 1 AS i FROM orders UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority, 2 FROM orders WHERE o_orderpriority <> '5-LOW') GROUP BY 1")
def ag11(spark, sf):
    o = t(spark, sf, "orders").withColumn("codes", F.array("o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW"))))
    return A.flat_list(o, "o_custkey", "codes", ["o_orderdate", "o_orderkey"]).select("o_custkey", F.array_join("codes", ",").alias("codes"))


@R.add("AG12", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_final, count(*) FILTER (o_totalprice > 100000 AND o_orderstatus = 'O') AS n_big_open FROM orders GROUP BY 1")
def ag12(spark, sf):
    return A.conditional_counts(t(spark, sf, "orders"), "o_custkey", {"n_final": F.col("o_orderstatus") == "F", "n_big_open": (F.col("o_totalprice") > 100_000) & (F.col("o_orderstatus") == "O")})


@R.add("AG13", "SELECT (SELECT count(DISTINCT o_orderkey) FROM orders) AS possible, count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_orderkey END) AS observed, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS total FROM lineitem")
def ag13(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("v"))
    return A.observation_counts(li, "l_orderkey", "v", t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")))


@R.add("AG14", "SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, round(avg(l_quantity) - 5 * stddev_samp(l_quantity), 4) AS thresh_low, round(avg(l_quantity) + 5 * stddev_samp(l_quantity), 4) AS thresh_high FROM lineitem GROUP BY 1")
def ag14(spark, sf):
    return rounded(A.key_stats(t(spark, sf, "lineitem"), "l_returnflag", "l_quantity", 5), "mean", "std", "thresh_low", "thresh_high")


@R.add("AG15", "SELECT l_returnflag, round(avg(CAST(v = round(v) AS INT)), 4) AS share_whole, count(DISTINCT v) AS n_distinct, avg(CAST(v = round(v) AS INT)) > 0.9 AS is_integer, count(DISTINCT v) < 30 AS is_categorical FROM (SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN l_discount ELSE l_quantity END AS v FROM lineitem) GROUP BY 1")
def ag15(spark, sf):
    li = t(spark, sf, "lineitem").withColumn("v", F.when(F.col("l_returnflag") == "R", F.col("l_discount")).otherwise(F.col("l_quantity")))
    return rounded(A.integrality(li, "l_returnflag", "v", 0.9, 30), "share_whole")


@R.add("AG16", "SELECT user_id, CASE WHEN bool_or(event_type = 'click') THEN true END AS click, CASE WHEN bool_or(event_type = 'purchase') THEN true END AS purchase FROM events GROUP BY 1")
def ag16(spark, sf):
    return A.presence(t(spark, sf, "events"), ["user_id"], "event_type", ["click", "purchase"])


@R.add("AG17", "SELECT l_orderkey, " + ", ".join(f"nullif(count(*) FILTER (l_returnflag = '{k}'), 0) AS {k}_count, CASE WHEN count(*) FILTER (l_returnflag = '{k}') > 0 THEN count(l_quantity) FILTER (l_returnflag = '{k}') END AS {k}_has_values_count, sum(l_quantity) FILTER (l_returnflag = '{k}') AS {k}_sum, sum(l_quantity * l_quantity) FILTER (l_returnflag = '{k}') AS {k}_sum_sqd, min(l_quantity) FILTER (l_returnflag = '{k}') AS {k}_min, max(l_quantity) FILTER (l_returnflag = '{k}') AS {k}_max" for k in "ANR") + " FROM lineitem GROUP BY 1")
def ag17(spark, sf):
    return A.key_value_wide(t(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", "l_quantity", ["A", "N", "R"])


@R.add("AG18", "SELECT o_custkey, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"n_{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY 1")
def ag18(spark, sf):
    return A.pivot_counts(t(spark, sf, "orders"), "o_custkey", "o_orderpriority", "n_", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@R.add("AG18_sparse", "SELECT o_custkey, string_agg(i || ':' || n, ',' ORDER BY i) AS pairs FROM (SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS i, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def ag18_sparse(spark, sf):
    o = t(spark, sf, "orders")
    index = o.select("o_orderpriority").distinct().withColumn("idx", F.substring("o_orderpriority", 1, 1).cast("int"))
    s = A.sparse_counts(o, "o_custkey", "o_orderpriority", index)
    pairs = F.transform(F.arrays_zip("indices", "counts"), lambda z: F.concat(z["indices"].cast("string"), F.lit(":"), z["counts"].cast("string")))
    return s.select("o_custkey", F.array_join(pairs, ",").alias("pairs"))


@R.add("AG19", "WITH v AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) SELECT o_orderkey, CAST(coalesce(s = 'F', false) AS INT) AS s_F, CAST(coalesce(s = 'O', false) AS INT) AS s_O, CAST(s IS NULL AS INT) AS s_null FROM v")
def ag19(spark, sf):
    return A.one_hot(t(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s")), ["s"])


@R.add("AG20", "SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '>20' END AS stratum, count(*) AS n_subjects, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def ag20(spark, sf):
    return A.stratify_counts(t(spark, sf, "orders"), "o_custkey")


@R.add("AG21", f"WITH {EPISODES} SELECT strftime(\"start\", '%Y-%m') AS month, count(*) AS n, round(avg(\"end\" - \"start\"), 4) AS mean_days FROM episodes WHERE \"start\" > DATE '1996-03-01' GROUP BY 1")
def ag21(spark, sf):
    return rounded(A.monthly_stay(episodes(spark, sf), "start", "end", "1996-03-01"), "mean_days")


@R.add("AG22", "SELECT c_custkey, count(user_id) AS n_events FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def ag22(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey")
    return A.events_per_subject(c, t(spark, sf, "events").withColumnRenamed("user_id", "c_custkey"), "c_custkey")


@R.add("AG23", "SELECT round(min(d), 4) AS min_minutes, round(avg(ln(d)), 4) AS mean_log, round(stddev_samp(ln(d)), 4) AS std_log FROM (SELECT (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 60e6 AS d FROM (SELECT DISTINCT user_id, ts FROM events)) WHERE d IS NOT NULL")
def ag23(spark, sf):
    return rounded(A.inter_event_stats(t(spark, sf, "events").select("user_id", "ts").distinct(), "user_id", "ts"), "min_minutes", "mean_log", "std_log")


@R.add("AG24", "SELECT CAST(sum(n) AS BIGINT) AS n_samples, quantile_cont(n, 0.5) AS median_per_subject, round(avg(m), 4) AS macro_mean, round(sum(n * m) / sum(n), 4) AS weighted_mean FROM (SELECT doc_id % 50 AS s, count(*) AS n, avg(toxic) AS m FROM labels GROUP BY 1)")
def ag24(spark, sf):
    return rounded(A.task_summary(t(spark, sf, "labels").withColumn("s", F.col("doc_id") % 50), "s", "toxic"), "macro_mean", "weighted_mean")


@R.add("AG25", """WITH e AS (SELECT event_type, user_id, date_trunc('week', ts) AS b FROM events), p AS (SELECT event_type, b, count(DISTINCT user_id) AS n_subjects, count(*) AS n_events FROM e GROUP BY ALL),
s AS (SELECT event_type, user_id, min(b) AS f, max(b) AS l FROM e GROUP BY ALL), x AS (SELECT event_type, f AS b, count(*) AS began FROM s GROUP BY ALL), y AS (SELECT event_type, l AS b, count(*) AS ended FROM s GROUP BY ALL),
j AS (SELECT p.*, coalesce(began, 0) AS began, coalesce(ended, 0) AS ended FROM p LEFT JOIN x USING (event_type, b) LEFT JOIN y USING (event_type, b))
SELECT event_type, CAST(b AS DATE) AS bucket, n_subjects, n_events, began, ended, CAST(sum(began) OVER w AS BIGINT) AS cumulative_subjects, CAST(sum(began) OVER w - sum(ended) OVER w + ended AS BIGINT) AS active_subjects FROM j WINDOW w AS (PARTITION BY event_type ORDER BY b)""")
def ag25(spark, sf):
    return A.activity(t(spark, sf, "events"), "user_id", "ts", "week", "event_type").withColumn("bucket", F.col("bucket").cast("date"))


@R.add("AG26", "WITH e AS (SELECT user_id, epoch_us(ts) / 31557600e6 - user_id % 40 AS a FROM events), p AS (SELECT user_id, round(a / 5) * 5 AS age_bucket, count(*) AS n, avg(a) AS m FROM e GROUP BY ALL) SELECT age_bucket, count(*) AS n_subjects, CAST(sum(n) AS BIGINT) AS n_events, round(avg(m), 4) AS mean_age, round(sum(n) / count(*), 4) AS events_per_subject FROM p GROUP BY 1")
def ag26(spark, sf):
    age = years_between(F.timestamp_micros(F.lit(0)), "ts") - F.col("user_id") % 40
    return rounded(A.age_activity(t(spark, sf, "events"), "user_id", age, 5.0), "mean_age", "events_per_subject")


@R.add("AG27", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS n_subjects FROM customer GROUP BY 1")
def ag27(spark, sf):
    return A.by_covariate(t(spark, sf, "customer"), "c_custkey", "c_mktsegment")


@R.add("AG28", """WITH d AS (SELECT o_totalprice AS y, o_totalprice * 0.9 + o_orderkey % 1000 AS p FROM orders), e AS (SELECT quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM d),
b AS (SELECT y, p, len(list_filter(list_distinct(q), lambda x: x < y)) AS decile FROM d, e), g AS (SELECT CAST(decile AS INT) AS decile, count(*) AS n, avg(y) AS t, avg(p) AS m FROM b GROUP BY 1)
SELECT decile, n, round(t, 4) AS mean_true, round(m, 4) AS mean_pred, round(abs(m - t), 4) AS abs_error, round(abs(m - t) / nullif(t, 0), 4) AS rel_error FROM g""")
def ag28(spark, sf):
    d = t(spark, sf, "orders").select(F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 0.9 + F.col("o_orderkey") % 1000).alias("p"))
    return rounded(A.decile_analysis(d, "y", "p"), "mean_true", "mean_pred", "abs_error", "rel_error")


@R.add("AG29", """WITH d AS (SELECT CAST(c_acctbal > 0 AS INT) AS outcome, c_nationkey, c_mktsegment FROM customer) SELECT 'c_nationkey' AS variable, NULL AS level, outcome, count(c_nationkey) AS n, NULL::DOUBLE AS percent, quantile_cont(c_nationkey, 0.5) AS median, quantile_cont(c_nationkey, 0.25) AS q25, quantile_cont(c_nationkey, 0.75) AS q75 FROM d GROUP BY 3
UNION ALL SELECT 'c_mktsegment', c_mktsegment, outcome, count(*), round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY outcome), 4), NULL, NULL, NULL FROM d GROUP BY c_mktsegment, outcome""")
def ag29(spark, sf):
    c = t(spark, sf, "customer").withColumn("outcome", (F.col("c_acctbal") > 0).cast("int"))
    return rounded(A.characteristics(c, "outcome", ["c_nationkey"], ["c_mktsegment"]), "percent")


_TESTS = """WITH d AS (SELECT CASE WHEN c_acctbal < 2000 THEN 'low' WHEN c_acctbal < 6000 THEN 'middle' ELSE 'high' END AS g, c_nationkey, c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS s FROM customer),
 l AS (SELECT 'c_nationkey' AS variable, c_nationkey AS v, g FROM d UNION ALL SELECT 'c_custkey', c_custkey, g FROM d),
 r AS (SELECT variable, v, g, rank() OVER (PARTITION BY variable ORDER BY v) + (count(*) OVER (PARTITION BY variable, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY variable) AS n, count(*) OVER (PARTITION BY variable, v) AS t FROM l),
 c AS (SELECT variable, any_value(n)::DOUBLE AS n, 1 - sum(t::DOUBLE * t - 1) / (any_value(n)::DOUBLE ^ 3 - any_value(n)) AS fix FROM r GROUP BY 1),
 q AS (SELECT variable, sum(rs * rs / k) AS q, count(*) - 1 AS dof FROM (SELECT variable, g, sum(rk)::DOUBLE AS rs, count(*) AS k FROM r GROUP BY ALL) GROUP BY 1),
 h AS (SELECT variable, 'kruskal' AS test, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / fix AS x, dof FROM q JOIN c USING (variable)),
 e AS (SELECT s, g, count(*)::DOUBLE AS k FROM d WHERE s IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(k) OVER (PARTITION BY s) AS a, sum(k) OVER (PARTITION BY g) AS b, sum(k) OVER () AS n FROM e),
 z AS (SELECT * FROM h UNION ALL SELECT 's', 'chi-square', any_value(n) * (sum(k * k / (a * b)) - 1), (count(DISTINCT s) - 1) * (count(DISTINCT g) - 1) FROM m)
SELECT variable, test, round(x, 4) AS statistic, dof, round(CASE dof WHEN 2 THEN exp(-x / 2) WHEN 8 THEN exp(-x / 2) * (1 + x / 2 + (x / 2) ^ 2 / 2 + (x / 2) ^ 3 / 6) END, 6) AS p_value FROM z"""


@R.add("AG29_tests", _TESTS)
def ag29_tests(spark, sf):
    from tidemark.operators.evaluation import group_tests

    level = F.when(F.col("c_acctbal") < 2000, "low").when(F.col("c_acctbal") < 6000, "middle").otherwise("high")
    c = t(spark, sf, "customer").select(level.alias("g"), "c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("s"))
    return group_tests(c, "g", ["c_nationkey", "c_custkey"], ["s"]).withColumn("statistic", F.round("statistic", 4)).withColumn("p_value", F.round("p_value", 6))


@R.add("AG30", "WITH m AS (SELECT o_orderstatus AS model, o_custkey % 5 AS fold, avg(o_totalprice) AS a, CAST(avg(o_totalprice) > 150000 AS INT) AS ok FROM orders GROUP BY ALL) SELECT model, round(avg(a), 4) AS a_mean, round(stddev_pop(a), 4) AS a_std, round(1.96 * stddev_pop(a) / sqrt(count(a)), 4) AS a_ci95, CAST(sum(ok) AS BIGINT) AS ok_sum FROM m GROUP BY 1")
def ag30(spark, sf):
    m = t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("model"), (F.col("o_custkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("a")).withColumn("ok", (F.col("a") > 150_000).cast("int"))
    return rounded(A.fold_summary(m, ["model"], ["a"], ["ok"]), "a_mean", "a_std", "a_ci95")
