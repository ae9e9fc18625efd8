"""J01-J15, set operations and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import portable_hash
from tidemark.operators import joins as J
from tidemark.operators import sets as S
from tidemark.operators.filters import subset
from tidemark.queries import Registry, t
from tidemark.queries.filtering import EPISODES, deaths, episodes

R = Registry()
H = lambda c, seed: f"CAST(concat('0x', substr(md5(concat({c}, ':', {seed})), 1, 8)) AS BIGINT)"


def _o(spark, sf):
    return t(spark, sf, "orders").withColumnRenamed("o_custkey", "k")


def _c(spark, sf):
    return t(spark, sf, "customer").withColumnRenamed("c_custkey", "k")


@R.add("J01", "SELECT o_custkey AS k, o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j01(spark, sf):
    return _o(spark, sf).join(_c(spark, sf), "k").select("k", "o_orderkey", "c_mktsegment")


@R.add("J02", "SELECT c_custkey AS k, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def j02(spark, sf):
    return _c(spark, sf).join(_o(spark, sf), "k", "left").select("k", "o_orderkey")


@R.add("J03", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j03(spark, sf):
    return _c(spark, sf).join(_o(spark, sf), "k", "left_anti").select("k")


@R.add("J04", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j04(spark, sf):
    return _o(spark, sf).join(_c(spark, sf).filter("c_acctbal < 0"), "k", "left_semi").select("o_orderkey")


@R.add("J05", "SELECT coalesce(a.k, b.k) AS k, a.n, b.m FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS m FROM events GROUP BY 1) b ON a.k = b.k")
def j05(spark, sf):
    a = _o(spark, sf).groupBy("k").agg(F.count("*").alias("n"))
    return a.join(t(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("m")), "k", "full")


@R.add("J06", "SELECT coalesce(a.k, b.k, c.k) AS k, n, m, bal FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS m FROM events GROUP BY 1) b ON a.k = b.k FULL JOIN (SELECT c_custkey AS k, c_acctbal AS bal FROM customer) c ON c.k = coalesce(a.k, b.k)")
def j06(spark, sf):
    a = _o(spark, sf).groupBy("k").agg(F.count("*").alias("n"))
    b = t(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("m"))
    return J.align([a, b, _c(spark, sf).select("k", F.col("c_acctbal").alias("bal"))], "k")


@R.add("J07", "WITH a AS (SELECT user_id, ts, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY ALL), b AS (SELECT user_id, ts, round(sum(value), 4) AS v FROM events GROUP BY ALL) SELECT user_id, epoch_us(ts) AS us, n, v FROM a JOIN b USING (user_id, ts)")
def j07(spark, sf):
    e = t(spark, sf, "events")
    a = e.filter("event_type <> 'click'").groupBy("user_id", "ts").agg(F.count("*").alias("n"))
    b = e.groupBy("user_id", "ts").agg(F.round(F.sum("value"), 4).alias("v"))
    return a.join(b, ["user_id", "ts"]).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "n", "v")


@R.add("J08", "SELECT c_custkey, coalesce(n_name, 'none') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def j08(spark, sf):
    return J.lookup(t(spark, sf, "customer"), t(spark, sf, "nation").filter("n_nationkey < 20"), "c_nationkey", "n_nationkey", "n_name", "nation", "none").select("c_custkey", "nation")


@R.add("J08_lists", "SELECT o_custkey AS k, string_agg(coalesce(CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END, 'none'), ',' ORDER BY o_orderkey) AS codes FROM orders GROUP BY 1")
def j08_lists(spark, sf):
    lists = _o(spark, sf).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda s: s["o_orderstatus"]).alias("codes"))
    dim = t(spark, sf, "orders").select("o_orderstatus").distinct().filter("o_orderstatus in ('F', 'O')").select("o_orderstatus", F.when(F.col("o_orderstatus") == "F", "final").otherwise("open").alias("name"))
    return J.lookup_array(lists, dim, "codes", "o_orderstatus", "name", "k", "none").select("k", F.array_join("codes", ",").alias("codes"))


@R.add("J09", "SELECT c_custkey, coalesce(m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j09(spark, sf):
    new = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("c_acctbal"))
    return J.update(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), new, "c_custkey", ["c_acctbal"])


@R.add("J10", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j10(spark, sf):
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    return J.on_keys(o, c, {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name")


@R.add("J11", f"WITH {EPISODES}, i AS (SELECT c_custkey AS subject, DATE '1994-01-01' + CAST(c_custkey * 7 % 2000 AS INT) AS died FROM customer WHERE c_custkey % 5 = 0) SELECT subject, l_orderkey, l_linenumber FROM episodes JOIN i USING (subject) WHERE \"start\" <= died AND \"start\" >= died - INTERVAL 24 MONTH")
def j11(spark, sf):
    return J.point_in_time(episodes(spark, sf), deaths(spark, sf), "subject", "start", "died", 24).select("subject", "l_orderkey", "l_linenumber")


@R.add("J12", "SELECT o_orderkey, round(o_totalprice / nullif(abs(c_acctbal), 0), 4) AS ratio FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j12(spark, sf):
    add = lambda d: d.withColumn("ratio", F.round(F.col("o_totalprice") / F.nullif(F.abs("c_acctbal"), F.lit(0.0)), 4))
    return J.with_static(_o(spark, sf), _c(spark, sf), "k", ["c_acctbal"], add).select("o_orderkey", "ratio")


@R.add("J13", "WITH m AS (SELECT o_custkey, o_orderdate, min(o_orderkey) AS e, list(o_orderkey) AS ids FROM orders GROUP BY ALL), x AS (SELECT e, unnest(ids) AS old FROM m) SELECT e AS event_id, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem JOIN x ON l_orderkey = old GROUP BY 1")
def j13(spark, sf):
    merged = t(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("event_id"), F.collect_list("o_orderkey").alias("old_event_ids"))
    m = J.rekey(t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "event_id"), merged)
    return m.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@R.add("J14", "WITH k AS (SELECT user_id, min(ts) + INTERVAL 5 DAY AS s, CASE WHEN user_id % 3 > 0 THEN min(ts) + INTERVAL 20 DAY END AS e FROM events GROUP BY 1), d AS (SELECT DISTINCT user_id, ts FROM events) SELECT k.user_id AS task_id, k.user_id AS subject_id, count(*) FILTER (ts < s) AS start_idx, count(*) FILTER (e IS NULL OR ts < e) AS end_idx FROM k JOIN d USING (user_id) GROUP BY k.user_id")
def j14(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("subject_id"), F.col("ts").cast("timestamp").alias("timestamp"))
    first = e.groupBy("subject_id").agg(F.min("timestamp").alias("f"))
    end = F.when(F.col("subject_id") % 3 > 0, F.col("f") + F.expr("interval 20 days"))
    tasks = first.select(F.col("subject_id").alias("task_id"), "subject_id", (F.col("f") + F.expr("interval 5 days")).alias("start_time"), end.alias("end_time"))
    return J.task_positions(e, tasks)


@R.add("J15", "SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_keys FROM embeddings JOIN labels ON vec_id = doc_id")
def j15(spark, sf):
    return J.join_counts(t(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), t(spark, sf, "labels"), "doc_id")


@R.add("SO01", "SELECT o_orderkey AS id, o_totalprice AS price, NULL AS kind FROM orders UNION ALL SELECT event_id, NULL, event_type FROM events")
def so01(spark, sf):
    a = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return S.diagonal([a, t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))])


@R.add("SO02", "SELECT CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT s_acctbal FROM supplier")
def so02(spark, sf):
    return S.relaxed([t(spark, sf, "part").select(F.col("p_size").alias("v")), t(spark, sf, "supplier").select(F.col("s_acctbal").alias("v"))])


@R.add("SO03", "SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def so03(spark, sf):
    return S.distinct_on(t(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderkey")


@R.add("SO04", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id AS k FROM events) SELECT 'minus' AS op, count(*) AS n FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'and', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'or', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)")
def so04(spark, sf):
    a, b = t(spark, sf, "orders").select(F.col("o_custkey").alias("k")), t(spark, sf, "events").select(F.col("user_id").alias("k"))
    parts = [f(a, b, "k").agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n") for name, f in (("minus", S.key_minus), ("and", S.key_and), ("or", S.key_or))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add("SL01", "SELECT o_custkey, o_orderdate::DATE AS d, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def sl01(spark, sf):
    return t(spark, sf, "orders").orderBy("o_custkey", F.desc("o_orderdate"), "o_orderkey").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderkey")


@R.add("SL02", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def sl02(spark, sf):
    return t(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey").offset(5).limit(10)


@R.add("SL03", f"SELECT o_orderkey, {H('o_orderkey', 3)} AS h FROM orders ORDER BY h, o_orderkey")
def sl03(spark, sf):
    return S.shuffle(t(spark, sf, "orders"), "o_orderkey", 3).select("o_orderkey", portable_hash("o_orderkey", 3).alias("h"))


@R.add("SL04", f"SELECT o_orderkey FROM orders WHERE {H('o_orderkey', 11)} < CAST(0.25 * 4294967296 AS BIGINT)")
def sl04(spark, sf):
    return subset(t(spark, sf, "orders"), "o_orderkey", 11, share=0.25).select("o_orderkey")


@R.add("SL05", "SELECT o_custkey, arg_min(o_orderkey, (abs(o_totalprice - 150000), o_orderkey)) AS nearest FROM orders GROUP BY 1")
def sl05(spark, sf):
    return S.nearest_row(t(spark, sf, "orders"), "o_custkey", "o_totalprice", 150_000, "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("nearest"))


@R.add("SL06", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def sl06(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")
