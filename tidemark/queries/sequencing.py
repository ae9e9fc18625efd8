"""SQ01-SQ09 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sequences as Q
from tidemark.queries import Registry, t
from tidemark.queries.aggregations import rounded
from tidemark.queries.joining import H

R = Registry()


def _seqs(spark, sf):
    """Per user the event ids in time order and their values."""
    s = t(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return s.select("user_id", F.transform("s", lambda x: x["event_id"]).alias("ids"), F.transform("s", lambda x: x["value"]).alias("values"))


_N = "r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@R.add("SQ01", f"WITH {_N}, k AS (SELECT *, greatest(n - 5, 0) AS a, {H('user_id', 1)} % (greatest(n - 5, 0) + 1) AS b FROM r) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY i) FILTER (i >= a) AS to_end, string_agg(event_id::VARCHAR, ',' ORDER BY i) FILTER (i < 5) AS from_start, string_agg(event_id::VARCHAR, ',' ORDER BY i) FILTER (i >= b AND i < b + 5) AS random FROM k GROUP BY 1")
def sq01(spark, sf):
    out = None
    for s in ("TO_END", "FROM_START", "RANDOM"):
        part = Q.window(_seqs(spark, sf), ["ids"], 5, s, "user_id", 1).select("user_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias(s.lower()))
        out = part if out is None else out.join(part, "user_id")
    return out


@R.add("SQ02", f"WITH {_N} SELECT user_id, least(max(n), 40) AS n_true, string_agg(event_id::VARCHAR, ',' ORDER BY i) FILTER (i < 40) || repeat(',0', CAST(greatest(40 - max(n), 0) AS INT)) AS ids FROM r GROUP BY 1")
def sq02(spark, sf):
    cut = Q.window(_seqs(spark, sf), ["ids", "values"], 40, "FROM_START", "user_id")
    p = Q.pad(cut, ["ids", "values"], 40)
    return p.select("user_id", F.size(F.filter("mask", lambda m: m)).cast("long").alias("n_true"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@R.add("SQ03", f"WITH {_N} SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY i) AS ids FROM r WHERE event_id <> 0 GROUP BY 1")
def sq03(spark, sf):
    dense = Q.pad(_seqs(spark, sf), ["ids", "values"], 64, "left")
    return Q.depad(dense, "ids", ["values"]).filter(F.size("ids") > 0).select("user_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@R.add("SQ04", "WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) SELECT conv_id, string_agg(role, ',' ORDER BY k, i) AS roles FROM (SELECT conv_id, role, i, 1 AS k FROM r WHERE i BETWEEN 2 AND 4 UNION ALL SELECT conv_id, role, i, 2 FROM r WHERE i = 1) GROUP BY 1")
def sq04(spark, sf):
    s = t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    d = Q.ragged_concat(Q.ragged_slice(s, ["roles"], 1, 4), Q.ragged_slice(s, ["roles"], 0, 1), "conv_id", ["roles"])
    return d.select("conv_id", F.array_join("roles", ",").alias("roles"))


_V = "v AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n, CAST(substr(o_orderpriority, 1, 1) AS INT) AS a, CASE o_orderstatus WHEN 'F' THEN 11 WHEN 'O' THEN 12 ELSE 13 END AS b FROM orders)"


@R.add("SQ06", f"WITH {_V}, w AS (SELECT o_custkey, CAST(i - greatest(n - 6, 0) AS INT) AS position, a, b, CAST(least(n, 6) AS INT) AS m FROM v WHERE i > n - 6), s AS (SELECT DISTINCT o_custkey, m FROM w) SELECT o_custkey, 0 AS position, 20 AS token FROM s UNION ALL SELECT o_custkey, position, a FROM w UNION ALL SELECT o_custkey, position, b FROM w UNION ALL SELECT o_custkey, m, 21 FROM s UNION ALL SELECT o_custkey, CAST(p AS INT), 22 FROM s, range(1, 8) t(p) WHERE p > m")
def sq06(spark, sf):
    code = F.array(F.substring("o_orderpriority", 1, 1).cast("int"), F.when(F.col("o_orderstatus") == "F", 11).when(F.col("o_orderstatus") == "O", 12).otherwise(13))
    v = t(spark, sf, "orders").withColumn("c", code).groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "c"))), lambda x: x["c"]).alias("visits"))
    return Q.visit_tokens(v, "o_custkey", "visits", 8, 20, 21, 22)


@R.add("SQ07", "WITH e AS (SELECT label, vec_id, vec_id % 3 = 0 AS m, embedding[1] AS x FROM embeddings) SELECT label, round(coalesce(avg(x) FILTER (NOT m), 0), 4) AS mean, round(CAST(coalesce(max(x) FILTER (NOT m), 0) AS DOUBLE), 4) AS max, round(CAST(arg_max(x, vec_id) FILTER (NOT m) AS DOUBLE), 4) AS last FROM e GROUP BY 1")
def sq07(spark, sf):
    e = t(spark, sf, "embeddings").withColumn("live", F.col("vec_id") % 3 != 0)
    out = None
    for how in ("mean", "max", "last"):
        part = Q.pool(e, "label", "embedding", how, ["vec_id"], "live").select("label", F.round(F.get("embedding", F.lit(0)), 4).alias(how))
        out = part if out is None else out.join(part, "label")
    return out


@R.add("SQ08")
def sq08(spark, sf):
    return Q.encode_texts(t(spark, sf, "documents"), "doc_id", "text", 16, wide=True)


@R.add("SQ09", "SELECT user_id, round(avg(CASE WHEN event_type <> 'click' THEN CAST(value > 50 AS INT) END), 4) AS mean_label, round(avg(CAST(event_type = 'click' AS INT)), 4) AS frac_invalid FROM events GROUP BY 1 HAVING count(*) FILTER (event_type <> 'click') > 0")
def sq09(spark, sf):
    labeler = lambda d: d.select("user_id", (F.col("value") > 50).alias("label"), (F.col("event_type") != "click").alias("valid"))
    return rounded(Q.label_samples(t(spark, sf, "events"), labeler, "user_id"), "mean_label", "frac_invalid").select("user_id", "mean_label", "frac_invalid")
