"""PF01-PF25 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import blank_to_null
from tidemark.operators import filters as P
from tidemark.operators.aggs import value_counts
from tidemark.queries import Registry, t

R = Registry()


def episodes(spark, sf, extra=()):
    """Line items as stays of a customer: start = ship date, end = start + quantity days."""
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    start = F.col("l_shipdate").cast("date")
    return joined.select(F.col("o_custkey").alias("subject"), "l_orderkey", "l_linenumber", start.alias("start"), F.date_add(start, F.col("l_quantity").cast("int")).alias("end"), F.col("l_extendedprice").alias("cost"), *extra)


EPISODES = """episodes AS MATERIALIZED (
  SELECT o_custkey AS subject, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS "start", CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS "end", l_extendedprice AS cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def day():
    return F.col("o_orderdate").cast("date")


@R.add("PF01", "SELECT c_custkey AS subject_id, c_mktsegment AS segment, c_acctbal AS c_acctbal FROM customer")
def pf01(spark, sf):
    up = t(spark, sf, "customer").select(F.col("c_custkey").alias("C_CUSTKEY"), F.col("c_mktsegment").alias("C_MktSegment"), F.col("c_acctbal").alias("C_AcctBal"))
    return P.rename(P.lower_names(up), {"c_custkey": "subject_id", "c_mktsegment": "segment"})


@R.add("PF02", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def pf02(spark, sf):
    o = t(spark, sf, "orders")
    return o.select(*P.pick_columns(o, prefix="o_", regex="key$"), *P.pick_columns(o, types=["double"], exclude=["o_orderdate"]))


@R.add("PF03", "SELECT o_custkey AS subject, o_orderkey AS record, CAST(o_orderdate AS DATE) AS start_date, 1 AS inpatient, NULL::INT AS emergency FROM orders UNION ALL SELECT user_id, event_id, CAST(ts AS DATE), NULL, 1 FROM events")
def pf03(spark, sf):
    a = P.harmonise(t(spark, sf, "orders"), {"subject": "o_custkey", "record": "o_orderkey", "start_date": day()}, "inpatient")
    b = P.harmonise(t(spark, sf, "events"), {"subject": "user_id", "record": "event_id", "start_date": F.col("ts").cast("date")}, "emergency")
    return a.unionByName(b, allowMissingColumns=True)


@R.add("PF04", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN 'PRIV' ELSE o_orderstatus END AS grp, CAST(o_orderstatus = 'F' AS INT) AS public FROM orders")
def pf04(spark, sf):
    rule = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100_000)
    return t(spark, sf, "orders").select("o_orderkey", P.recode("o_orderstatus", [(rule, "PRIV")]).alias("grp"), P.recode("o_orderstatus", [(F.col("o_orderstatus") == "F", 1)], 0).alias("public"))


@R.add("PF05", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def pf05(spark, sf):
    return t(spark, sf, "orders").replace({"F": "final", "O": "open"}, subset=["o_orderstatus"]).select("o_orderkey", "o_orderstatus")


@R.add("PF06", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) < 85 THEN 'other' ELSE p_brand END AS p_brand, CASE WHEN count(*) OVER (PARTITION BY p_size) < 40 AND p_size IS NOT NULL THEN 'other' ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part")
def pf06(spark, sf):
    part = t(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("p_size"))
    return P.fold_rare(P.fold_rare(part, ["p_brand"], 85), ["p_size"], 40)


@R.add("PF07", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL AND nullif(o_orderstatus, 'O') IS NULL")
def pf07(spark, sf):
    o = t(spark, sf, "orders").withColumn("x", F.nullif("o_orderstatus", F.lit("O")))
    return P.include(o, {"o_orderstatus": ["F", "O"], "o_orderpriority": True, "x": False}).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@R.add("PF08", f'WITH {EPISODES} SELECT subject, l_orderkey, l_linenumber, "start", "end" FROM episodes WHERE "end" < DATE \'1997-07-01\' AND "start" >= DATE \'1994-07-01\'')
def pf08(spark, sf):
    return P.study_window(episodes(spark, sf), "start", "end", "1994-07-01", "1997-07-01").select("subject", "l_orderkey", "l_linenumber", "start", "end")


@R.add("PF09", "SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1995-01-01' AND o_orderstatus IN ('O', 'P'))")
def pf09(spark, sf):
    early = (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")) & F.col("o_orderstatus").isin("O", "P")
    return P.exclude(t(spark, sf, "orders"), early).select("o_orderkey")


@R.add("PF10", "SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1")
def pf10(spark, sf):
    return P.min_rows(t(spark, sf, "orders"), "o_custkey", 2).select("o_orderkey", "o_custkey")


@R.add("PF11", "SELECT p_partkey FROM part WHERE NOT (coalesce(p_brand, '') = (SELECT min(p_brand) FROM part) AND coalesce((p_size - 1) / 100.0, 1) < 1e-6)")
def pf11(spark, sf):
    part = t(spark, sf, "part")
    code = part.agg(F.min("p_brand")).first()[0]
    return P.exclude(part.withColumn("age", (F.col("p_size") - 1) / 100.0), P.unqualified_newborns("p_brand", "age", code)).select("p_partkey")


_DEATHS = "SELECT c_custkey AS subject, DATE '1994-01-01' + CAST(c_custkey * 7 % 2000 AS INT) AS died FROM customer WHERE c_custkey % 5 = 0"


def deaths(spark, sf):
    died = F.date_add(F.lit("1994-01-01").cast("date"), (F.col("c_custkey") * 7 % 2000).cast("int"))
    return t(spark, sf, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("subject"), died.alias("died"))


@R.add("PF12", f"WITH {EPISODES}, d AS ({_DEATHS}) SELECT subject, l_orderkey, l_linenumber FROM episodes WHERE subject NOT IN (SELECT subject FROM episodes JOIN d USING (subject) GROUP BY subject HAVING max(\"end\") > min(died))")
def pf12(spark, sf):
    return P.drop_after_event(episodes(spark, sf), "subject", "end", deaths(spark, sf), "died").select("subject", "l_orderkey", "l_linenumber")


@R.add("PF13", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def pf13(spark, sf):
    o = t(spark, sf, "orders").withColumn("age", F.when(F.col("o_totalprice") > 200_000, F.col("o_totalprice")))
    return P.drop_all_null(o, "o_custkey", "age").select("o_orderkey")


@R.add("PF14", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND o_totalprice < 50000)")
def pf14(spark, sf):
    return P.drop_by_edge_row(t(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_totalprice") < 50_000).select("o_orderkey")


@R.add("PF15", "WITH k AS (SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(*) >= 12), e AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c FROM k)) SELECT 'subjects' AS what, count(*) AS n FROM k UNION ALL SELECT 'events', count(*) FROM e UNION ALL SELECT 'measurements', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM e)")
def pf15(spark, sf):
    subjects = t(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"))
    events = t(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("event_id"))
    parts = P.min_events_cascade(subjects, events, t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "event_id"), 12)
    counts = [p.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, p in zip(("subjects", "events", "measurements"), parts, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@R.add("PF16", "SELECT event_id, event_type FROM events WHERE nullif(event_type, 'click') IS NOT NULL")
def pf16(spark, sf):
    e = t(spark, sf, "events").withColumn("kind", F.nullif("event_type", F.lit("click")))
    return e.dropna(subset=["kind"]).select("event_id", "event_type")


@R.add("PF17", "WITH k AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id FROM k ORDER BY CAST(concat('0x', substr(md5(concat(user_id, ':', 7)), 1, 8)) AS BIGINT), user_id LIMIT 20) SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM s)")
def pf17(spark, sf):
    return P.subset(t(spark, sf, "events"), "user_id", 7, n=20).select("event_id", "user_id")


@R.add("PF18", "SELECT event_id, coalesce(nullif(event_type, 'click'), nullif(event_type, 'view'), 'other') AS kind FROM events")
def pf18(spark, sf):
    return t(spark, sf, "events").select("event_id", F.coalesce(F.nullif("event_type", F.lit("click")), F.nullif("event_type", F.lit("view")), F.lit("other")).alias("kind"))


@R.add("PF19", "SELECT l_orderkey, l_linenumber, s, CASE WHEN e < s THEN s ELSE e END AS e, coalesce(f, s) AS f FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s, CAST(o_orderdate AS DATE) AS e, CASE WHEN l_linenumber > 1 THEN CAST(l_shipdate AS DATE) END AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def pf19(spark, sf):
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    d = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("s"), day().alias("e"))
    return P.repair_dates(d.withColumn("f", F.when(F.col("l_linenumber") > 1, F.col("s"))), "s", "e", fill_start="f")


@R.add("PF20", "SELECT p_partkey, p_size FROM part")
def pf20(spark, sf):
    return P.narrow(t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size")))


@R.add("PF21", "SELECT o_orderkey FROM orders")
def pf21(spark, sf):
    return P.validate_id(t(spark, sf, "orders"), "o_orderkey").select("o_orderkey")


@R.add("PF22", "SELECT count(*) AS n, count(*) AS n_ids FROM events")
def pf22(spark, sf):
    e = P.validate_table(t(spark, sf, "events").drop("event_id"), "event_id", ["user_id"], "ts", ["c_mktsegment"])
    return e.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


@R.add("PF23", "SELECT c_custkey AS subject, CAST(c_acctbal > 0 AS INT) AS label FROM customer")
def pf23(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), (F.col("c_acctbal") > 0).cast("int").alias("label"))
    return P.validate_labels(c.select("subject"), c, "subject")


@R.add("PF24", "WITH a AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1), w AS (SELECT coalesce(a.doc_id, b.doc_id) AS d, a.n AS x, b.n AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id) SELECT 'docs' AS \"table\", CAST(sum(x) AS BIGINT) AS \"rows\", count(x) AS keys, count(*) - count(x) AS missing FROM w UNION ALL SELECT 'labels', CAST(sum(y) AS BIGINT), count(y), count(*) - count(y) FROM w")
def pf24(spark, sf):
    return P.alignment({"docs": t(spark, sf, "documents"), "labels": t(spark, sf, "labels")}, "doc_id")


@R.add("PF25", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 10")
def pf25(spark, sf):
    seqs = t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderdate")).alias("times"))
    return P.min_length(seqs, "times", 10).select("o_custkey", F.size("times").cast("long").alias("n"))


@R.add("SF15", "SELECT event_type, count(*) AS n FROM (SELECT nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, '') AS event_type FROM events) GROUP BY 1")
def sf15(spark, sf):
    e = t(spark, sf, "events").select(blank_to_null(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))).alias("event_type"))
    return value_counts(e, "event_type").withColumnRenamed("count", "n")
