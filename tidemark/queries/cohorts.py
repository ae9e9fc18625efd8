"""CO01-CO30 on the test tables. Stays are line items of a customer; costs are order prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import filters as P
from tidemark.operators import windows as Wn
from tidemark.plans import cohort as C
from tidemark.plans import costs, features, labels
from tidemark.queries import Registry, t
from tidemark.queries.aggregations import rounded
from tidemark.queries.filtering import _DEATHS, EPISODES, deaths, episodes
from tidemark.queries.joining import H
from tidemark.queries.windowing import history

R = Registry()
MONTHS = {"6mo": 6, "12mo": 12, "24mo": 24}


def _day():
    return F.col("o_orderdate").cast("date")


def index_dates(spark, sf):
    """Per customer one order by hash; its date is the index."""
    o = t(spark, sf, "orders")
    return Wn.pick_random(o, "o_custkey", ["o_orderdate", "o_orderkey"], 42).select(F.col("o_custkey").alias("subject"), _day().alias("index_date"))


INDEX = f"idx AS MATERIALIZED (SELECT o_custkey AS subject, CAST(o_orderdate AS DATE) AS index_date FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE i = {H('o_custkey', 42)} % n)"
HOR = f"{INDEX}, hor AS MATERIALIZED (SELECT subject, index_date, h AS horizon, CAST(index_date + to_months(m) AS DATE) AS endpoint FROM idx, (VALUES ('6mo', 6), ('12mo', 12), ('24mo', 24)) v(h, m))"


def orders_as_stays(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), _day().alias("start"), F.col("o_totalprice").alias("cost"))


_AGE = 'WITH %s, d AS (%s), a AS (SELECT *, CASE WHEN l_linenumber <> 3 THEN cost END AS age FROM episodes WHERE "end" < DATE \'1998-01-01\' AND "start" >= DATE \'1993-01-01\' AND NOT (cost < 2000)), b AS (SELECT * FROM a WHERE subject IN (SELECT subject FROM a GROUP BY 1 HAVING count(*) >= 2)), c AS (SELECT * FROM b WHERE subject NOT IN (SELECT subject FROM b JOIN d USING (subject) GROUP BY subject HAVING max("end") > min(died))), e AS (SELECT * FROM c WHERE subject IN (SELECT subject FROM c WHERE age IS NOT NULL))' % (EPISODES, _DEATHS)  # noqa: UP031


def _cohort(spark, sf):
    e = episodes(spark, sf).withColumn("age", F.when(F.col("l_linenumber") != 3, F.col("cost")))
    return C.select_cohort(e, deaths(spark, sf), "1993-01-01", "1998-01-01", drop=[F.col("cost") < 2000])


@R.add("CO01", f"{_AGE} SELECT 'subjects' AS what, count(DISTINCT subject) AS n FROM e UNION ALL SELECT 'records', count(DISTINCT l_orderkey) FROM e")
def co01(spark, sf):
    out = C.cohort_outputs(_cohort(spark, sf), "subject", {"records": "l_orderkey"})
    return out["subjects"].agg(F.count("*").alias("n")).select(F.lit("subjects").alias("what"), "n").unionByName(out["records"].agg(F.count("*").alias("n")).select(F.lit("records").alias("what"), "n"))


@R.add("CO02", f"{_AGE} SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM e)")
def co02(spark, sf):
    ids = _cohort(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"))
    return C.restrict(t(spark, sf, "orders"), ids, "o_orderkey").select("o_orderkey")


@R.add("CO03", f"""WITH {EPISODES}, p AS (SELECT *, CASE WHEN l_orderkey % 4 = 0 THEN 'm' END AS sex, l_orderkey * 37 % 100000 AS secs FROM episodes)
SELECT l_orderkey, l_linenumber, epoch_us(CAST("start" AS TIMESTAMP)) + 1000000 * least(86399, secs) AS us, coalesce(last_value(sex IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(sex IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sex,
 CAST(greatest(0, coalesce("start" - lag("end") OVER w, 0)) AS INT) AS gap_days, count(*) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS n_before, CAST("end" - "start" + 1 AS INT) AS stay_days, 'L' || l_linenumber AS codes
FROM p WINDOW w AS (PARTITION BY subject ORDER BY "start", "end", l_orderkey, l_linenumber)""")
def co03(spark, sf):
    e = episodes(spark, sf).withColumn("sex", F.when(F.col("l_orderkey") % 4 == 0, "m")).withColumn("secs", F.col("l_orderkey") * 37 % 100_000)
    e = e.withColumn("c1", F.concat(F.lit("L"), F.col("l_linenumber").cast("string"))).withColumn("c2", F.lit(""))
    d = C.preprocess(e, "subject", "start", "secs", "end", "secs", ["sex"], ["c1", "c2", "c1"], ["start", "end", "l_orderkey", "l_linenumber"])
    return d.select("l_orderkey", "l_linenumber", F.unix_micros("start_ts").alias("us"), "sex", "gap_days", "n_before", "stay_days", F.array_join("codes", ",").alias("codes"))


@R.add("CO04", "WITH u AS (SELECT l_orderkey, l_returnflag || '.1' AS code FROM lineitem UNION ALL SELECT l_orderkey, nullif(l_linestatus, 'F') FROM lineitem), b AS (SELECT DISTINCT l_orderkey, l_linenumber AS block FROM lineitem) SELECT DISTINCT l_orderkey, regexp_replace(code, '\\..*$', '') AS code, NULL AS chapter FROM u WHERE code IS NOT NULL UNION ALL SELECT l_orderkey, CAST(block AS VARCHAR), CASE WHEN block <= 2 THEN 'low' WHEN block <= 5 THEN 'mid' ELSE 'high' END FROM b")
def co04(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", F.concat("l_returnflag", F.lit(".1")).alias("c1"), F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("l_linestatus")).alias("c2"), F.col("l_linenumber").cast("string").alias("b1"))
    d = C.melt_codes(li, ["l_orderkey"], ["c1", "c2"]).withColumn("chapter", F.lit(None).cast("string"))
    b = C.melt_blocks(li, ["l_orderkey"], ["b1"], [2, 5], ["low", "mid", "high"]).select("l_orderkey", F.col("block").cast("string").alias("code"), "chapter")
    return d.unionByName(b)


@R.add("CO05", "SELECT o_custkey, o_orderstatus, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def co05(spark, sf):
    return C.static_table(t(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])


def _map(spark, sf):
    return C.data_map(t(spark, sf, "orders"), ["o_totalprice"], ["o_orderstatus", "o_orderpriority"], 1000)


MAP = "fo AS (SELECT 'o_orderstatus' AS variable, CASE WHEN count(*) < 1000 THEN 'other' ELSE o_orderstatus END AS value FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', CASE WHEN count(*) < 1000 THEN 'other' ELSE o_orderpriority END FROM orders GROUP BY o_orderpriority), mp AS (SELECT variable, value, CAST(row_number() OVER (PARTITION BY variable ORDER BY value) - 1 AS INT) AS code FROM (SELECT DISTINCT * FROM fo))"
EDGE = "ed AS (SELECT list_distinct(list_transform(quantile_cont(o_totalprice, [" + ", ".join(f"{i / 100}" for i in range(5, 100, 5)) + "]), lambda x: x)) AS e FROM orders)"


@R.add("CO06", f"WITH {MAP}, {EDGE} SELECT variable, value, code FROM mp UNION ALL SELECT 'o_totalprice', NULL, CAST(len(e) AS INT) FROM ed")
def co06(spark, sf):
    edges, codes = _map(spark, sf)
    one = codes.limit(1).select(F.lit("o_totalprice").alias("variable"), F.lit(None).cast("string").alias("value"), F.lit(len(edges["o_totalprice"])).alias("code"))
    return codes.unionByName(one)


@R.add("CO07", f"WITH {MAP}, s AS (SELECT variable, count(*) AS size FROM mp GROUP BY 1) SELECT variable, size, CAST(sum(size) OVER w AS BIGINT) - size AS \"start\", CAST(sum(size) OVER w AS BIGINT) AS \"end\" FROM s WINDOW w AS (ORDER BY variable ROWS UNBOUNDED PRECEDING)")
def co07(spark, sf):
    codes = _map(spark, sf)[1]
    return C.variable_map(codes.groupBy("variable").agg(F.count("*").alias("size")))


def _visits(spark, sf, orders=None):
    edges, codes = _map(spark, sf)
    return C.encode_visits(t(spark, sf, "orders") if orders is None else orders, "o_custkey", ["o_orderdate", "o_orderkey"], edges, codes, {"o_totalprice": 100, "o_orderpriority": 0, "o_orderstatus": 50})


VIS = f"""{MAP}, {EDGE}, tok AS (SELECT o_custkey, o_orderdate, o_orderkey, 100 + len(list_filter(e, lambda x: x < o_totalprice)) AS p, coalesce(a.code, (SELECT code FROM mp WHERE variable = 'o_orderpriority' AND value = 'other')) AS q, 50 + coalesce(b.code, (SELECT code FROM mp WHERE variable = 'o_orderstatus' AND value = 'other')) AS s
 FROM orders, ed LEFT JOIN (SELECT * FROM mp WHERE variable = 'o_orderpriority') a ON a.value = o_orderpriority LEFT JOIN (SELECT * FROM mp WHERE variable = 'o_orderstatus') b ON b.value = o_orderstatus)"""


@R.add("CO08", f"WITH {VIS} SELECT o_custkey, string_agg(q || ' ' || s || ' ' || p, ',' ORDER BY o_orderdate, o_orderkey) AS visits FROM tok GROUP BY 1")
def co08(spark, sf):
    return _visits(spark, sf).select("o_custkey", F.array_join(F.transform("visits", lambda v: F.array_join(v.cast("array<string>"), " ")), ",").alias("visits"))


@R.add("CO09", f"WITH {INDEX} SELECT o_custkey, CAST(count(*) AS INT) AS n_visits FROM orders JOIN idx ON subject = o_custkey WHERE CAST(o_orderdate AS DATE) <= index_date GROUP BY 1")
def co09(spark, sf):
    o = t(spark, sf, "orders").join(index_dates(spark, sf).withColumnRenamed("subject", "o_custkey"), "o_custkey").filter(_day() <= F.col("index_date"))
    return _visits(spark, sf, o).select("o_custkey", F.size("visits").alias("n_visits"))


@R.add("CO10", "SELECT CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM orders GROUP BY 1")
def co10(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("ppn"))
    parts = C.split_by_lists(t(spark, sf, "orders"), {"test": c.filter("ppn % 5 = 0"), "train": c.filter("ppn % 5 <> 0")}, "o_custkey", "ppn")
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("split"), "n") for k, d in parts.items()]
    return counts[0].unionByName(counts[1])


def _costs(spark, sf):
    return costs.load(t(spark, sf, "orders").select(F.col("o_orderkey").alias("RECNUM"), F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("TOTAL")), "RECNUM", "TOTAL")


@R.add("CO11", "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 50 <> 0) AS n_known, count(*) FILTER (o_orderkey % 50 <> 0 AND o_totalprice < 5000) AS below_5000 FROM orders")
def co11(spark, sf):
    return _costs(spark, sf).agg(F.count("*").alias("n"), F.count("cost").alias("n_known"), F.count_if(F.col("cost") < 5000).alias("below_5000"))


@R.add("CO12", "SELECT o_orderkey, round(o_totalprice * (100 + 3 * 6) / (100 + 3 * (year(o_orderdate) - 1992)), 6) AS adjusted FROM orders")
def co12(spark, sf):
    o = t(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    cpi = o.select(F.col("y").alias("year")).distinct().withColumn("cpi", (100 + 3 * (F.col("year") - 1992)).cast("double"))
    return costs.inflate(o, "o_totalprice", "y", cpi, 1998).select("o_orderkey", F.round("adjusted", 6).alias("adjusted"))


@R.add("CO13", "WITH r AS (SELECT o_orderkey, o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders), q AS (SELECT min(v) FILTER (k = CAST(round((n - 1) * 0.025) AS BIGINT)) AS l, min(v) FILTER (k = CAST(round((n - 1) * 0.975) AS BIGINT)) AS h FROM r) SELECT o_orderkey, least(greatest(v, l), h) AS o_totalprice FROM r, q")
def co13(spark, sf):
    return costs.winsorize(t(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "o_totalprice")


@R.add("CO14")
def co14(spark, sf):
    """The target is missing on a tenth of the rows; trees are fitted, so rows are only checked in tests."""
    o = t(spark, sf, "orders").withColumn("cost", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice"))).withColumn("month", F.month("o_orderdate"))
    d = costs.impute(o.select("o_orderkey", "cost", "month", "o_orderstatus", "o_orderpriority"), "cost", ["month"], ["o_orderstatus", "o_orderpriority"], match="o_orderkey", iterations=5)
    return d.select("o_orderkey", "cost", "cost_imputed")


@R.add("CO14_chained")
def co14_chained(spark, sf):
    """Cost, month and priority are missing on other rows each; three rounds of trees, values are checked in tests."""
    o = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("cost"), F.when(F.col("o_orderkey") % 7 != 3, F.month("o_orderdate")).alias("month"), "o_orderstatus", F.when(F.col("o_orderkey") % 11 != 5, F.col("o_orderpriority")).alias("priority"))
    return costs.chained(o, "o_orderkey", ["cost", "month"], ["o_orderstatus", "priority"])[0]


@R.add("CO15", "SELECT CAST(o_orderkey AS VARCHAR) AS record, o_totalprice AS cost FROM orders UNION ALL SELECT CAST(event_id AS VARCHAR), value FROM events")
def co15(spark, sf):
    a = t(spark, sf, "orders").select(F.col("o_orderkey").alias("apdc_recnum"), F.col("o_totalprice").alias("cost"))
    return costs.combine([a, t(spark, sf, "events").select(F.col("event_id").alias("eddc_recnum"), F.col("value").alias("cost"))], ["apdc_recnum", "eddc_recnum"])


@R.add("CO16", f"WITH {EPISODES}, d AS ({_DEATHS}), f AS (SELECT e.* FROM episodes e LEFT JOIN d USING (subject) WHERE l_linenumber < 4 AND (died IS NULL OR \"end\" < died)), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY \"start\", l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY subject) AS n FROM f) SELECT subject, l_orderkey, l_linenumber FROM r WHERE i = {H('subject', 9)} % n")
def co16(spark, sf):
    return C.pick_index(episodes(spark, sf), "subject", ["start", "l_orderkey", "l_linenumber"], 9, F.col("l_linenumber") < 4, deaths(spark, sf), "end").select("subject", "l_orderkey", "l_linenumber")


@R.add("CO17", f"WITH {INDEX}, d AS ({_DEATHS}), f AS (SELECT subject, index_date, died, CAST(least(DATE '1998-08-01', coalesce(died, DATE '1998-08-01')) - index_date AS INT) AS followup_days FROM idx LEFT JOIN d USING (subject)) SELECT subject, index_date, followup_days, followup_days > 180 OR died IS NOT NULL AS include_180, followup_days > 365 OR died IS NOT NULL AS include_365, followup_days > 730 OR died IS NOT NULL AS include_730 FROM f")
def co17(spark, sf):
    return C.follow_up(index_dates(spark, sf), deaths(spark, sf), "subject", "index_date", "1998-08-01")


@R.add("CO18", f"WITH {HOR} SELECT hor.subject, horizon, count(o_orderkey) AS n_episodes FROM hor LEFT JOIN orders ON o_custkey = subject AND CAST(o_orderdate AS DATE) > index_date AND CAST(o_orderdate AS DATE) <= endpoint GROUP BY ALL")
def co18(spark, sf):
    out = labels.episode_count(orders_as_stays(spark, sf), index_dates(spark, sf), MONTHS)
    return out


def _labels(columns: str) -> str:
    """SQL of labels: for each horizon a branch with constant months; a subject's stays meet its index by equality alone. Days covered
    are summed row by row: each stay adds the days after the latest end so far."""
    index = f"SELECT o_custkey AS subject, CAST(o_orderdate AS DATE) AS index_date FROM (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE i = {H('o_custkey', 42)} % n"
    stays = "SELECT o_custkey AS subject, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS e, l_extendedprice AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    parts = []
    for name, months in MONTHS.items():
        till = f"CAST(index_date + INTERVAL {months} MONTH AS DATE)"
        met = f"SELECT x.subject, index_date, {till} AS till, s, e, cost FROM ({index}) x LEFT JOIN ({stays}) y ON x.subject = y.subject"
        kept = f"SELECT subject, till, s > index_date AND s <= till AS hit, s, e, cost FROM ({met})"
        ran = f"SELECT subject, till, hit, s, e, cost, max(CASE WHEN hit THEN least(e, till) END) OVER (PARTITION BY subject ORDER BY s, least(e, till) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ({kept})"
        parts.append(f"SELECT subject, '{name}' AS horizon, {columns} FROM ({ran}) GROUP BY subject")
    return " UNION ALL ".join(parts)


_DAYS = "coalesce(sum(CASE WHEN hit THEN greatest(0, least(e, till) - greatest(s - 1, coalesce(p, s - 1))) END), 0)"
_COST = "round(coalesce(sum(CASE WHEN NOT hit THEN NULL WHEN e <= till THEN cost ELSE cost * (till - s) / greatest(e - s, 1) END), 0), 5) AS cost"


@R.add("CO19", _labels(f"CAST(least({_DAYS}, 365) AS BIGINT) AS days"))
def co19(spark, sf):
    return labels.length_of_stay(episodes(spark, sf), index_dates(spark, sf), MONTHS, cap=365).withColumn("days", F.col("days").cast("long"))


@R.add("CO20", _labels(_COST))
def co20(spark, sf):
    return labels.cost(episodes(spark, sf), index_dates(spark, sf), MONTHS).withColumn("cost", F.round("cost", 5))


@R.add("CO21", _labels(f"count(CASE WHEN hit THEN 1 END) AS n_episodes, {_COST}, CAST({_DAYS} AS BIGINT) AS days"))
def co21(spark, sf):
    return labels.label_matrix(episodes(spark, sf), index_dates(spark, sf), MONTHS).withColumn("cost", F.round("cost", 5)).withColumn("days", F.col("days").cast("long"))


_PRIO = ["1-URGENT", "2-HIGH"]


@R.add("CO22", f"WITH {INDEX}, l AS (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders o JOIN idx ON subject = o_custkey WHERE CAST(o_orderdate AS DATE) <= index_date AND CAST(o_orderdate AS DATE) >= index_date - INTERVAL 24 MONTH) SELECT o_custkey, count(*) AS feature_num_episodes, max(CASE WHEN rn = 1 THEN o_orderstatus END) AS feature_last_o_orderstatus, round(sum(o_totalprice), 2) AS feature_cost, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"feature_1-URGENT\", count(*) FILTER (o_orderpriority = '2-HIGH') AS \"feature_2-HIGH\" FROM l GROUP BY 1")
def co22(spark, sf):
    o = t(spark, sf, "orders").withColumn("day", _day())
    idx = index_dates(spark, sf).withColumnRenamed("subject", "o_custkey")
    d = features.baseline(o, idx, "o_custkey", "day", "index_date", ["o_orderdate", "o_orderkey"], 24, ["o_orderstatus"], {"cost": F.col("o_totalprice")}, "o_orderpriority", _PRIO)
    return d.withColumn("feature_cost", F.round("feature_cost", 2))


def _codes(spark, sf):
    code = F.concat(F.substring("o_orderpriority", 1, 1), F.lit("."), F.col("o_orderstatus"))
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(code).alias("codes"), F.count("*").alias("n"))


@R.add("CO23", "SELECT o_custkey, count(*) AS n, " + ", ".join(f"count(*) FILTER (o_orderpriority LIKE '{i}%') AS dx_{i}" for i in range(1, 6)) + " FROM orders GROUP BY 1")
def co23(spark, sf):
    return features.code_prefix_counts(_codes(spark, sf), "o_custkey", "codes", "dx_").drop("codes")


@R.add("CO24", "SELECT o_custkey, bool_or(o_orderpriority LIKE '1%') AS urgent, bool_or(o_orderpriority LIKE '5%' AND o_orderstatus = 'F') AS low_final, count(*) > 10 AS many, count(*) <= 10 AS few FROM orders GROUP BY 1")
def co24(spark, sf):
    rules = {"urgent": features.matches_any("codes", r"^1"), "low_final": features.matches_any("codes", r"^5\.F$"), "many": F.col("n") > 10, "few": F.col("n") <= 10}
    return features.subgroups(_codes(spark, sf), rules).select("o_custkey", *rules)


@R.add("CO25", "SELECT o_custkey, CASE WHEN bool_or(o_orderpriority LIKE '1%' AND o_orderstatus = 'P') THEN 'a' WHEN bool_or(o_orderpriority LIKE '2%' AND o_orderstatus = 'P') THEN 'b' WHEN count(*) > 10 THEN 'c' ELSE 'other' END AS grp FROM orders GROUP BY 1")
def co25(spark, sf):
    rules = [("a", features.matches_any("codes", r"^1\.P")), ("b", features.matches_any("codes", r"^2\.P")), ("c", F.col("n") > 10)]
    return _codes(spark, sf).select("o_custkey", features.first_group(rules).alias("grp"))


@R.add("CO26", f"WITH {INDEX} SELECT subject AS subject_id, epoch_us(CAST(index_date AS TIMESTAMP)) + 100000 AS end_us, year(index_date) > 1995 AS label, true AS open_start FROM idx")
def co26(spark, sf):
    d = C.task_table(index_dates(spark, sf), "subject", "index_date", {"label": F.year("index_date") > 1995})
    return d.select("subject_id", F.unix_micros("end_time").alias("end_us"), "label", F.col("start_time").isNull().alias("open_start"))


@R.add("CO27", "WITH h AS (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_id), m AS (SELECT *, max(CASE WHEN value > 50 THEN ts END) OVER (PARTITION BY user_id) AS l FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM m WHERE ts < l) SELECT user_id AS subject_id, epoch_us(ts) + 60000000 AS end_us, value > 50 AS label FROM r WHERE rn = 1")
def co27(spark, sf):
    return C.last_but_one_task(history(spark, sf), "user_id", "ts", F.col("value") > 50).select("subject_id", F.unix_micros("end_time").alias("end_us"), "label")


_SENT = "'On ' || strftime(o_orderdate, '%d/%m/%Y') || ' an order of status ' || CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END || CASE WHEN o_totalprice > 200000 THEN ', large' ELSE '' END || '.'"


@R.add("CO28", f"SELECT o_custkey, 'Customer ' || o_custkey || ' ' || string_agg({_SENT}, ' ' ORDER BY o_orderdate, o_orderkey) AS text FROM orders GROUP BY 1")
def co28(spark, sf):
    head = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
    return features.history_text(t(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], features.order_sentence(), head)


@R.add("CO29", f"WITH {HOR}, d AS ({_DEATHS}), e AS (SELECT hor.subject, count(o_orderkey) AS n FROM hor LEFT JOIN orders ON o_custkey = subject AND CAST(o_orderdate AS DATE) > index_date AND CAST(o_orderdate AS DATE) <= endpoint WHERE horizon = '12mo' GROUP BY 1), g AS (SELECT n, 'all' AS grp FROM e UNION ALL SELECT n, 'died' FROM e JOIN d USING (subject)) SELECT grp AS \"group\", count(*) AS n, round(avg(n), 4) AS mean, quantile_cont(n, 0.5) AS median, max(n) AS max FROM g GROUP BY 1")
def co29(spark, sf):
    lab = labels.episode_count(orders_as_stays(spark, sf), index_dates(spark, sf), {"12mo": 12})
    return rounded(C.outcome_report(lab, "n_episodes", deaths(spark, sf), "subject"), "mean")


@R.add("CO30", "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def co30(spark, sf):
    return C.report(t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


def flagship(spark, sf):
    """Episode counts over three horizons after a random index date, validated against the subjects."""
    out = co18(spark, sf)
    P.validate_labels(index_dates(spark, sf), out.filter("horizon = '6mo'"), "subject")
    return out


