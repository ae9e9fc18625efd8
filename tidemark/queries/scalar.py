"""SF01-SF27 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import encodings as E
from tidemark.functions import scalars as S
from tidemark.functions.quantiles import wide
from tidemark.queries import Registry, t
from tidemark.queries.aggregations import rounded

R = Registry()


def day():
    return F.col("o_orderdate").cast("date")


def _o(spark, sf):
    return t(spark, sf, "orders")


@R.add("SF01", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders")
def sf01(spark, sf):
    text = F.when(F.col("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("99/99/9999")
    return _o(spark, sf).select("o_orderkey", S.parse_date(text).alias("d"), S.parse_timestamp(F.date_format("o_orderdate", "MMMyyyy"), "MMMyyyy").cast("date").alias("m"))


@R.add("SF02", "SELECT o_orderkey, epoch_us(date_trunc('day', o_orderdate)) + 1000000 * greatest(0, least(86399, coalesce(nullif(o_orderkey * 13 % 90001, 0), 0))) AS us FROM orders")
def sf02(spark, sf):
    s = F.nullif(F.col("o_orderkey") * 13 % 90_001, F.lit(0))
    return _o(spark, sf).select("o_orderkey", S.micros(S.date_plus_seconds(day(), s)).alias("us"))


@R.add("SF03", "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(hour(ts) AS INT) AS h FROM events")
def sf03(spark, sf):
    return t(spark, sf, "events").select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.hour("ts").alias("h"))


@R.add("SF04", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INT) AS d, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' + 1 AS INT) AS d1 FROM orders")
def sf04(spark, sf):
    start = F.lit("1995-01-01")
    return _o(spark, sf).select("o_orderkey", S.days_between(start, day()).alias("d"), S.days_between(start, day(), inclusive=True).alias("d1"))


@R.add("SF05", "SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) / 60e6, 4) AS minutes, round((epoch_us(ts) - epoch_us(TIMESTAMP '1990-01-01')) / 31557600e6, 6) AS years FROM events")
def sf05(spark, sf):
    a, b = F.lit("2020-01-01").cast("timestamp"), F.lit("1990-01-01").cast("timestamp")
    return t(spark, sf, "events").select("event_id", F.round(S.minutes_between(a, "ts"), 4).alias("minutes"), F.round(S.years_between(b, "ts"), 6).alias("years"))


@R.add("SF06", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 6 MONTH AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) - INTERVAL 24 MONTH AS DATE) AS b FROM orders")
def sf06(spark, sf):
    return _o(spark, sf).select("o_orderkey", F.add_months(day(), 6).alias("a"), F.add_months(day(), -24).alias("b"))


@R.add("SF07", "SELECT event_id, epoch_us(ts) + 100000 AS a, epoch_us(ts) - 60000000 AS b FROM events")
def sf07(spark, sf):
    return t(spark, sf, "events").select("event_id", S.micros(S.shift_micros("ts", 100_000)).alias("a"), S.micros(S.shift_micros("ts", -60_000_000)).alias("b"))


@R.add("SF08", "SELECT l_orderkey, l_linenumber, least(l_discount, l_tax, CASE WHEN l_linenumber = 1 THEN 0.01 END) AS low FROM lineitem")
def sf08(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.earliest("l_discount", "l_tax", F.when(F.col("l_linenumber") == 1, 0.01)).alias("low"))


@R.add("SF09", "SELECT l_orderkey, l_linenumber, CAST(least(l_shipdate, CASE WHEN l_linenumber > 2 THEN o_orderdate END) AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def sf09(spark, sf):
    li, o = t(spark, sf, "lineitem"), _o(spark, sf)
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", S.earliest("l_shipdate", F.when(F.col("l_linenumber") > 2, F.col("o_orderdate"))).cast("date").alias("d"))


@R.add("SF10", "SELECT o_orderkey, greatest(1000, least(100000, o_totalprice)) AS c, CAST(floor(o_totalprice / 10000) * 10 AS BIGINT) AS decade, round(pow(o_totalprice, 0.5), 4) AS p, round(ln(o_totalprice), 4) AS l FROM orders")
def sf10(spark, sf):
    p = F.col("o_totalprice")
    return _o(spark, sf).select("o_orderkey", S.clip(p, 1000, 100_000).cast("double").alias("c"), (F.floor(p / 10_000) * 10).alias("decade"), F.round(F.pow(p, 0.5), 4).alias("p"), F.round(F.ln(p), 4).alias("l"))


@R.add("SF11", "SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'xs' WHEN p_size <= 15 THEN 's' WHEN p_size <= 30 THEN 'm' ELSE 'l' END AS size, CAST((p_size > 5)::INT + (p_size > 15)::INT + (p_size > 30)::INT AS INT) AS bin FROM part")
def sf11(spark, sf):
    return t(spark, sf, "part").select("p_partkey", S.cut_right("p_size", [5, 15, 30], ["xs", "s", "m", "l"]).alias("size"), S.cut_right("p_size", [5, 15, 30]).alias("bin"))


@R.add("SF12", "SELECT p_partkey, p_size >= 5 AND p_size <= 10 AS b, p_size >= 5 AND p_size < 10 AS l, p_size > 5 AND p_size <= 10 AS r, p_size > 5 AND p_size < 10 AS n FROM part")
def sf12(spark, sf):
    return t(spark, sf, "part").select("p_partkey", *[S.between("p_size", 5, 10, k).alias(k[0]) for k in ("both", "left", "right", "none")])


@R.add("SF13", "SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN -1 ELSE value END AS v, coalesce(event_id % 5 = 0, false) AS was_nan FROM events")
def sf13(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 3 != 0, F.col("value"))
    return t(spark, sf, "events").select("event_id", S.fill(raw, -1.0).alias("v"), F.coalesce(F.isnan(raw), F.lit(False)).alias("was_nan"))


@R.add("SF14", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT)::VARCHAR AS whole, regexp_matches(o_orderpriority, '^[12]') AS urgent, split_part(o_orderpriority, '-', 2) AS name FROM orders")
def sf14(spark, sf):
    return _o(spark, sf).select("o_orderkey", S.before_dot(F.col("o_totalprice").cast("decimal(20,2)").cast("string")).alias("whole"), F.col("o_orderpriority").rlike("^[12]").alias("urgent"), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("name"))


@R.add("SF16", "SELECT l_orderkey, l_linenumber, l_returnflag || '__EQ_' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS k FROM lineitem")
def sf16(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.key_value_name("l_returnflag", F.col("l_quantity").cast("long")).alias("k"))


@R.add("SF17", "SELECT user_id, string_agg(event_type, '&' ORDER BY event_type) AS types FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def sf17(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(S.join_sorted(F.collect_set("event_type")).alias("types"))


@R.add("SF18", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority WHEN o_orderstatus = o_orderpriority THEN o_orderstatus ELSE o_orderstatus || ',' || o_orderpriority END AS codes FROM orders")
def sf18(spark, sf):
    blank = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    return _o(spark, sf).select("o_orderkey", F.array_join(S.row_list(blank, "o_orderpriority", F.lit(None).cast("string"), blank), ",").alias("codes"))


@R.add("SF19", "SELECT o_custkey, CAST(count(*) AS INT) AS n, bool_or(o_orderpriority LIKE '1%') AS any_urgent, CAST(count(*) FILTER (o_totalprice > 100000) AS INT) AS n_big, min(o_totalprice) AS low FROM orders GROUP BY 1")
def sf19(spark, sf):
    g = _o(spark, sf).groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"), F.collect_list("o_totalprice").alias("v"))
    return g.select("o_custkey", F.size("p").alias("n"), F.exists("p", lambda x: x.rlike("^1")).alias("any_urgent"), F.size(F.filter("v", lambda x: x > 100_000)).alias("n_big"), F.array_min("v").alias("low"))


@R.add("SF20", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def sf20(spark, sf):
    g = _o(spark, sf).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("s"))
    lists = g.select("o_custkey", F.transform("s", lambda x: x["o_orderkey"]).alias("o_orderkey"), F.transform("s", lambda x: x["o_totalprice"]).alias("o_totalprice"))
    return lists.select("o_custkey", F.inline(F.arrays_zip("o_orderkey", "o_totalprice")))


@R.add("SF21", "SELECT o_orderkey, o_orderstatus AS a, o_totalprice AS b FROM orders")
def sf21(spark, sf):
    return _o(spark, sf).select("o_orderkey", F.struct(F.col("o_orderstatus").alias("a"), F.col("o_totalprice").alias("b")).alias("s")).select("o_orderkey", "s.*")


@R.add("SF22", "SELECT count(*) AS n, count(*) AS n_ids FROM (SELECT DISTINCT user_id, ts FROM events)")
def sf22(spark, sf):
    d = t(spark, sf, "events").select("user_id", "ts").distinct().select(S.surrogate_id("user_id", S.micros("ts")).alias("id"))
    return d.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@R.add("SF23", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 2 OR l_quantity > 48 THEN NULL WHEN l_quantity < 5 THEN 5 WHEN l_quantity > 40 THEN 40 ELSE l_quantity END AS v FROM lineitem")
def sf23(spark, sf):
    v = S.drop_or_censor("l_quantity", 2.0, True, 48.0, False, 5.0, 40.0)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.nan_to_null(v).alias("v"))


@R.add("SF24", "WITH r AS (SELECT o_orderkey, o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders), c AS (SELECT min(v) AS cut FROM r WHERE k = CAST(round((n - 1) * 0.9) AS BIGINT)) SELECT o_orderkey, v > cut AS label, v AS label_raw FROM r, c")
def sf24(spark, sf):
    return E.threshold_label(_o(spark, sf).select("o_orderkey", F.col("o_totalprice").alias("label")), "label", high=True)


@R.add("SF24_quantiles", "WITH r AS (SELECT o_orderstatus, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderstatus, min(v) FILTER (k = CAST(round((n - 1) * 0.25) AS BIGINT)) AS nearest, round(quantile_cont(v, 0.25), 4) AS linear, quantile_disc(v, 0.25) AS lower FROM r GROUP BY 1")
def sf24_quantiles(spark, sf):
    return rounded(wide(_o(spark, sf), {k: ("o_totalprice", 0.25, k) for k in ("nearest", "linear", "lower")}, ["o_orderstatus"]), "linear")


@R.add("SF25", "SELECT o_orderkey, i AS code FROM orders LEFT JOIN (SELECT s, CAST(row_number() OVER (ORDER BY s) - 1 AS INT) AS i FROM (SELECT DISTINCT nullif(o_orderpriority, '5-LOW') AS s FROM orders) WHERE s IS NOT NULL) ON s = o_orderpriority")
def sf25(spark, sf):
    return E.to_int_index(_o(spark, sf).select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("code")), "code")


@R.add("SF26", "SELECT o_orderstatus, count(*) AS n, CAST(round_even(0.1 * count(*), 0) AS BIGINT) AS cutoff FROM orders GROUP BY 1")
def sf26(spark, sf):
    return _o(spark, sf).groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("cutoff", S.count_or_share(F.col("n"), 0.1))


@R.add("SF27", "SELECT o_orderkey, 'On ' || strftime(o_orderdate, '%d/%m/%Y') || ' an order of status ' || CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END || CASE WHEN o_totalprice > 200000 THEN ', large' ELSE '' END || '.' AS sentence FROM orders")
def sf27(spark, sf):
    from tidemark.plans.features import order_sentence

    return _o(spark, sf).select("o_orderkey", order_sentence().alias("sentence"))
