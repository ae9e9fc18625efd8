"""W01-W21 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators import intervals
from tidemark.operators import windows as W
from tidemark.queries import Registry, t
from tidemark.queries.aggregations import rounded
from tidemark.queries.filtering import EPISODES, episodes
from tidemark.queries.joining import H

R = Registry()


def history(spark, sf):
    """Events with unique times per user: the smallest event id of each."""
    e = t(spark, sf, "events").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))
    return e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


HISTORY = "h AS (SELECT user_id, ts, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, ts)"


@R.add("W01", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1")
def w01(spark, sf):
    return W.first_by(t(spark, sf, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber")


_W02 = """SELECT l_orderkey, l_linenumber, row_number() OVER w AS rn, max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) OVER w AS last_r, CAST(sum(l_quantity) OVER w AS BIGINT) AS q
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)"""


@R.add("W02", _W02)
def w02(spark, sf):
    return spark.sql(_W02.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t(spark, sf, "lineitem"))


@R.add("W03", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS stay FROM orders")
def w03(spark, sf):
    return W.number(t(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "stay").select("o_orderkey", F.col("stay").cast("long").alias("stay"))


@R.add("W04", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def w04(spark, sf):
    return W.first_by(t(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@R.add("W05", "SELECT o_orderkey, o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey) AS is_last, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def w05(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    return t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate") == F.max("o_orderdate").over(w)).alias("is_last"), F.count("*").over(w).alias("n"))


@R.add("W06", "SELECT o_orderkey, coalesce(last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM (SELECT *, nullif(o_orderstatus, 'F') AS v FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w06(spark, sf):
    o = t(spark, sf, "orders").withColumn("v", F.nullif("o_orderstatus", F.lit("F")))
    return W.fill(o, ["v"], "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "v")


@R.add("W07", f"WITH {EPISODES} SELECT l_orderkey, l_linenumber, subject, CAST(greatest(0, coalesce(\"start\" - lag(\"end\") OVER (PARTITION BY subject ORDER BY \"start\", \"end\", l_orderkey, l_linenumber), 0)) AS INT) AS gap FROM episodes")
def w07(spark, sf):
    return W.gap_days(episodes(spark, sf), "subject", "start", "end", ["start", "end", "l_orderkey", "l_linenumber"], "gap").select("l_orderkey", "l_linenumber", "subject", "gap")


@R.add("W08", "SELECT o_orderkey, count(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) - 1 AS n_before FROM orders")
def w08(spark, sf):
    return W.running_count(t(spark, sf, "orders"), "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"], "n_before").select("o_orderkey", "n_before")


@R.add("W09", "SELECT o_orderkey, epoch_us(o_orderdate) + 1000000 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) AS us FROM orders")
def w09(spark, sf):
    return W.spread_times(t(spark, sf, "orders"), "o_custkey", "o_orderdate", ["o_orderdate", "o_orderkey"]).select("o_orderkey", micros("o_orderdate").alias("us"))


@R.add("W10", f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE i = {H('o_custkey', 42)} % n")
def w10(spark, sf):
    return W.pick_random(t(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 42).select("o_custkey", "o_orderkey")


@R.add("W11", f"""WITH {EPISODES}, m AS (SELECT *, max("end") OVER (PARTITION BY subject ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM episodes),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR "start" > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT subject, CAST(island AS BIGINT) AS island, min("start") AS "start", max("end") AS "end", count(*) AS n FROM i GROUP BY subject, island""")
def w11(spark, sf):
    return intervals.merge(episodes(spark, sf), "subject", "start", "end")


_HIST = [("value", a) for a in ("has_values_count", "sum", "sum_sqd", "min", "max")]


def _flat(df, window, count=True):
    names = {f"{window}/value/{a}": a for _, a in _HIST}
    out = df.select("user_id", "event_id", *[F.col(f"`{k}`").alias(v) for k, v in names.items()], *([F.col(f"`{window}/event_id/count`").alias("n")] if count else []))
    return rounded(out, "sum", "sum_sqd")


def _sql(frame):
    return f"WITH {HISTORY} SELECT user_id, event_id, count(value) OVER w AS has_values_count, round(sum(value) OVER w, 4) AS \"sum\", round(sum(value * value) OVER w, 4) AS sum_sqd, min(value) OVER w AS \"min\", max(value) OVER w AS \"max\", count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY user_id ORDER BY {frame})"


def _window(name, window, frame):
    @R.add(name, _sql(frame))
    def query(spark, sf):
        return _flat(W.summarize_over_window(history(spark, sf), "user_id", "ts", [*_HIST, ("event_id", "count")], [window], ["event_id"]), window)


_window("W12", "FULL", "ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
_window("W13", "-FULL", "ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
_window("W14", "7d", "epoch_us(ts) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW")
_window("W15", "-7d", "epoch_us(ts) RANGE BETWEEN 1 FOLLOWING AND 604800000000 FOLLOWING")


@R.add("W16", f"WITH {HISTORY} SELECT user_id, event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 60e6, 4) AS time, round((lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) - epoch_us(ts)) / 60e6, 4) AS time_delta FROM h")
def w16(spark, sf):
    d = W.times_in_sequence(history(spark, sf), "user_id", "ts").select("user_id", "event_id", "time", F.nanvl("time_delta", F.lit(None).cast("double")).alias("time_delta"))
    return rounded(d, "time", "time_delta")


@R.add("W17", "WITH m AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) AS l FROM (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_id)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM m WHERE ts < l) SELECT user_id, event_id FROM r WHERE rn = 1")
def w17(spark, sf):
    e = W.first_by(t(spark, sf, "events"), ["user_id", "ts"], ["event_id"])
    return W.before_last(e, "user_id", "ts", F.col("event_type") == "purchase").select("user_id", "event_id")


@R.add("W18", "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY ALL) SELECT event_type, d, n, u, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(u) OVER w AS BIGINT) AS cum_u, round(sum(n) OVER w / sum(u) OVER w, 4) AS ratio FROM d WINDOW w AS (PARTITION BY event_type ORDER BY d ROWS UNBOUNDED PRECEDING)")
def w18(spark, sf):
    d = t(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    return rounded(W.cumulative_ratio(d, "event_type", "d", "n", "u"), "ratio")


@R.add("W19", "WITH s AS (SELECT p_brand, count(*) AS size FROM part GROUP BY 1) SELECT p_brand, size, CAST(sum(size) OVER w AS BIGINT) AS \"end\", CAST(sum(size) OVER w AS BIGINT) - size AS \"start\" FROM s WINDOW w AS (ORDER BY p_brand ROWS UNBOUNDED PRECEDING)")
def w19(spark, sf):
    return W.offsets(t(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("size")), "size", ["p_brand"])


@R.add("W20", "SELECT o_orderstatus, o_orderpriority, n, n = max(n) OVER (PARTITION BY o_orderstatus) AS is_best FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def w20(spark, sf):
    g = t(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return W.mark_best(g, ["o_orderstatus"], "n")


@R.add("W21", "SELECT o_orderkey, n FROM orders JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) USING (o_custkey)")
def w21(spark, sf):
    return W.distinct_over(t(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "n").select("o_orderkey", "n")
