"""IO01-IO18. Files are written into the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators import eventstream as ES
from tidemark.operators.joins import lookup
from tidemark.plans import datasets
from tidemark.queries import Registry, t
from tidemark.queries.windowing import HISTORY, history
from tidemark.sources import io
from tidemark.sources.schema import DatasetSchema, InputSchema
from tidemark.sources.shared import scratch

R = Registry()


@R.add("IO01", "SELECT r_regionkey, r_name FROM region")
def io01(spark, sf):
    return io.read_parquet(spark, f"{sf}/regio*.parquet").select("r_regionkey", "r_name")


@R.add("IO02", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders")
def io02(spark, sf):
    path = scratch(spark)
    t(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s")).write.option("header", True).csv(path)
    return io.read_csv(spark, path, schema="o_orderkey long, s string")


@R.add("IO03", "SELECT n_nationkey, n_name FROM nation")
def io03(spark, sf):
    """The 25 nations, given as rows of the session's memory."""
    nations = t(spark, sf, "nation").select("n_nationkey", "n_name")
    return io.from_rows(spark, [tuple(r) for r in nations.collect()], nations.schema)


@R.add("IO05", "SELECT c_custkey, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def io05(spark, sf):
    areas = lookup(t(spark, sf, "nation"), t(spark, sf, "region"), "n_regionkey", "r_regionkey", "r_name", "area")
    path = scratch(spark)
    io.write_csv(areas.select("n_nationkey", "area"), path)
    dim = io.read_csv(spark, path, schema="n_nationkey int, area string")
    return lookup(t(spark, sf, "customer"), dim, "c_nationkey", "n_nationkey", "area", "region").select("c_custkey", "region")


@R.add("IO06", "SELECT user_id AS subject_id, event_type, CAST(CAST(round(value, 2) AS FLOAT) AS DOUBLE) AS value, epoch_us(ts) AS us FROM events WHERE event_type IN ('click', 'purchase')")
def io06(spark, sf):
    e = t(spark, sf, "events").withColumn("value", F.round("value", 2).cast("string")).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    d = io.typed_load(e, {"event_type": "categorical", "value": "float", "ts": ("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")}, "user_id", {"event_type": ["click", "purchase"]})
    return d.select("subject_id", "event_type", F.col("value").cast("double").alias("value"), micros("ts").alias("us"))


@R.add("IO07", "SELECT 'quantity' AS name, 'float' AS kind, count(l_quantity) AS n FROM (SELECT DISTINCT l_orderkey, l_shipdate, l_quantity, l_returnflag FROM lineitem) UNION ALL SELECT 'flag', 'categorical', count(l_returnflag) FROM (SELECT DISTINCT l_orderkey, l_shipdate, l_quantity, l_returnflag FROM lineitem) UNION ALL SELECT 'kind', 'categorical', count(event_type) FROM (SELECT DISTINCT user_id, ts, event_type FROM events)")
def io07(spark, sf):
    """Two sources declared as one dataset, loaded by the declaration: its columns, their kinds and how often each has a value."""
    static = InputSchema(t(spark, sf, "customer"), "static", "c_custkey", {"c_mktsegment": "categorical"})
    a = InputSchema(t(spark, sf, "lineitem"), "range", "l_orderkey", {"l_quantity": ("quantity", "float")}, start_col="l_shipdate", end_col="l_shipdate", start_columns={"l_returnflag": ("flag", "categorical")}, event_type="STAY")
    b = InputSchema(t(spark, sf, "events"), "event", "user_id", {"event_type": ("kind", "categorical")}, ts_col="ts", event_type="COL:event_type")
    schema = DatasetSchema(static, [a, b])
    _, _, measurements = ES.extract(schema)
    n = [F.struct(F.lit(k).alias("name"), F.lit(v).alias("kind"), F.count(k).alias("n")) for k, v in schema.unified().items()]
    return measurements.agg(F.array(*n).alias("r")).select(F.inline("r"))


@R.add("IO09", "SELECT o_orderkey, o_totalprice FROM orders")
def io09(spark, sf):
    path = scratch(spark)
    io.write(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path)
    return io.read_parquet(spark, path)


@R.add("IO10", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def io10(spark, sf):
    path = scratch(spark)
    io.write(t(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), path, codec="zstd")
    return io.read_parquet(spark, path)


@R.add("IO11", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def io11(spark, sf):
    path = scratch(spark)
    io.write_csv(t(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), path)
    return io.read_csv(spark, path, schema="o_orderstatus string, n long")


@R.add("IO12", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def io12(spark, sf):
    path = scratch(spark)
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.lit(1).alias("tmp_x"))
    for g in range(2):
        io.write(o.filter(f"o_custkey % 2 = {g}"), f"{path}/group_{g}")
    return io.merge_groups(spark, [f"{path}/group_0", f"{path}/group_1"], f"{path}/all", "o_custkey", "^tmp_")


@R.add("IO13", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'held_out' ELSE 'train' END AS split FROM customer")
def io13(spark, sf):
    path = scratch(spark)
    c = t(spark, sf, "customer").select("c_custkey")
    subjects = c.withColumn("split", F.when(F.col("c_custkey") % 10 == 0, "held_out").otherwise("train"))
    io.write(io.with_shards(c, subjects, "c_custkey", 200), path, partition_by=["split", "shard"])
    return io.read_parquet(spark, path).select("c_custkey", "split")


@R.add("IO14", "SELECT o_orderkey, o_custkey FROM orders")
def io14(spark, sf):
    path = scratch(spark)
    io.save_tables(path, {"events": t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "subjects": t(spark, sf, "customer")}, {"name": "orders"})
    return io.load_tables(spark, path)[0]["events"]


@R.add("IO14_fitted", """WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag AS k, l_quantity AS q FROM lineitem), th AS (SELECT k, avg(q) - 1.5 * stddev_samp(q) AS lo, avg(q) + 1.5 * stddev_samp(q) AS hi FROM v GROUP BY 1),
 ms AS (SELECT k, avg(q) AS mean, stddev_samp(q) AS std FROM v JOIN th USING (k) WHERE q > lo AND q < hi GROUP BY 1)
 SELECT l_orderkey, l_linenumber, k, CASE WHEN q > lo AND q < hi THEN round((q - mean) / std, 6) END AS q FROM v JOIN th USING (k) JOIN ms USING (k)""")
def io14_fitted(spark, sf):
    """Fit, save, load in another object, transform: the same rows as fitting and transforming at once."""
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("q"))
    measure = ES.Measurement("k", modality="multivariate_regression", values_column="q")
    path = scratch(spark)
    datasets.Dataset({"subjects": t(spark, sf, "customer")}, [measure]).fit(rows, outlier_c=1.5).save(path)
    out = datasets.load(spark, path).transform(rows)
    return out.select("l_orderkey", "l_linenumber", "k", F.round(F.nanvl("q", F.lit(None).cast("double")), 6).alias("q"))


@R.add("IO15", "SELECT 'a/one' AS task, count(*) AS n FROM labels UNION ALL SELECT 'two', count(*) FROM labels WHERE toxic = 1")
def io15(spark, sf):
    path = scratch(spark)
    lab = t(spark, sf, "labels")
    for name, d in (("a/one", lab), ("two", lab.filter("toxic = 1"))):
        d.coalesce(1).write.parquet(f"{path}/{name}")
    found = io.task_collection(spark, path)
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(k.rpartition("/")[0]).alias("task"), "n") for k, d in found.items()]
    return parts[0].unionByName(parts[1])


@R.add("IO16", "SELECT o_orderstatus AS chunk, count(*) AS n FROM orders GROUP BY 1")
def io16(spark, sf):
    path = scratch(spark)
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("chunk"))
    io.write_missing(o.filter("chunk = 'F'"), path, "chunk", {"v": 1})
    return io.write_missing(o, path, "chunk", {"v": 1}).groupBy("chunk").agg(F.count("*").alias("n"))


@R.add("IO17", f"WITH {HISTORY}, d AS (SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS us FROM h), b AS (SELECT DISTINCT user_id FROM d WHERE us < 600000000) SELECT user_id, event_id FROM h WHERE user_id NOT IN (SELECT user_id FROM b)")
def io17(spark, sf):
    from pyspark.sql import Window

    d = history(spark, sf).withColumn("us", F.lead(micros("ts")).over(Window.partitionBy("user_id").orderBy("ts")) - micros("ts"))
    return io.quarantine(d, "user_id", F.col("us") < 600_000_000, scratch(spark))[0].select("user_id", "event_id")


@R.add("IO18", "SELECT o_orderpriority AS value, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def io18(spark, sf):
    from tidemark.functions.encodings import dense_index

    path = scratch(spark)
    io.write(dense_index(t(spark, sf, "orders"), "o_orderpriority").select(F.col("o_orderpriority").alias("value"), F.col("idx").alias("code")), path)
    return io.read_parquet(spark, path)
