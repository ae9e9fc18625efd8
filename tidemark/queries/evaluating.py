"""ML01-ML20 and the extension points, on ``labels`` with a score that is a function of the document's id."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import eventstream as ES
from tidemark.plans import modelling as M
from tidemark.queries import Registry, t
from tidemark.queries.aggregations import rounded
from tidemark.queries.joining import H
from tidemark.queries.sources import scratch

R = Registry()
_P = "CAST((doc_id * 37 % 101 + toxic * 30) AS DOUBLE) / 131"
SCORED = f"sc AS (SELECT doc_id, toxic AS y, {_P} AS p, doc_id % 3 AS fold FROM labels)"


def scored(spark, sf):
    p = (F.col("doc_id") * 37 % 101 + F.col("toxic") * 30).cast("double") / 131
    return t(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"), p.alias("p"), (F.col("doc_id") % 3).alias("fold"))


def _auc_sql(rows: str, by: str) -> str:
    """Rank sum with average ranks, per group."""
    return f"(SELECT {by}, (sum(CASE WHEN y = 1 THEN r END) - max(np) * (max(np) + 1) / 2.0) / nullif(max(np) * max(nn), 0) AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS r, sum(y) OVER (PARTITION BY {by}) AS np, sum(1 - y) OVER (PARTITION BY {by}) AS nn FROM {rows}) GROUP BY {by})"


def _curve(rows: str, by: str) -> str:
    return f"(SELECT {by}, p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {by}) AS np, sum(neg) OVER (PARTITION BY {by}) AS nn, lead(p) OVER w AS low FROM (SELECT {by}, p, sum(y) AS pos, sum(1 - y) AS neg FROM {rows} GROUP BY {by}, p) WINDOW w AS (PARTITION BY {by} ORDER BY p DESC))"


def _ap_sql(rows: str, by: str) -> str:
    return f"(SELECT {by}, sum(pos * tp / (tp + fp)) / nullif(max(np), 0) AS average_precision FROM {_curve(rows, by)} GROUP BY {by})"


@R.add("ML01", f"SELECT doc_id, CAST((row_number() OVER (PARTITION BY toxic ORDER BY {H('doc_id', 5)}, doc_id) - 1) % 5 AS INT) AS fold FROM labels")
def ml01(spark, sf):
    return M.folds(t(spark, sf, "labels"), "doc_id", "toxic", 5, 5)


def _features(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    n = F.length("text").cast("double")
    cols = {"size": F.log1p(n), "upper": F.length(F.regexp_replace("text", "[^A-Z]", "")) / (n + 1), "marks": F.length(F.regexp_replace("text", "[^!?#%&*$]", "")) / (n + 1)}
    rows = d.select("doc_id", F.col("quality").alias("label"), *[c.alias(k) for k, c in cols.items()])
    return rows, VectorAssembler(inputCols=list(cols), outputCol="x").transform(rows).select("doc_id", "x", "label"), list(cols)


@R.add("ML02")
def ml02(spark, sf):
    _, v, _ = _features(spark, sf)
    use = {k: m for k, m in M.models().items() if k in ("logistic", "prior")}
    return M.cross_validate(v, "doc_id", "x", "label", M.folds(v, "doc_id", "label", 3, 1), use, scratch(spark))


@R.add("ML03")
def ml03(spark, sf):
    from pyspark.ml.functions import vector_to_array

    _, v, _ = _features(spark, sf)
    v = v.withColumnRenamed("x", "features").withColumn("label", F.col("label").cast("double"))
    out = None
    for name in ("elastic_net", "boosted", "forest"):
        part = M.models()[name].fit(v).transform(v).select("doc_id", F.lit(name).alias("model"), F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


@R.add("ML04", "WITH b AS (SELECT label AS y, least(CAST(floor((embedding[1] - min(embedding[1]) OVER ()) / (max(embedding[1]) OVER () - min(embedding[1]) OVER ()) * 10) AS INT), 9) AS x FROM embeddings), g AS (SELECT x, y, count(*) AS c FROM b GROUP BY ALL), w AS (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY x) AS nx, sum(c) OVER (PARTITION BY y) AS ny FROM g) SELECT 'e0' AS feature, round(sum(c / n * ln(c * n / (nx * ny))), 4) AS mi FROM w")
def ml04(spark, sf):
    e = t(spark, sf, "embeddings").select("label", F.get("embedding", F.lit(0)).alias("e0"))
    return rounded(M.mutual_information(M.constant_impute(e, ["e0"]).drop("e0_missing"), ["e0"], "label"), "mi")


@R.add("ML04_nearest", "WITH e AS (SELECT vec_id, embedding, label FROM embeddings), p AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS r FROM e a, e b WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0) SELECT vec_id, round(avg(label), 4) AS y FROM p WHERE r <= 5 GROUP BY 1 UNION ALL SELECT vec_id, label FROM e WHERE vec_id % 50 <> 0")
def ml04_nearest(spark, sf):
    """The label is taken away where the identifier is divisible by 50 and filled from the five nearest rows."""
    e = t(spark, sf, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 50 != 0, F.col("label")).cast("double").alias("y"))
    return M.knn_impute(e, "vec_id", "y", "embedding").select("vec_id", F.round("y", 4).alias("y"))


@R.add("ML04_factors")
def ml04_factors(spark, sf):
    """Factors of customers from the counts of their priorities; iterative, values are checked in tests."""
    o = t(spark, sf, "orders").groupBy(F.col("o_custkey").cast("int").alias("subject"), F.substring("o_orderpriority", 1, 1).cast("int").alias("item")).agg(F.count("*").cast("float").alias("n"))
    return M.factorise(o, "subject", "item", "n", rank=2)


@R.add("ML05")
def ml05(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows, _, cols = _features(spark, sf)
    rows = rows.withColumn("label", F.col("label").cast("double"))
    pipe = M.stages([("impute", {}), ("standard", {}), ("pca", {"k": 2}), ("select", {"k": 2}), ("logistic", {})], cols)
    return pipe.fit(rows).transform(rows).select("doc_id", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


@R.add("ML05_stages")
def ml05_stages(spark, sf):
    """How many letters come to one capital and to one mark, which texts without them lack, filled from neighbours; factors; boosted trees."""
    from pyspark.ml.functions import vector_to_array

    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    count = lambda kind: F.regexp_count("text", F.lit(kind)).cast("double")
    cols = {"size": F.log1p(F.length("text").cast("double")), "upper": F.try_divide(count("[A-Za-z]"), count("[A-Z]")), "marks": F.try_divide(count("[A-Za-z]"), count("[!?#%&*$]"))}
    rows = d.select("doc_id", F.col("quality").cast("double").alias("label"), *[c.alias(k) for k, c in cols.items()])
    pipe = M.stages([("neighbours", {"key": "doc_id"}), ("minmax", {}), ("factors", {"k": 2}), ("boosted", {})], list(cols))
    return pipe.fit(rows).transform(rows).select("doc_id", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


@R.add("ML06", f"WITH {SCORED} SELECT fold, round(roc_auc, 6) AS roc_auc FROM {_auc_sql('sc', 'fold')}")
def ml06(spark, sf):
    return E.roc_auc(scored(spark, sf), "y", "p", ["fold"]).withColumn("roc_auc", F.round("roc_auc", 6))


@R.add("ML07", f"WITH {SCORED} SELECT fold, round(average_precision, 6) AS average_precision FROM {_ap_sql('sc', 'fold')}")
def ml07(spark, sf):
    return E.average_precision(scored(spark, sf), "y", "p", ["fold"]).withColumn("average_precision", F.round("average_precision", 6))


_BIN = "avg(CAST((p > 0.5) = (y = 1) AS INT)) AS accuracy, count(*) FILTER (p > 0.5 AND y = 1) / nullif(count(*) FILTER (y = 1), 0) AS recall, count(*) FILTER (p <= 0.5 AND y = 0) / nullif(count(*) FILTER (y = 0), 0) AS specificity"


@R.add("ML08", f"WITH {SCORED}, m AS (SELECT fold, {_BIN} FROM sc GROUP BY 1) SELECT fold, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round(specificity, 6) AS specificity FROM m")
def ml08(spark, sf):
    return scored(spark, sf).groupBy("fold").agg(*[F.round(c, 6).alias(k) for k, c in E.confusion(0.5).items()])


_LOSS = "avg(pow(p - y, 2)) AS brier, -avg(CASE WHEN y = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, p))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, p))) END) AS log_loss"


@R.add("ML09", f"WITH {SCORED}, m AS (SELECT fold, {_LOSS} FROM sc GROUP BY 1) SELECT fold, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss FROM m")
def ml09(spark, sf):
    return scored(spark, sf).groupBy("fold").agg(F.round(E.brier(), 6).alias("brier"), F.round(E.log_loss(), 6).alias("log_loss"))


@R.add("ML10", f"WITH {SCORED}, b AS (SELECT fold, least(floor(p * 10), 9) AS b, sum(y) AS o, sum(p) AS e FROM sc GROUP BY ALL) SELECT fold, round(sum(pow(o - e, 2) / nullif(e, 0)), 4) AS chi_square, CAST(count(*) - 1 AS INT) AS dof FROM b GROUP BY 1")
def ml10(spark, sf):
    d = E.with_p_value(E.d_calibration(scored(spark, sf), "y", "p", 10, ["fold"]))
    return rounded(d, "chi_square").select("fold", "chi_square", "dof")


@R.add("ML11", f"WITH {SCORED}, c AS (SELECT fold, p AS t, tp / (tp + fp) AS pr, tp / nullif(np, 0) AS re FROM {_curve('sc', 'fold')} UNION ALL SELECT DISTINCT fold, 'inf'::DOUBLE, 1.0, 0.0 FROM sc) SELECT fold, round(arg_min(pr, (round(abs(re - 0.8), 12), t)), 6) AS precision_at_recall FROM c GROUP BY 1")
def ml11(spark, sf):
    return E.precision_at_recall(scored(spark, sf), "y", "p", 0.8, ["fold"]).withColumn("precision_at_recall", F.round("precision_at_recall", 6))


@R.add("ML12", f"WITH {SCORED}, c AS (SELECT *, coalesce((p + low) / 2, p) AS t FROM {_curve('sc', 'fold')} WHERE (nn - fp) / nn >= 0.9) SELECT fold, round(max(tp / np), 6) AS recall_at_specificity, round(arg_max(t, (tp / np, t)), 6) AS threshold FROM c GROUP BY 1")
def ml12(spark, sf):
    d = E.recall_at_specificity(scored(spark, sf), "y", "p", 0.9, ["fold"])
    return d.withColumn("recall_at_specificity", F.round("recall_at_specificity", 6)).withColumn("threshold", F.round("threshold", 6))


def _bundle(rows: str, by: str) -> str:
    return f"""SELECT m.{by}, n, n_pos, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision
 FROM (SELECT {by}, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, {_BIN}, {_LOSS} FROM {rows} GROUP BY 1) m JOIN {_auc_sql(rows, by)} a ON a.{by} = m.{by} JOIN {_ap_sql(rows, by)} q ON q.{by} = m.{by}"""


_NAMES = ("accuracy", "recall", "specificity", "brier", "log_loss", "roc_auc", "average_precision")


def _show(d, by):
    return d.select(by, "n", "n_pos", *[F.round(c, 6).alias(c) for c in _NAMES])


@R.add("ML13", f"WITH {SCORED} {_bundle('sc', 'fold')}")
def ml13(spark, sf):
    return _show(E.metrics(scored(spark, sf), "y", "p", ["fold"]), "fold")


_SUB = f"{SCORED}, su AS (SELECT y, p, 'all' AS subgroup FROM sc UNION ALL SELECT y, p, 'even' FROM sc WHERE doc_id % 2 = 0 UNION ALL SELECT y, p, 'low' FROM sc WHERE doc_id < 500)"


@R.add("ML14", f"WITH {_SUB} {_bundle('su', 'subgroup')}")
def ml14(spark, sf):
    rows = E.by_subgroup(scored(spark, sf), {"even": F.col("doc_id") % 2 == 0, "low": F.col("doc_id") < 500}, ["y", "p"])
    return _show(E.metrics(rows, "y", "p", ["subgroup"]), "subgroup")


_MC = "mc AS (SELECT vec_id, CAST(label % 3 AS INT) AS label, [(vec_id % 7 + CASE WHEN label % 3 = 0 THEN 6 ELSE 1 END) / 20.0, (vec_id % 5 + CASE WHEN label % 3 = 1 THEN 6 ELSE 1 END) / 20.0, (vec_id % 3 + CASE WHEN label % 3 = 2 THEN 6 ELSE 1 END) / 20.0] AS probs FROM embeddings)"


def _multi(spark, sf):
    y = (F.col("label") % 3).cast("int")
    p = F.array(*[((F.col("vec_id") % m) + F.when(y == k, 6).otherwise(1)) / 20.0 for k, m in enumerate((7, 5, 3))])
    return t(spark, sf, "embeddings").select("vec_id", y.alias("label"), p.alias("probs"))


_OVR = f"{_MC}, ov AS (SELECT k AS c, CAST(label = k AS INT) AS y, CAST(probs[k + 1] AS DOUBLE) AS p FROM mc, range(3) t(k))"


@R.add("ML15", f"WITH {_OVR}, g AS (SELECT a.c, roc_auc, average_precision, k FROM {_auc_sql('ov', 'c')} a JOIN {_ap_sql('ov', 'c')} b ON a.c = b.c JOIN (SELECT c, sum(y) AS k FROM ov GROUP BY 1) s ON s.c = a.c) SELECT (SELECT count(*) FROM mc) AS n, (SELECT round(avg(CAST(list_position(probs, list_max(probs)) = label + 1 AS INT)), 6) FROM mc) AS accuracy, (SELECT round(-avg(ln(CAST(probs[label + 1] AS DOUBLE))), 6) FROM mc) AS nll, round(avg(roc_auc), 6) AS auroc_macro, round(sum(roc_auc * k) / sum(k), 6) AS auroc_weighted, round(avg(average_precision), 6) AS auprc_macro FROM g")
def ml15(spark, sf):
    d = E.multiclass(_multi(spark, sf), "label", "probs", [0, 1, 2])
    return d.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "nll", "auroc_macro", "auroc_weighted", "auprc_macro")])


@R.add("ML15_ovo", f"WITH {_MC}, pr AS (SELECT a.k * 10 + b.k AS c, CAST(label = a.k AS INT) AS y, CAST(probs[a.k + 1] AS DOUBLE) AS p FROM mc, range(3) a(k), range(3) b(k) WHERE a.k <> b.k AND label IN (a.k, b.k)) SELECT round(avg(roc_auc), 6) AS auroc_ovo FROM {_auc_sql('pr', 'c')}")
def ml15_ovo(spark, sf):
    return E.one_vs_one_auc(_multi(spark, sf), "label", "probs", [0, 1, 2]).select(F.round("auroc_ovo", 6).alias("auroc_ovo"))


_ML = f"{_MC}, ml AS (SELECT k AS c, CASE WHEN k = 0 THEN vec_id % 2 ELSE CAST(label = k AS INT) END AS y, CAST(probs[k + 1] AS DOUBLE) AS p FROM mc, range(3) t(k)), al AS (SELECT 0 AS c, y, p FROM ml)"


@R.add("ML16", f"WITH {_ML}, g AS (SELECT a.c, roc_auc, average_precision, k FROM {_auc_sql('ml', 'c')} a JOIN {_ap_sql('ml', 'c')} b ON a.c = b.c JOIN (SELECT c, sum(y) AS k FROM ml GROUP BY 1) s ON s.c = a.c) SELECT (SELECT round(avg(CAST((p > 0.5) = (y = 1) AS INT)), 6) FROM ml) AS accuracy, round(avg(roc_auc), 6) AS auroc_macro, round(sum(roc_auc * k) / sum(k), 6) AS auroc_weighted, round(avg(average_precision), 6) AS auprc_macro, (SELECT round(max(roc_auc), 6) FROM {_auc_sql('al', 'c')}) AS auroc_micro, (SELECT round(max(average_precision), 6) FROM {_ap_sql('al', 'c')}) AS auprc_micro FROM g")
def ml16(spark, sf):
    d = _multi(spark, sf).withColumn("labels", F.array((F.col("vec_id") % 2).cast("int"), (F.col("label") == 1).cast("int"), (F.col("label") == 2).cast("int")))
    return E.multilabel(d, "labels", "probs", 3).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "auroc_macro", "auroc_weighted", "auprc_macro", "auroc_micro", "auprc_micro")])


@R.add("ML17", "WITH d AS (SELECT l_returnflag, l_quantity AS y, l_quantity * 0.9 + l_linenumber AS p FROM lineitem) SELECT l_returnflag, round(avg(pow(p - y, 2)), 6) AS mse, round(avg(pow(ln(1 + p) - ln(1 + y), 2)), 6) AS msle, round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance FROM d GROUP BY 1")
def ml17(spark, sf):
    d = t(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("y"), (F.col("l_quantity") * 0.9 + F.col("l_linenumber")).alias("p"))
    return E.regression(d, "y", "p", ["l_returnflag"]).select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("mse", "msle", "explained_variance")])


@R.add("ML18", f"WITH {SCORED}, q AS (SELECT list_distinct(quantile_cont(p, [0.2, 0.4, 0.6, 0.8])) AS e FROM sc), u AS (SELECT 'uniform' AS strategy, CAST(least(floor(p * 5), 4) AS INT) AS bin, y, p FROM sc UNION ALL SELECT 'quantile', CAST(len(list_filter(e, lambda x: x <= p)) AS INT), y, p FROM sc, q) SELECT strategy, bin, count(*) AS n, round(avg(p), 6) AS mean_pred, round(avg(y), 6) AS frac_pos FROM u GROUP BY ALL")
def ml18(spark, sf):
    parts = [E.calibration_curve(scored(spark, sf), "y", "p", 5, s).withColumn("strategy", F.lit(s)) for s in ("uniform", "quantile")]
    return parts[0].unionByName(parts[1]).withColumn("mean_pred", F.round("mean_pred", 6)).withColumn("frac_pos", F.round("frac_pos", 6))


@R.add("ML18_bootstrap")
def ml18_bootstrap(spark, sf):
    return E.bootstrap_band(scored(spark, sf), "y", "p", 5, 50)


@R.add("ML19", f"WITH {SCORED} SELECT 'a' AS model, CAST(fold AS INT) AS fold, count(*) AS n, round(avg(p), 6) AS mean_p FROM sc GROUP BY 2")
def ml19(spark, sf):
    path = scratch(spark)
    scored(spark, sf).withColumn("model", F.lit("a")).write.partitionBy("model", "fold").parquet(path)
    return E.collect_predictions(spark, path).groupBy("model", F.col("fold").cast("int").alias("fold")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


@R.add("ML20")
def ml20(spark, sf):
    return M.project(t(spark, sf, "embeddings"), "vec_id", "embedding").join(t(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")


@R.add("UD01", "SELECT doc_id, md5(lang || ': ' || nfc_normalize(text)) AS text_md5 FROM documents")
def ud01(spark, sf):
    @F.pandas_udf("string")
    def titled(row: pd.DataFrame) -> pd.Series:
        """Unicode composition, which no built-in function does."""
        return row["lang"] + ": " + row["text"].map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    d = t(spark, sf, "documents")
    return d.select("doc_id", F.md5(titled(F.struct("lang", "text"))).alias("text_md5"))


@R.add("UD02", "SELECT user_id, string_agg(event_type, ' > ' ORDER BY ts, event_id) AS path FROM events GROUP BY 1")
def ud02(spark, sf):
    g = t(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    return g.select("user_id", F.array_join(F.transform("s", lambda x: x["event_type"]), " > ").alias("path"))


@R.add("UD04", "SELECT DISTINCT user_id, epoch_us(ts) AS us, isodow(ts) >= 6 AS weekend FROM events")
def ud04(spark, sf):
    ES.register_functor("weekend", (), lambda ts: F.weekday(ts) >= 5)
    e = t(spark, sf, "events").select(F.col("user_id"), F.col("ts").cast("timestamp").alias("timestamp")).distinct()
    return ES.add_functors(e, e, ["weekend"]).select("user_id", F.unix_micros("timestamp").alias("us"), "weekend")


@R.add("UD05", "SELECT user_id, round(avg(CASE WHEN value < 90 THEN CAST(event_type = 'purchase' AS INT) END), 4) AS mean_label FROM events GROUP BY 1 HAVING count(*) FILTER (value < 90) > 0")
def ud05(spark, sf):
    from tidemark.operators.sequences import label_samples

    labeler = lambda d: d.select("user_id", (F.col("event_type") == "purchase").alias("label"), (F.col("value") < 90).alias("valid"))
    return rounded(label_samples(t(spark, sf, "events"), labeler, "user_id"), "mean_label").select("user_id", "mean_label")


@R.add("UD06", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s, sum(o_totalprice * o_totalprice) AS q, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n, round(s / n, 6) AS mean FROM a")
def ud06(spark, sf):
    from tidemark.plans.transformers import FlatFeatureSelector

    flat = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("w/p/p/count"), F.count("*").alias("w/p/p/has_values_count"), F.sum("o_totalprice").alias("w/p/p/sum"), F.max(F.lit(None).cast("double")).alias("w/p/p/max"))
    d = FlatFeatureSelector(keep=["o_custkey"]).fit(flat).transform(flat)
    return d.select("o_custkey", F.col("`w/p/p/count`").alias("n"), F.round(F.col("`w/p/p/mean`"), 6).alias("mean"))
