"""Metrics of predictions as distributed aggregates. Tables have a label (0/1) and a score, and may have group columns.

Curves start from counts by distinct score. Running totals over them are built in two levels (buckets of
the score, then inside each bucket), so no task holds a whole curve.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.quantiles import quantile
from tidemark.operators.segments import Running, Segments

BUCKETS = 1000


def score_counts(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, p, pos, neg) for each distinct score; rows without label or score go."""
    known = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    return known.groupBy(*by, F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def curve(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Each distinct score with tp and fp (rows at or above it), and the totals n_pos and n_neg."""
    rows = score_counts(df, y, p, by).withColumn("_b", F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("p"))) * BUCKETS))
    sums = rows.groupBy(*by, "_b").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    above = W.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)  # at most 3,000 buckets
    whole = W.partitionBy(*by)
    sums = sums.select(*by, "_b", F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_tp0"), F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("_fp0"), F.sum("_pos").over(whole).alias("n_pos"), F.sum("_neg").over(whole).alias("n_neg"))
    inside = W.partitionBy(*by, "_b").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    own = rows.withColumn("tp", F.sum("pos").over(inside)).withColumn("fp", F.sum("neg").over(inside))
    joined = own.join(sums, [*by, "_b"])
    return joined.select(*by, "p", "pos", "neg", (F.col("tp") + F.col("_tp0")).alias("tp"), (F.col("fp") + F.col("_fp0")).alias("fp"), "n_pos", "n_neg")


def _auc() -> Column:
    """Rank sum with ties at half: each negative of a score counts the positives above it and half of its own."""
    return F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0)), F.max("n_pos") * F.max("n_neg").cast("double"))


def _ap() -> Column:
    return F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")), F.max("n_pos").cast("double"))


def roc_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return curve(df, y, p, by).groupBy(*by).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return curve(df, y, p, by).groupBy(*by).agg(_ap().alias("average_precision"))


def pr_curve(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the end point (1, 0) without a threshold."""
    pts = curve(df, y, p, by).select(*by, F.col("p").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("n_pos")).alias("recall"))
    end = pts.select(*by).distinct() if by else pts.limit(1)
    return pts.unionByName(end.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def precision_at_recall(df: DataFrame, y: str, p: str, recall: float = 0.8, by: Sequence[str] = ()) -> DataFrame:
    """Precision at the curve's point closest to the recall; of equally close ones that of the lowest threshold."""
    pts = pr_curve(df, y, p, by)
    key = F.struct(F.round(F.abs(F.col("recall") - recall), 12), F.coalesce("threshold", F.lit(float("inf"))))
    return pts.groupBy(*by).agg(F.min_by("precision", key).alias("precision_at_recall"))


def recall_at_specificity(df: DataFrame, y: str, p: str, specificity: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """The largest recall whose specificity is at least the target, predicting at scores >= a threshold, and a threshold halfway to
    the next lower score (the lowest score itself if there is none)."""
    pts = curve(df, y, p, by).withColumn("_b", F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("p"))) * BUCKETS))
    heads = pts.groupBy(*by, "_b").agg(F.max("p").alias("_top"))
    heads = heads.select(*by, "_b", F.lead("_top").over(W.partitionBy(*by).orderBy(F.desc("_b"))).alias("_below"))
    low = F.lead("p").over(W.partitionBy(*by, "_b").orderBy(F.desc("p")))
    pts = pts.withColumn("_low", low).join(heads, [*by, "_b"]).withColumn("_low", F.coalesce("_low", "_below"))
    spec = F.try_divide(F.col("n_neg") - F.col("fp"), F.col("n_neg"))
    ok = pts.filter(spec >= specificity).withColumn("_t", F.coalesce((F.col("p") + F.col("_low")) / 2, F.col("p")))
    none = pts.groupBy(*by).agg(F.max("n_pos").alias("_n"))
    best = ok.groupBy(*by).agg(F.max(F.struct(F.try_divide(F.col("tp"), F.col("n_pos")).alias("r"), F.col("_t").alias("t"))).alias("_s"))
    joined = none.join(best, list(by), "left") if by else none.join(best, F.lit(True), "left")  # one row each without groups
    return joined.select(*by, F.coalesce(F.col("_s.r"), F.lit(0.0)).alias("recall_at_specificity"), F.col("_s.t").alias("threshold"))


def confusion(threshold: float, y: str = "y", p: str = "p") -> dict[str, Column]:
    """accuracy, recall and specificity, a score above the threshold counting as positive."""
    hit, pos = F.col(p) > threshold, F.col(y) == 1
    n = lambda c: F.count_if(c)
    return {"accuracy": F.try_divide(n(hit == pos), F.count("*")), "recall": F.try_divide(n(hit & pos), n(pos)), "specificity": F.try_divide(n(~hit & ~pos), n(~pos))}


def brier(y: str = "y", p: str = "p") -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), F.lit(2)))


def log_loss(y: str = "y", p: str = "p", eps: float = 1e-15) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    return -F.avg(F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def chi_square_tail(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom > x), by the incomplete gamma function."""
    if x <= 0 or k <= 0:
        return 1.0
    a, z = k / 2, x / 2
    lead = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * lead)
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def calibration_bins(df: DataFrame, y: str, p: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(bin, n, observed, expected) of equal bins of the score; 1.0 is in the last."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("observed"), F.sum(p).alias("expected"))


def d_calibration(df: DataFrame, y: str, p: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Chi-square of observed against expected positives over filled bins, and its degrees of freedom (filled bins less one)."""
    t = calibration_bins(df, y, p, bins, by)
    return t.groupBy(*by).agg(F.sum(F.try_divide(F.pow(F.col("observed") - F.col("expected"), F.lit(2)), F.col("expected"))).alias("chi_square"), (F.count("*") - 1).cast("int").alias("dof"))


def with_p_value(df: DataFrame, least: float = 0.05) -> DataFrame:
    """Add p_value and the flag is_calibrated; a Pandas UDF over one row for each group."""
    return df.withColumn("p_value", chi_square_p("chi_square", "dof")).withColumn("is_calibrated", F.col("p_value") >= least)


def metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (), threshold: float = 0.5, recall: float = 0.8, specificity: float = 0.9) -> DataFrame:
    """The bundle of metrics per group; all but n and n_pos are null where a group has one class only."""
    rows = df.select(*by, F.col(y).alias("y"), F.col(p).alias("p")).dropna(subset=["y", "p"])
    group = list(by) or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(1))
    plain = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("n_pos"), *[c.alias(k) for k, c in confusion(threshold).items()], brier().alias("brier"), log_loss().alias("log_loss"))
    c = curve(rows, "y", "p", group)
    ranked = c.groupBy(*group).agg(_auc().alias("roc_auc"), _ap().alias("average_precision"))
    out = plain.join(ranked, group, "left").join(precision_at_recall(rows, "y", "p", recall, group), group, "left").join(recall_at_specificity(rows, "y", "p", specificity, group).drop("threshold"), group, "left")
    two = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    names = [x for x in out.columns if x not in (*group, "n", "n_pos")]
    return out.select(*by, "n", "n_pos", *[F.when(two, F.col(x)).alias(x) for x in names])


def by_subgroup(df: DataFrame, flags: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """A row for each subgroup a row belongs to, and one for ``all``."""
    names = F.array_compact(F.array(F.lit("all"), *[F.when(c, F.lit(n)) for n, c in flags.items()]))
    return df.select(*keep, F.explode(names).alias("subgroup"))


def one_vs_rest(df: DataFrame, label: str, probs: str, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """(class, y, p) rows from a label and an array of class probabilities in the order of ``classes``."""
    items = [F.struct(F.lit(c).alias("class"), (F.col(label) == F.lit(c)).cast("int").alias("y"), F.get(probs, F.lit(i)).cast("double").alias("p")) for i, c in enumerate(classes)]
    return df.select(*by, F.explode(F.array(*items)).alias("_r")).select(*by, "_r.*")


def multiclass(df: DataFrame, label: str, probs: str, classes: Sequence) -> DataFrame:
    """One row: accuracy, nll, macro and weighted AUROC (one against the rest) and macro average precision."""
    per = curve(one_vs_rest(df, label, probs, classes), "y", "p", ["class"]).groupBy("class").agg(_auc().alias("auc"), _ap().alias("ap"), F.max("n_pos").alias("k"))
    ranked = per.agg(F.avg("auc").alias("auroc_macro"), (F.sum(F.col("auc") * F.col("k")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("k")))).alias("auroc_weighted"), F.avg("ap").alias("auprc_macro"))
    at = F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int")
    best = F.array_position(probs, F.array_max(probs))
    p = F.greatest(F.lit(1e-15), F.get(probs, at - 1).cast("double"))
    plain = df.agg(F.count("*").alias("n"), F.avg((best == at).cast("double")).alias("accuracy"), (-F.avg(F.ln(p))).alias("nll"))
    return plain.join(ranked)  # one row each


def one_vs_one_auc(df: DataFrame, label: str, probs: str, classes: Sequence) -> DataFrame:
    """Mean AUROC over ordered pairs of classes: class a against class b by the probability of a."""
    long = one_vs_rest(df, label, probs, classes, [label])
    others = F.array(*map(F.lit, classes))
    pairs = long.withColumn("other", F.explode(F.array_remove(F.when(F.col("y") == 1, others).otherwise(F.array(F.col(label))), F.col("class"))))
    per = curve(pairs, "y", "p", ["class", "other"]).groupBy("class", "other").agg(_auc().alias("auc"))
    return per.agg(F.avg("auc").alias("auroc_ovo"))


def multilabel(df: DataFrame, labels: str, probs: str, n: int) -> DataFrame:
    """Micro, macro and weighted AUROC and AP, and accuracy at 0.5, from arrays of labels and probabilities."""
    items = [F.struct(F.lit(i).alias("label"), F.get(labels, F.lit(i)).cast("int").alias("y"), F.get(probs, F.lit(i)).cast("double").alias("p")) for i in range(n)]
    long = df.select(F.explode(F.array(*items)).alias("r")).select("r.*")
    per = curve(long, "y", "p", ["label"]).groupBy("label").agg(_auc().alias("auc"), _ap().alias("ap"), F.max("n_pos").alias("k"))
    macro = per.agg(F.avg("auc").alias("auroc_macro"), (F.sum(F.col("auc") * F.col("k")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("k")))).alias("auroc_weighted"), F.avg("ap").alias("auprc_macro"))
    micro = curve(long, "y", "p").agg(_auc().alias("auroc_micro"), _ap().alias("auprc_micro"))
    return long.agg(F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy")).join(macro).join(micro)  # one row each


def regression(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    d = F.col(p) - F.col(y)
    return df.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.avg(F.pow(F.log1p(p) - F.log1p(y), F.lit(2))).alias("msle"), (1 - F.try_divide(F.var_pop(F.col(y) - F.col(p)), F.var_pop(y))).alias("explained_variance"))


def calibration_curve(df: DataFrame, y: str, p: str, bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """(bin, n, mean_pred, frac_pos) in uniform or quantile bins of the score."""
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(p).alias("p")).dropna()
    if strategy == "uniform":
        rows = rows.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    else:
        cuts = quantile(rows, "p", [i / bins for i in range(1, bins)], interpolation="linear")
        edges = cuts.select(F.array_sort(F.array_distinct(F.array_compact(F.array(*cuts.columns)))).alias("_e"))
        rows = rows.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_e", lambda e: e <= F.col("p"))))  # one row of edges
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_pred"), F.avg("y").alias("frac_pos"))


def bootstrap_band(df: DataFrame, y: str, p: str, bins: int = 10, replicates: int = 100, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(bin, frac_pos, low, high): a bootstrap band of the observed share of positives in equal bins of the score.

    A replicate gives each row a Poisson(1) weight, and the share of a bin depends on the sums of the weights of its positives and
    of its negatives alone; these are Poisson with the two counts. So the rows are counted once, and numbers are drawn for each bin,
    class and replicate, from a seed and the bin: the same on any partitioning."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(F.count_if(F.col(y) > 0).alias("pos"), F.count("*").alias("n"))
    tail = (1 - level) / 2

    def draw(parts):
        for part in parts:
            low, high = [], []
            for i, pos, n in zip(part["bin"], part["pos"], part["n"], strict=True):
                drawn = np.random.default_rng([seed, int(i)]).poisson([int(pos), int(n - pos)], (replicates, 2))
                size = drawn.sum(axis=1)
                shares = drawn[size > 0, 0] / size[size > 0]
                low.append(float(np.quantile(shares, tail)) if len(shares) else None)
                high.append(float(np.quantile(shares, 1 - tail)) if len(shares) else None)
            yield pd.DataFrame({"bin": part["bin"], "frac_pos": part["pos"] / part["n"], "low": low, "high": high})

    return counts.mapInPandas(draw, "bin int, frac_pos double, low double, high double")


@F.pandas_udf(DoubleType())
def chi_square_p(x: pd.Series, k: pd.Series) -> pd.Series:
    """Tail probabilities, for small tables (a row for each test)."""
    return pd.Series([None if a is None or a != a or b is None else chi_square_tail(float(a), int(b)) for a, b in zip(x, k, strict=True)], dtype="float64")


def group_tests(df: DataFrame, group: str, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """(variable, test, statistic, dof, p_value): whether variables differ between groups, all from one plan.

    Numeric ones by Kruskal-Wallis with correction for ties: the different values of all variables are one table, ranked by a running
    sum of their counts that cuts large variables into segments. Categorical ones by chi-square of independence, from the cells that
    are not empty. Nulls are left out by variable. Fewer than two groups, values or levels give a null statistic."""
    g = F.col(group)
    out = []
    if numeric:
        items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in numeric])
        long = df.filter(g.isNotNull()).select(g.alias("g"), F.explode(items).alias("x")).select("x.variable", "x.v", "g").filter("v is not null and not isnan(v)")
        counts = long.groupBy("variable", "v", "g").agg(F.count("*").alias("k"))
        ties = counts.groupBy("variable", "v").agg(F.sum("k").alias("t"))
        ranked = Segments.of(ties, "variable", ["v"]).running(Running("_upto", "sum", F.col("t"))).frame()
        ranks = ranked.select(F.struct("variable", "v").alias("at"), (F.col("_upto") - (F.col("t") - 1) / 2.0).alias("rank"), (F.pow("t", F.lit(3)) - F.col("t")).alias("tie"))
        sums = counts.join(ranks, F.struct("variable", "v") == F.col("at")).groupBy("variable", "g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("r"))
        whole = ranks.groupBy(F.col("at.variable").alias("tv")).agg(F.sum("tie").alias("tie"))
        per = sums.groupBy("variable").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), (F.count("*") - 1).alias("dof"))
        n = F.col("n")
        h = F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.try_divide(F.col("tie"), F.pow(n, F.lit(3)) - n))
        out.append(per.join(whole, F.col("variable") == F.col("tv")).select("variable", F.lit("kruskal").alias("test"), F.when(F.col("dof") > 0, h).alias("statistic"), "dof"))
    if categorical:
        items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("v")) for c in categorical])
        cells = df.filter(g.isNotNull()).select(g.alias("g"), F.explode(items).alias("x")).select("x.variable", "x.v", "g").filter("v is not null").groupBy("variable", "v", "g").agg(F.count("*").alias("k"))
        levels = cells.groupBy("variable", "v").agg(F.sum("k").alias("k")).select(F.struct("variable", "v").alias("lv"), F.col("k").alias("lk"))
        groups = cells.groupBy("variable", "g").agg(F.sum("k").alias("k")).select(F.struct("variable", "g").alias("gv"), F.col("k").alias("gk"))
        share = cells.join(levels, F.struct("variable", "v") == F.col("lv")).join(groups, F.struct("variable", "g") == F.col("gv"))
        per = share.groupBy("variable").agg(F.sum("k").alias("n"), F.sum(F.col("k").cast("double") * F.col("k") / (F.col("lk").cast("double") * F.col("gk"))).alias("q"))
        a = levels.groupBy(F.col("lv.variable").alias("av")).agg((F.count("*") - 1).alias("a"))
        b = groups.groupBy(F.col("gv.variable").alias("bv")).agg((F.count("*") - 1).alias("b"))
        full = per.join(a, F.col("variable") == F.col("av")).join(b, F.col("variable") == F.col("bv")).withColumn("dof", F.col("a") * F.col("b"))
        out.append(full.select("variable", F.lit("chi-square").alias("test"), F.when(F.col("dof") > 0, F.col("n") * (F.col("q") - 1)).alias("statistic"), "dof"))
    if not out:
        raise ValueError("no variable")
    found = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return found.withColumn("p_value", chi_square_p("statistic", "dof"))


def contingency_chi_square(df: DataFrame, a: str, b: str) -> tuple[float, int, float]:
    """Chi-square of independence of two categorical columns: statistic, degrees of freedom, p-value."""
    r = group_tests(df, b, categorical=[a]).first()
    return r["statistic"], r["dof"], r["p_value"]


def kruskal(df: DataFrame, group: str, value: str) -> tuple[float, int, float]:
    """Kruskal-Wallis: statistic corrected for ties, degrees of freedom, p-value."""
    r = group_tests(df, group, [value]).first()
    return r["statistic"], r["dof"], r["p_value"]


def collect_predictions(spark, path: str) -> DataFrame:
    """Predictions written as ``<path>/model=<m>/fold=<f>``, with model and fold as columns."""
    return spark.read.option("basePath", path).parquet(f"{path}/model=*/fold=*")
