"""Aggregations over episode, event and measurement tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.quantiles import quantile, wide, with_quantiles
from tidemark.functions.scalars import cut_right, micros


def null_report(df: DataFrame) -> DataFrame:
    """(column, n_null, n_nan) for all columns, from one aggregate."""
    nan = lambda c, k: F.count_if(F.isnan(c)) if k in ("float", "double") else F.lit(0)
    stats = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), nan(c, k).cast("long").alias("n_nan")) for c, k in df.dtypes]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def extent(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[f(c).alias(f"{p}_{c}") for c in cols for p, f in (("min", F.min), ("max", F.max))])


def cost_summary(df: DataFrame, cost: str, by: Column, name: str = "year") -> DataFrame:
    """N, share of all rows, mean, quartiles and share below 1 by a key."""
    df = df.select(by.alias(name), F.col(cost).alias("_cost"))
    g = df.groupBy(name).agg(F.count("*").alias("n"), F.avg("_cost").alias("mean"), F.avg((F.col("_cost") < 1).cast("double")).alias("below_1"))
    g = with_quantiles(g, df, "_cost", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, [name])
    return g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def threshold_counts(df: DataFrame, c: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(c) < b).alias(f"below_{b:g}") for b in bounds])


def value_counts(df: DataFrame, c: str, percent: bool = False) -> DataFrame:
    """Counts of each value, null included, most frequent first, ties by value."""
    out = df.groupBy(c).count()
    if percent:
        out = out.withColumn("percent", F.col("count") * 100.0 / F.sum("count").over(W.partitionBy()))
    return out.orderBy(F.desc("count"), F.asc_nulls_first(c))


def describe(df: DataFrame, c: str, percentiles: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = ()) -> DataFrame:
    names = {f"p{p * 100:g}".replace(".", "_"): p for p in percentiles}
    out = df.groupBy(*by).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    return with_quantiles(out, df, c, names, by).select(*by, "count", "mean", "std", "min", *names, "max")


def edge_row(df: DataFrame, key: str, order: Sequence[str], edge: str = "first") -> DataFrame:
    """The first or last row of each subject in the given order; partial aggregates, no sort of whole subjects."""
    row = (F.min_by if edge == "first" else F.max_by)(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(key).agg(row.alias("_row")).select("_row.*")


def flat_list(df: DataFrame, key: str, arr: str, order: Sequence[str]) -> DataFrame:
    """All elements of a subject's arrays in the order of rows, without nulls."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(arr).alias("_arr"))))
    return df.groupBy(key).agg(F.array_compact(F.flatten(F.transform(rows, lambda r: F.coalesce(r["_arr"], F.array().cast(df.schema[arr].dataType))))).alias(arr))


def conditional_counts(df: DataFrame, key: str, conditions: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def observation_counts(df: DataFrame, unit: str, value: str, all_units: DataFrame) -> DataFrame:
    """possible: units there are; observed: units with a value; total: values."""
    seen = df.agg(F.count_distinct(F.when(F.col(value).isNotNull(), F.col(unit))).alias("observed"), F.count(value).alias("total"))
    return all_units.agg(F.count_distinct(unit).alias("possible")).crossJoin(seen)  # one row each


def key_stats(df: DataFrame, key: str, value: str, c: float | None = None) -> DataFrame:
    """Mean and sample standard deviation by key; with c the thresholds mean -+ c std."""
    out = df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    if c is not None:
        out = out.withColumn("thresh_low", F.col("mean") - c * F.col("std")).withColumn("thresh_high", F.col("mean") + c * F.col("std"))
    return out


def integrality(df: DataFrame, key: str, value: str, cutoff: float, least_values: int) -> DataFrame:
    """Share of whole values and distinct values by key, and what follows: is_integer, is_categorical."""
    v = F.col(value)
    out = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(key).agg(F.avg((v == F.round(v)).cast("double")).alias("share_whole"), F.count_distinct(v).alias("n_distinct"))
    return out.withColumn("is_integer", F.col("share_whole") > cutoff).withColumn("is_categorical", F.col("n_distinct") < least_values)


def distinct_values(df: DataFrame, c: str, most: int = 5000) -> list:
    """The sorted distinct values of a column, for a pivot of a stable form; raises beyond ``most``."""
    rows = df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{c} has over {most} values: keep the long form")
    return [r[0] for r in rows]


def presence(df: DataFrame, ids: Sequence[str], c: str, values: Sequence | None = None) -> DataFrame:
    values = distinct_values(df, c) if values is None else values
    return df.groupBy(*ids).pivot(c, list(values)).agg(F.max(F.lit(True)))


def key_value_wide(df: DataFrame, ids: Sequence[str], key: str, value: str, values: Sequence | None = None) -> DataFrame:
    """Per id and key: count, has_values_count, sum, sum_sqd, min and max of the values, one column each."""
    values = distinct_values(df, key) if values is None else values
    v = F.col(value)
    ok = F.when(v.isNotNull() & ~F.isnan(v), v)
    return df.groupBy(*ids).pivot(key, list(values)).agg(F.count(F.lit(1)).alias("count"), F.count(ok).alias("has_values_count"), F.sum(ok).alias("sum"), F.sum(ok * ok).alias("sum_sqd"), F.min(ok).alias("min"), F.max(ok).alias("max"))


def pivot_counts(df: DataFrame, key: str, code: str, prefix: str = "", values: Sequence | None = None) -> DataFrame:
    """Counts of each code per subject, one column a code, zero where absent."""
    values = distinct_values(df, code) if values is None else list(values)
    wide = df.groupBy(key).pivot(code, values).count()
    return wide.select(key, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{prefix}{v}") for v in values])


def sparse_counts(df: DataFrame, key: str, code: str, index: DataFrame) -> DataFrame:
    """The same in sparse form for very many codes: (key, indices, counts). ``index``: code -> idx."""
    one = df.join(index, code).groupBy(key, "idx").count()
    lists = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "count"))).alias("_p"))
    return lists.select(key, F.transform("_p", lambda p: p["idx"]).alias("indices"), F.transform("_p", lambda p: p["count"]).alias("counts"))


def one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """0/1 columns for the sorted values of categorical columns; null has a column of its own."""
    out = df
    for c in cols:
        for v in distinct_values(df, c):
            out = out.withColumn(f"{c}_{v}", F.coalesce((F.col(c) == F.lit(v)), F.lit(False)).cast("int"))
        out = out.withColumn(f"{c}_null", F.col(c).isNull().cast("int"))
    return out.drop(*cols)


def stratify_counts(df: DataFrame, key: str) -> DataFrame:
    """Subjects by their number of rows: 1, 2-5, 6-10, 11-20, over 20."""
    n = df.groupBy(key).count()
    label = cut_right("count", [1, 5, 10, 20], ["1", "2-5", "6-10", "11-20", ">20"])
    return n.groupBy(label.alias("stratum")).agg(F.count("*").alias("n_subjects"), F.sum("count").alias("n_rows"))


def monthly_stay(df: DataFrame, start: str, end: str, after: str) -> DataFrame:
    """Rows and mean days by month of start, for starts after a date."""
    late = df.filter(F.col(start) > F.lit(after).cast("date"))
    return late.groupBy(F.date_format(start, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.avg(F.datediff(end, start)).alias("mean_days"))


def events_per_subject(subjects: DataFrame, events: DataFrame, key: str) -> DataFrame:
    return subjects.select(key).join(events.groupBy(key).agg(F.count("*").alias("n_events")), key, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def inter_event_stats(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Minimum of the minutes to a subject's next event, and mean and deviation of their logarithm."""
    w = W.partitionBy(key).orderBy(ts)
    d = ((F.lead(micros(ts)).over(w) - micros(ts)) / 60e6).alias("d")
    return events.select(d).filter("d is not null").agg(F.min("d").alias("min_minutes"), F.avg(F.log("d")).alias("mean_log"), F.stddev_samp(F.log("d")).alias("std_log"))


def task_summary(tasks: DataFrame, key: str, label: str) -> DataFrame:
    """Samples, median per subject, mean of the subjects' means, mean weighted by samples."""
    per = tasks.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("m"))
    return per.agg(F.sum("n").alias("n_samples"), F.percentile("n", F.lit(0.5)).alias("median_per_subject"), F.avg("m").alias("macro_mean"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("weighted_mean"))


def activity(events: DataFrame, key: str, ts: str, unit: str, covariate: str) -> DataFrame:
    """Per bucket of time and covariate: distinct subjects, events, subjects that begin and end there, and how many are active."""
    bucket = F.date_trunc(unit, F.col(ts).cast("timestamp"))
    per = events.groupBy(covariate, bucket.alias("bucket")).agg(F.count_distinct(key).alias("n_subjects"), F.count("*").alias("n_events"))
    span = events.groupBy(covariate, key).agg(F.min(bucket).alias("first"), F.max(bucket).alias("last"))
    began = span.groupBy(covariate, F.col("first").alias("bucket")).agg(F.count("*").alias("began"))
    ended = span.groupBy(covariate, F.col("last").alias("bucket")).agg(F.count("*").alias("ended"))
    out = per.join(began, [covariate, "bucket"], "left").join(ended, [covariate, "bucket"], "left").fillna(0, ["began", "ended"])
    w = W.partitionBy(covariate).orderBy("bucket")
    total = F.sum("began").over(w)
    return out.withColumn("cumulative_subjects", total).withColumn("active_subjects", total - F.sum("ended").over(w) + F.col("ended"))


def age_activity(events: DataFrame, key: str, age: Column, size: float) -> DataFrame:
    """Per bucket of age: subjects, events, the mean over subjects of their mean age, events per subject."""
    per = events.withColumn("_age", age).groupBy(key, (F.round(F.col("_age") / size) * size).alias("age_bucket")).agg(F.count("*").alias("n"), F.avg("_age").alias("m"))
    return per.groupBy("age_bucket").agg(F.count("*").alias("n_subjects"), F.sum("n").alias("n_events"), F.avg("m").alias("mean_age"), (F.sum("n") / F.count("*")).alias("events_per_subject"))


def by_covariate(df: DataFrame, key: str, covariate: str) -> DataFrame:
    return df.groupBy(covariate).agg(F.count_distinct(key).alias("n_subjects"))


def decile_analysis(df: DataFrame, truth: str, prediction: str, bins: int = 10) -> DataFrame:
    """By decile of the truth (equal edges count once, intervals closed on the right): n, means, absolute and relative error."""
    cuts = quantile(df, truth, [i / bins for i in range(1, bins)], interpolation="linear")
    edges = cuts.select(F.array_sort(F.array_distinct(F.array_compact(F.array(*cuts.columns)))).alias("_edges"))
    marked = df.join(F.broadcast(edges)).withColumn("decile", F.size(F.filter("_edges", lambda b: b < F.col(truth))))  # one row of edges
    out = marked.groupBy("decile").agg(F.count("*").alias("n"), F.avg(truth).alias("mean_true"), F.avg(prediction).alias("mean_pred"))
    error = F.abs(F.col("mean_pred") - F.col("mean_true"))
    return out.withColumn("abs_error", error).withColumn("rel_error", F.try_divide(error, F.col("mean_true")))


def fold_summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation and 95 % half-width of metrics over folds; sums of flags."""
    cols = []
    for m in metrics:
        cols += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), (1.96 * F.stddev_pop(m) / F.sqrt(F.count(m))).alias(f"{m}_ci95")]
    return df.groupBy(*by).agg(*cols, *[F.sum(F.col(f).cast("long")).alias(f"{f}_sum") for f in flags])


def characteristics(df: DataFrame, outcome: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Baseline table in long form: (variable, level, outcome, n, percent, median, q25, q75)."""
    out = None
    if numeric:
        qs = {"median": 0.5, "q25": 0.25, "q75": 0.75}
        sizes = df.groupBy(F.struct(outcome).alias("_g")).agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(numeric)])
        cuts = wide(df, {f"{k}{i}": (c, q) for i, c in enumerate(numeric) for k, q in qs.items()}, [outcome])
        both = sizes.join(cuts.select(F.struct(outcome).alias("_h"), *[f"{k}{i}" for i in range(len(numeric)) for k in qs]), F.col("_g") == F.col("_h"), "left")
        rows = [F.struct(F.lit(c).alias("variable"), F.col(f"n{i}").alias("n"), *[F.col(f"{k}{i}").alias(k) for k in qs]) for i, c in enumerate(numeric)]
        long = both.select(F.col(f"_g.`{outcome}`").alias(outcome), F.explode(F.array(*rows)).alias("x"))
        out = long.select("x.variable", F.lit(None).cast("string").alias("level"), outcome, "x.n", F.lit(None).cast("double").alias("percent"), "x.median", "x.q25", "x.q75")
    none = F.lit(None).cast("double")
    for c in categorical:
        n = df.groupBy(outcome, F.col(c).cast("string").alias("level")).count().withColumnRenamed("count", "n")
        part = n.select(F.lit(c).alias("variable"), "level", outcome, "n", (F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(outcome))).alias("percent"), none.alias("median"), none.alias("q25"), none.alias("q75"))
        out = part if out is None else out.unionByName(part)
    return out
