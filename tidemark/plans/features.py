"""Baseline features, subgroups and history texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggs as A
from tidemark.operators.joins import point_in_time


def order_sentence(day: str = "o_orderdate", status: str = "o_orderstatus", cost: str = "o_totalprice") -> Column:
    """A sentence about one episode, from a code lookup and a template, without a UDF."""
    name = F.when(F.col(status) == "F", "final").when(F.col(status) == "O", "open").otherwise("other")
    large = F.when(F.col(cost) > 200_000, ", large").otherwise("")
    return F.concat(F.lit("On "), F.date_format(day, "dd/MM/yyyy"), F.lit(" an order of status "), name, large, F.lit("."))


def history_text(df: DataFrame, key: str, order: Sequence[str], sentence: Column, header: Column | None = None, sep: str = " ") -> DataFrame:
    """One text per subject: its sentences in order, after a header made of the subject's own columns."""
    rows = df.withColumn("_s", sentence)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_s"))), lambda x: x["_s"]), sep)
    out = rows.groupBy(key).agg(text.alias("text"))
    return out if header is None else out.withColumn("text", F.concat(header, F.lit(sep), "text"))


def baseline(df: DataFrame, index: DataFrame, key: str, ts: str, index_ts: str, order: Sequence[str], lookback_months: int, last: Sequence[str], sums: Mapping[str, Column], code: str | None = None, codes: Sequence[str] = ()) -> DataFrame:
    """One row per subject with ``feature_`` columns: last values, sums and counts, code counts, over the look-back up to and with the index."""
    rows = point_in_time(df, index, key, ts, index_ts, lookback_months)
    row = F.max_by(F.struct(*last), F.struct(*order))
    out = rows.groupBy(key).agg(F.count("*").alias("feature_num_episodes"), row.alias("_last"), *[F.sum(c).alias(f"feature_{n}") for n, c in sums.items()])
    out = out.select(key, "feature_num_episodes", *[F.col(f"_last.{c}").alias(f"feature_last_{c}") for c in last], *[f"feature_{n}" for n in sums])
    if code:
        out = out.join(A.pivot_counts(rows, key, code, "feature_", codes or None), key, "left")
    return out


def subgroups(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """A boolean column for each named subgroup; null counts as not in it."""
    return df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in rules.items()})


def matches_any(arr: str, pattern: str) -> Column:
    return F.exists(arr, lambda x: x.rlike(pattern))


def first_group(rules: Sequence[tuple[str, Column]], other: str = "other") -> Column:
    """The name of the first rule that holds."""
    out = F.when(rules[0][1], rules[0][0])
    for name, cond in rules[1:]:
        out = out.when(cond, name)
    return out.otherwise(other)


def code_prefix_counts(df: DataFrame, key: str, arr: str, prefix: str, sep: str = ".") -> DataFrame:
    """Counts of the codes of an array by what stands before the separator, joined to the rows; one row per key."""
    long = df.select(key, F.explode(arr).alias("_c")).select(key, F.split_part("_c", F.lit(sep), F.lit(1)).alias("_c")).filter("_c <> ''")
    values = A.distinct_values(long, "_c")
    if not values:
        return df
    counts = A.pivot_counts(long, key, "_c", prefix, values)
    return df.join(counts, key, "left").fillna(0, [f"{prefix}{v}" for v in values])
