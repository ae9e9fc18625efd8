"""Filters, projections and validation of episode and event tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import portable_hash


class ValidationError(ValueError):
    """A table is not what an operator needs."""


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def pick_columns(df: DataFrame, prefix: str | None = None, suffix: str | None = None, regex: str | None = None, types: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the columns that meet every given condition."""
    found = []
    for name, kind in df.dtypes:
        ok = (prefix is None or name.startswith(prefix)) and (suffix is None or name.endswith(suffix))
        ok = ok and (regex is None or re.search(regex, name)) and (types is None or kind in types) and name not in exclude
        if ok:
            found.append(name)
    return found


def harmonise(df: DataFrame, names: Mapping[str, str | Column], flag: str | None = None) -> DataFrame:
    """One source in the common schema: output name -> column or expression, and a flag column set to 1."""
    cols = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in names.items()]
    return df.select(*cols, *([F.lit(1).alias(flag)] if flag else []))


def recode(c: str, rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """The value of the first rule that holds, else ``default`` (None: the column itself)."""
    out = F.when(*_rule(rules[0]))
    for rule in rules[1:]:
        out = out.when(*_rule(rule))
    return out.otherwise(F.col(c) if default is None else F.lit(default))


def _rule(rule):
    cond, value = rule
    return cond, value if isinstance(value, Column) else F.lit(value)


def fold_rare(df: DataFrame, cols: Sequence[str], least: int, other: str = "other") -> DataFrame:
    """Values of a column with fewer than ``least`` rows become ``other``; null stays null.

    The counts have a row for each value; Spark broadcasts them if small."""
    for c in cols:
        rare = df.groupBy(c).count().filter((F.col("count") < least) & F.col(c).isNotNull()).select(F.col(c).alias("_rare"))
        df = df.join(rare, F.col(c) == F.col("_rare"), "left").withColumn(c, F.when(F.col("_rare").isNotNull(), F.lit(other)).otherwise(F.col(c))).drop("_rare")
    return df


def include(df: DataFrame, targets: Mapping[str, bool | Sequence]) -> DataFrame:
    """Keep rows by column: True needs a value, False needs none, a list needs one of its values."""
    for c, want in targets.items():
        if want is True:
            df = df.filter(F.col(c).isNotNull())
        elif want is False:
            df = df.filter(F.col(c).isNull())
        elif len(want) > 1000:
            keys = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(want)], [c])
            df = df.join(keys, c, "left_semi").select(df.columns)
        else:
            df = df.filter(F.col(c).isin(list(want)))
    return df


def study_window(df: DataFrame, start: str, end: str, first: str, last: str) -> DataFrame:
    """Episodes that start on or after ``first`` and end before ``last``."""
    return df.filter((F.col(end) < F.lit(last).cast("date")) & (F.col(start) >= F.lit(first).cast("date")))


def exclude(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false; rows where it is null go too."""
    return df.filter(~condition)


def min_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the subjects with at least n rows. Counts first, so a subject of any size stays distributed."""
    keys = df.groupBy(key).count().filter(F.col("count") >= n).select(key)
    return df.join(keys, key, "left_semi")


def unqualified_newborns(code: str = "srg", age: str = "age_recode", value: str = "74") -> Column:
    """Condition to exclude: the newborn code at age zero."""
    return (F.coalesce(F.col(code), F.lit("")) == value) & (F.coalesce(F.col(age), F.lit(1.0)) < 1e-6)


def drop_after_event(df: DataFrame, key: str, ts: str, events: DataFrame, event_ts: str) -> DataFrame:
    """Remove subjects with any row after their event (death)."""
    last = df.groupBy(key).agg(F.max(ts).alias("_last"))
    late = last.join(events.groupBy(key).agg(F.min(event_ts).alias("_event")), key).filter("_last > _event").select(key)
    return df.join(late, key, "left_anti")


def drop_all_null(df: DataFrame, key: str, c: str) -> DataFrame:
    """Remove subjects for whom a column is null on every row."""
    keys = df.filter(F.col(c).isNotNull()).select(key).distinct()
    return df.join(keys, key, "left_semi")


def drop_by_edge_row(df: DataFrame, key: str, order: Sequence[str], condition: Column, edge: str = "last") -> DataFrame:
    """Remove subjects whose first or last row, in the given order, meets the condition."""
    row = (F.max_by if edge == "last" else F.min_by)(F.struct("*"), F.struct(*order))
    chosen = df.groupBy(key).agg(row.alias("_row")).select("_row.*").filter(condition).select(key)
    return df.join(chosen, key, "left_anti")


def min_events_cascade(subjects: DataFrame, events: DataFrame, measurements: DataFrame, n: int, subject: str = "subject_id", event: str = "event_id"):
    """Subjects with at least n events, their events and their measurements."""
    keys = events.groupBy(subject).count().filter(F.col("count") >= n).select(subject)
    kept = events.join(keys, subject, "left_semi")
    return subjects.join(keys, subject, "left_semi"), kept, measurements.join(kept.select(event), event, "left_semi")


def subset(df: DataFrame, key: str, seed: int, n: int | None = None, share: float | None = None) -> DataFrame:
    """Rows of a repeatable choice of subjects: the n first in the order of a hash, or those with a hash below a share."""
    h = portable_hash(key, seed)
    if n is not None:
        keys = df.select(key).distinct().orderBy(h, key).limit(n)
        return df.join(keys, key, "left_semi")
    return df.filter(h < int(share * 2**32))


def repair_dates(df: DataFrame, start: str, end: str, fill_start: str | None = None, fill_end: str | None = None) -> DataFrame:
    """An end before the start becomes the start; missing stay dates come from the episode's dates."""
    df = df.withColumn(end, F.when(F.col(end) < F.col(start), F.col(start)).otherwise(F.col(end)))
    if fill_start:
        df = df.withColumn(fill_start, F.coalesce(fill_start, start))
    if fill_end:
        df = df.withColumn(fill_end, F.coalesce(fill_end, end))
    return df


def narrow(df: DataFrame) -> DataFrame:
    """Integer columns cast to the smallest type that holds their values, after one aggregate over all of them."""
    sizes = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31), ("bigint", 2**63))
    cols = [c for c, k in df.dtypes if k in dict(sizes)]
    if not cols:
        return df
    found = df.agg(*[f(c).cast("long").alias(f"{p}{i}") for i, c in enumerate(cols) for f, p in ((F.min, "l"), (F.max, "h"))]).first()
    kinds = {}
    for i, c in enumerate(cols):
        low, high = found[f"l{i}"] or 0, found[f"h{i}"] or 0
        kinds[c] = next(k for k, top in sizes if -top <= low and high < top)
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def validate_id(df: DataFrame, c: str) -> DataFrame:
    """Raise unless the id is an integer, not null, not negative and unique. Returns df."""
    x = F.col(c)
    whole = F.coalesce(x.cast("double") == F.floor(x.cast("double")), F.lit(False))
    r = df.agg(F.count("*").alias("n"), F.count(x).alias("k"), F.count_distinct(x).alias("d"), F.min(x).alias("low"), F.bool_and(whole).alias("whole")).first()
    if r["n"] and (r["k"] < r["n"] or r["d"] < r["n"] or r["low"] < 0 or not r["whole"]):
        raise ValidationError(f"{c} is not a unique whole number of at least 0: {r.asDict()}")
    return df


def validate_table(df: DataFrame, id_col: str, linked: Sequence[str] = (), timestamp: str | None = None, forbidden: Sequence[str] = ()) -> DataFrame:
    """Check linkage columns, timestamp type and columns of another temporality; add the id if it is missing."""
    missing = [c for c in linked if c not in df.columns]
    if missing:
        raise ValidationError(f"linkage columns are missing: {missing}")
    if timestamp and dict(df.dtypes).get(timestamp) not in ("timestamp", "timestamp_ntz"):
        raise ValidationError(f"{timestamp} is not a timestamp")
    wrong = [c for c in forbidden if c in df.columns]
    if wrong:
        raise ValidationError(f"columns of another temporality: {wrong}")
    return validate_id(df, id_col) if id_col in df.columns else df.withColumn(id_col, F.monotonically_increasing_id())


def validate_labels(subjects: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Raise unless every subject has exactly one label row and no other has any. Returns the labels."""
    left = subjects.select(key).distinct().withColumn("_s", F.lit(1))
    both = left.join(labels.groupBy(key).count(), key, "full").agg(F.count_if(F.col("_s").isNull()).alias("extra"), F.count_if(F.col("count").isNull()).alias("lost"), F.count_if(F.col("count") > 1).alias("repeated")).first()
    if any(both):
        raise ValidationError(f"labels do not match subjects: {both.asDict()}")
    return labels


def alignment(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per table: rows, distinct keys, and keys of the union that it lacks. One pass over a union."""
    long = None
    for name, df in tables.items():
        part = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        long = part if long is None else long.unionByName(part)
    wide = long.groupBy(key).pivot("table", list(tables)).agg(F.sum("n"))
    stats = [F.struct(F.lit(t).alias("table"), F.coalesce(F.sum(t), F.lit(0)).alias("rows"), F.count(t).alias("keys"), F.count_if(F.col(t).isNull()).alias("missing")) for t in tables]
    return wide.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def is_aligned(tables: Mapping[str, DataFrame], key: str) -> bool:
    return all(r["missing"] == 0 and r["rows"] == r["keys"] for r in alignment(tables, key).collect())


def min_length(df: DataFrame, arr: str, n: int) -> DataFrame:
    return df.filter(F.size(arr) >= n)


def window_count(key: str) -> Column:
    return F.count("*").over(W.partitionBy(key))
