"""Event-stream datasets: extraction, time merging, splits, fitted vocabularies and normalisers, representations.

Tables: subjects (subject_id, static columns), events (event_id, subject_id, timestamp, event_type) and
measurements (measurement_id, event_id, subject_id, timestamp, columns): they carry their event's subject and time, so that
merging and aggregating them needs no join. Fitted state is small tables, one row for each key or element.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, FloatType, LongType, NumericType, StringType, StructField, StructType, TimestampType

from tidemark.functions import scalars as S
from tidemark.functions.encodings import number_rows
from tidemark.operators.filters import include
from tidemark.operators.joins import as_of
from tidemark.operators.segments import MOST, Running
from tidemark.operators.windows import UNITS, summarize_over_window
from tidemark.sources.schema import DatasetSchema, InputSchema
from tidemark.sources.shared import materialize

UNK = "UNK"


@dataclass(frozen=True)
class Measurement:
    """A measured column. ``modality``: single_label, multi_label, univariate_regression (values only) or
    multivariate_regression (keys in the column, values in ``values_column``). ``modifiers``: columns that go with each measurement."""

    name: str
    temporality: str = "dynamic"
    modality: str = "single_label"
    values_column: str | None = None
    modifiers: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "modifiers", tuple(self.modifiers))  # a saved one comes back as a list
        if self.temporality not in ("static", "functional", "dynamic"):
            raise ValueError(self.temporality)
        if (self.modality == "multivariate_regression") != (self.values_column is not None):
            raise ValueError("multivariate measures, and only they, have a values column")


# Extraction ----------------------------------------------------------------------------------------------


def _select(schema: InputSchema, which: str = "columns") -> list[Column]:
    casts = {"float": "float", "integer": "long", "boolean": "boolean"}
    out = []
    for src, (name, kind) in schema.names(which).items():
        if isinstance(kind, (tuple, list)):
            out.append(F.try_to_timestamp(F.col(src), F.lit(kind[1])).alias(name))
        elif kind in casts:
            out.append(F.col(src).try_cast(casts[kind]).alias(name))
        else:
            out.append(F.col(src).cast("timestamp" if kind == "timestamp" else "string").alias(name))
    return out


def build_subjects(schema: InputSchema) -> DataFrame:
    df = include(schema.source, schema.must_have) if schema.must_have else schema.source
    return df.select(F.col(schema.subject_id_col).cast("long").alias("subject_id"), *_select(schema))


def _time(c: Column, fmt: str | None) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else c.cast("timestamp")


def _source(schema: InputSchema) -> DataFrame:
    return include(schema.source, schema.must_have) if schema.must_have else schema.source


def _rows(schema: InputSchema, together: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """(subject_id, timestamp, event_type, measured columns) of one source, a row for each of its rows' times, and the names of the measured
    columns. ``together``: subject_id, with timestamp or without, whose rows are brought into one task each; subjects alone before a
    range becomes two rows."""
    df, subject = _source(schema), F.col(schema.subject_id_col).cast("long").alias("subject_id")
    both = [n for n, _ in schema.names().values()]
    gather = lambda d, now: d.filter("subject_id is not null").repartition(*together) if together and now else d
    if schema.kind == "event":
        cols = [schema.ts_col] if isinstance(schema.ts_col, str) else list(schema.ts_col)
        when = S.earliest(*[_time(F.col(c), schema.ts_format) for c in cols])
        kind = F.col(schema.event_type[4:]).cast("string") if schema.event_type.startswith("COL:") else F.lit(schema.event_type)
        rows, names = gather(df.select(subject, when.alias("timestamp"), kind.alias("event_type"), *_select(schema)), True), both
    else:
        eq, start, end = schema.range_types()
        first, last = [n for n, _ in schema.names("start_columns").values()], [n for n, _ in schema.names("end_columns").values()]
        s, e = _time(F.col(schema.start_col), schema.ts_format), _time(F.col(schema.end_col), schema.ts_format)
        wide = df.select(subject, s.alias("_s"), e.alias("_e"), *_select(schema), *_select(schema, "start_columns"), *_select(schema, "end_columns"))
        ends = F.when(F.col("_s") == F.col("_e"), F.array(F.struct(F.col("_s").alias("t"), F.lit(eq).alias("k"), F.lit(True).alias("a"), F.lit(True).alias("b"))))
        ends = ends.when(F.col("_s") < F.col("_e"), F.array(F.struct(F.col("_s").alias("t"), F.lit(start).alias("k"), F.lit(True).alias("a"), F.lit(False).alias("b")), F.struct(F.col("_e").alias("t"), F.lit(end).alias("k"), F.lit(False).alias("a"), F.lit(True).alias("b"))))
        long = gather(wide, "timestamp" not in together).withColumn("_p", F.explode(ends))
        only = [F.when(F.col("_p.a"), F.col(c)).alias(c) for c in first if c not in last] + [F.when(F.col("_p.b"), F.col(c)).alias(c) for c in last if c not in first]
        rows = gather(long.select("subject_id", F.col("_p.t").alias("timestamp"), F.col("_p.k").alias("event_type"), *both, *only), "timestamp" in together)
        names = [*both, *[c for c in dict.fromkeys(first + last) if c in first or c in last]]
    return rows.dropna(subset=["subject_id", "timestamp"]), names


def extract_events(schema: InputSchema) -> tuple[DataFrame, DataFrame]:
    """Events and measurements of one event or range source. Rows without time or subject go; equal rows count once.

    A range with equal ends is one event, one with start < end is a start and an end event, others go."""
    known, names = _rows(schema)
    event_id = F.xxhash64("subject_id", F.unix_micros("timestamp"), "event_type").alias("event_id")
    events = known.select("subject_id", "timestamp", "event_type").distinct().select(event_id, "subject_id", "timestamp", "event_type")
    some = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names]) if names else F.lit(False)
    own = known.filter(some).select("subject_id", "timestamp", "event_type", *names).distinct().select(event_id, "subject_id", "timestamp", *names)
    return events, own.withColumn("measurement_id", F.xxhash64("event_id", *names))


def large_subjects(schema: InputSchema, most: int = MOST) -> DataFrame:
    """(subject_id, _n): the subjects of a source that have more than ``most`` rows when each of its rows gives all the rows it can (two for
    a range), and their number. Only subjects are read, and what is written has a row for each large one."""
    subject = F.col(schema.subject_id_col).cast("long").alias("subject_id")
    sizes = _source(schema).select(subject).groupBy("subject_id").agg((F.count("*") * (1 if schema.kind == "event" else 2)).alias("_n"))
    return materialize(sizes.filter(F.col("subject_id").isNotNull() & (F.col("_n") > most)), "large-subjects")


def extract(schema: DatasetSchema) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subjects, events, measurements) of all sources."""
    parts = [extract_events(s) for s in schema.dynamic]
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return build_subjects(schema.static), union([e for e, _ in parts]).distinct(), union([m for _, m in parts])


def agg_by_time(events: DataFrame, measurements: DataFrame, scale: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge a subject's events at equal times or, with a scale such as ``1h``, in buckets that start at its first event.
    The merged type joins the sorted distinct types with ``&``; measurements move to the merged event."""
    def bucketed(rows):
        if scale is None:
            return rows
        every = int(scale[:-1]) * UNITS[scale[-1]]
        at = F.unix_micros("timestamp")
        return rows.join(first, "subject_id").withColumn("timestamp", F.timestamp_micros(F.col("_first") + F.floor((at - F.col("_first")) / every) * every)).drop("_first")

    first = events.groupBy("subject_id").agg(F.min(F.unix_micros("timestamp")).alias("_first")) if scale is not None else None
    event_id = F.xxhash64("subject_id", F.unix_micros("timestamp"))
    types = F.array_distinct(F.flatten(F.collect_set(F.split("event_type", "&"))))
    merged = bucketed(events).groupBy("subject_id", "timestamp").agg(F.array_join(F.array_sort(types), "&").alias("event_type"))
    return merged.select(event_id.alias("event_id"), "subject_id", "timestamp", "event_type"), bucketed(measurements).withColumn("event_id", event_id)


#: Plug-ins of time-dependent features: name -> (static columns needed, expression of the event time and those columns).
FUNCTORS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "age": (("birth_date",), lambda ts, birth: S.age_years(birth, ts)),
    "time_of_day": ((), S.time_of_day),
}


def register_functor(name: str, static: Sequence[str], expression: Callable[..., Column]) -> None:
    FUNCTORS[name] = (tuple(static), expression)


def add_functors(events: DataFrame, subjects: DataFrame, names: Sequence[str], timestamp: str = "timestamp") -> DataFrame:
    need = list(dict.fromkeys(c for n in names for c in FUNCTORS[n][0]))
    rows = events.join(subjects.select("subject_id", *need), "subject_id", "left") if need else events
    made = {n: FUNCTORS[n][1](F.col(timestamp), *[F.col(c) for c in FUNCTORS[n][0]]) for n in names}
    return rows.withColumns(made).drop(*need)


# Splits --------------------------------------------------------------------------------------------------


def hash_rank(df: DataFrame, key: str, seed: int, name: str = "rank") -> DataFrame:
    """Rank from 0 in the order of a hash, in two levels: by the hash's leading 12 bits, then inside each such bucket."""
    rows = df.withColumn("_h", S.portable_hash(key, seed)).withColumn("_b", F.shiftright("_h", 20))
    counts = rows.groupBy("_b").count()  # 4,096 rows at most
    before = F.coalesce(F.sum("count").over(W.partitionBy().orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_b", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("_b").orderBy("_h", key)) - 1
    return rows.withColumn("_in", inside).join(F.broadcast(offsets), "_b").withColumn(name, F.col("_before") + F.col("_in")).drop("_h", "_b", "_in", "_before")


def split_subjects(subjects: DataFrame, fractions: Sequence[float], names: Sequence[str] | None = None, seed: int = 1, mandatory: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(subject_id, split). Fractions may sum to less than 1: the rest is one more split. Mandatory ids go to their
    split first; the rest are ranked by a hash and cut at rounded cumulative shares."""
    fractions = list(fractions)
    if not 0 < sum(fractions) <= 1 + 1e-9 or min(fractions) <= 0:
        raise ValueError("fractions are above 0 and sum to at most 1")
    if sum(fractions) < 1 - 1e-9:
        fractions.append(1 - sum(fractions))
    names = list(names) if names else (["train", "tuning", "held_out"][: len(fractions)] if len(fractions) <= 3 else [f"split_{i}" for i in range(len(fractions))])
    if len(names) != len(fractions):
        raise ValueError("as many names as splits")
    ids = subjects.select("subject_id").distinct()
    fixed = None
    for name, df in (mandatory or {}).items():
        part = df.select("subject_id", F.lit(name).alias("split"))
        fixed = part if fixed is None else fixed.unionByName(part)
    if fixed is not None:
        fixed = fixed.join(ids, "subject_id", "left_semi")
        ids = ids.join(fixed, "subject_id", "left_anti")
    n = ids.count()
    total, split = 0.0, None
    for name, f in zip(names, fractions, strict=True):
        total += f
        cond = F.col("rank") < round(total * n)
        split = F.when(cond, name) if split is None else split.when(cond, name)
    out = hash_rank(ids, "subject_id", seed).select("subject_id", split.otherwise(names[-1]).alias("split"))
    return out if fixed is None else out.unionByName(fixed)


def split_view(tables: Mapping[str, DataFrame], splits: DataFrame, name: str) -> dict[str, DataFrame]:
    """subjects, events and measurements of one split."""
    ids = splits.filter(F.col("split") == name).select("subject_id")
    events = tables["events"].join(ids, "subject_id", "left_semi")
    return {"subjects": tables["subjects"].join(ids, "subject_id", "left_semi"), "events": events, "measurements": tables["measurements"].join(ids, "subject_id", "left_semi")}


# Fit -----------------------------------------------------------------------------------------------------


def observation_rates(df: DataFrame, unit: str, measures: Sequence[str]) -> DataFrame:
    """(measure, possible, observed, total) for all measures from one aggregate over the table."""
    n = F.count_distinct(unit)
    stats = [F.struct(F.lit(m).alias("measure"), n.alias("possible"), F.count_distinct(F.when(F.col(m).isNotNull(), F.col(unit))).alias("observed"), F.count(m).alias("total")) for m in measures]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def keep_measures(rates: DataFrame, least: float) -> list[str]:
    """Names of the measures observed in at least this share (or number) of units."""
    return [r["measure"] for r in rates.collect() if r["observed"] and not S.below_cutoff(r["observed"], least, r["possible"])]


def fit_numeric(
    df: DataFrame, key: str, value: str, min_key: float = 1, integer_share: float = 0.9, categorical_below: int = 5, outlier_c: float | None = 5.0, bounds: DataFrame | None = None
) -> DataFrame:
    """One row per key: value_type (integer, float, categorical_integer, categorical_float, dropped), thresholds, mean, std.

    Rare keys are dropped; values are dropped or censored by ``bounds`` (key and bound columns); whole values make
    an integer; few distinct values make a category; inliers lie strictly between mean -+ c std; mean
    and std are those of inliers."""
    rows = df.filter(F.col(key).isNotNull()).select(F.lit("").alias("measure"), F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    limits = bounds.withColumn("measure", F.lit("")) if bounds is not None else None
    return fit_numeric_long(rows, min_key, integer_share, categorical_below, outlier_c, limits).drop("measure")


def fit_numeric_long(rows: DataFrame, min_key: float = 1, integer_share: float = 0.9, categorical_below: int = 5, outlier_c: float | None = 5.0, bounds: DataFrame | None = None) -> DataFrame:
    """``fit_numeric`` for the keys of all measures at once: (measure, key, value) to a row for each measure and key."""
    both = ["measure", "key"]
    if bounds is not None:
        limits = [c for c in bounds.columns if c not in both]
        rows = rows.join(bounds, both, "left").withColumn("value", S.drop_or_censor("value", **{c: F.col(c) for c in limits})).drop(*limits)
    ok = F.col("value").isNotNull() & ~F.isnan("value")
    x = F.when(ok, F.col("value"))
    whole = F.avg(F.when(ok, (F.col("value") == F.round("value")).cast("double")))
    seen = rows.groupBy(*both).agg(F.count("*").alias("n"), F.count(x).alias("n_values"), whole.alias("share"), F.count_distinct(x).alias("d"), F.count_distinct(F.round(x)).alias("d_round"))
    totals = seen.groupBy(F.col("measure").alias("_m")).agg(F.sum("n").alias("total"))
    seen = seen.join(totals, F.col("measure") == F.col("_m")).drop("_m")
    rare = F.col("n") < S.count_or_share(F.col("total"), F.lit(float(min_key)))
    integer = F.col("share") > integer_share
    few = F.when(integer, F.col("d_round")).otherwise(F.col("d")) < categorical_below
    kind = F.when(rare | (F.col("n_values") == 0), "dropped").when(integer & few, "categorical_integer").when(few, "categorical_float").when(integer, "integer").otherwise("float")
    types = seen.select(*both, kind.alias("value_type"))
    numeric = rows.filter(ok).join(types.filter("value_type in ('integer', 'float')"), both).withColumn("value", F.when(F.col("value_type") == "integer", F.round("value")).otherwise(F.col("value")))
    stats = numeric.groupBy(*both).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    if outlier_c is not None:
        stats = stats.select(*both, (F.col("m") - outlier_c * F.col("s")).alias("thresh_low"), (F.col("m") + outlier_c * F.col("s")).alias("thresh_high"))
        inlier = numeric.join(stats, both).filter("thresh_low is null or (value > thresh_low and value < thresh_high)")
        stats = stats.join(inlier.groupBy(*both).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")), both, "left")
    else:
        none = F.lit(None).cast("double")
        stats = stats.select(*both, none.alias("thresh_low"), none.alias("thresh_high"), F.col("m").alias("mean"), F.col("s").alias("std"))
    return types.join(stats, both, "left")


def transform_numeric(df: DataFrame, key: str, value: str, meta: DataFrame, normalise: bool = True, bounds: DataFrame | None = None) -> DataFrame:
    """Apply ``fit_numeric``: categorical values move into the key (``key__EQ_value``) and become NaN, as do dropped
    values and outliers; integers are rounded; others are centred and scaled. Adds ``<value>_is_inlier`` (null without a numeric value)."""
    m = meta.select(F.col("key").alias("_k"), "value_type", "thresh_low", "thresh_high", "mean", "std")
    rows = df.join(m, F.col(key) == F.col("_k"), "left").withColumn("_v", F.col(value).cast("double"))
    if bounds is not None:
        limits = [c for c in bounds.columns if c != "key"]
        rows = rows.join(bounds.withColumnRenamed("key", "_b"), F.col(key) == F.col("_b"), "left").withColumn("_v", S.drop_or_censor("_v", **{c: F.col(c) for c in limits})).drop("_b", *limits)
    nan, kind = F.lit(float("nan")), F.col("value_type")
    has = F.col("_v").isNotNull() & ~F.isnan("_v")
    whole = kind.isin("integer", "categorical_integer")
    rows = rows.withColumn("_v", F.when(has & whole, F.round("_v")).otherwise(F.col("_v")))
    shown = F.when(whole, F.col("_v").cast("long").cast("string")).otherwise(F.col("_v").cast("string"))
    new_key = F.when(has & kind.isin("categorical_integer", "categorical_float"), S.key_value_name(key, shown)).otherwise(F.col(key))
    numeric = kind.isin("integer", "float")
    inlier = F.when(has & numeric, F.col("thresh_low").isNull() | ((F.col("_v") > F.col("thresh_low")) & (F.col("_v") < F.col("thresh_high"))))
    scaled = (F.col("_v") - F.col("mean")) / F.when(F.coalesce(F.col("std"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("std")) if normalise else F.col("_v")
    out = F.when(F.col("_v").isNull(), F.lit(None).cast("double")).when(inlier, scaled).otherwise(nan)
    rows = rows.withColumn("_key", new_key).withColumn("_out", out).withColumn(f"{value}_is_inlier", inlier)
    return rows.withColumn(key, F.col("_key")).withColumn(value, F.col("_out")).drop("_k", "_v", "_key", "_out", "value_type", "thresh_low", "thresh_high", "mean", "std")


def denormalise(df: DataFrame, key: str, value: str, meta: DataFrame) -> DataFrame:
    m = meta.select(F.col("key").alias("_k"), "mean", "std")
    rows = df.join(m, F.col(key) == F.col("_k"), "left")
    return rows.withColumn(value, F.col(value) * F.when(F.coalesce(F.col("std"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("std")) + F.col("mean")).drop("_k", "mean", "std")


def fit_vocabulary(df: DataFrame, element: str, measure: str | None = None) -> DataFrame:
    """(measure, element, count, freq, idx): UNK is 0, then elements by falling frequency, equal ones by falling name."""
    counts = df.filter(F.col(element).isNotNull()).groupBy(F.col(element).cast("string").alias("element")).count()
    return rank_vocabulary(counts, measure or element)


def rank_vocabulary(counts: DataFrame, measure: str) -> DataFrame:
    """``counts`` (element, count) numbered as in ``fit_vocabulary``, by ranges, so a vocabulary may be of any size."""
    order = [F.desc("count"), F.desc("element")]
    ranked = number_rows(counts.filter(F.col("element") != UNK).select("element", "count"), order, "idx", 1)
    sums = counts.agg(F.coalesce(F.sum(F.when(F.col("element") == UNK, F.col("count"))), F.lit(0)).alias("count"), F.sum("count").alias("_all"))
    unk = sums.select(F.lit(UNK).alias("element"), "count", F.lit(0).cast("long").alias("idx"))
    every = ranked.unionByName(unk).join(F.broadcast(sums.select("_all")))  # one row
    return every.select(F.lit(measure).alias("measure"), "element", "count", F.try_divide(F.col("count"), F.col("_all")).alias("freq"), F.col("idx").cast("int").alias("idx"))


def filter_vocabulary(vocab: DataFrame, least: float, measure: str) -> DataFrame:
    """Elements below a count or share lose their place and their mass goes to UNK."""
    total = vocab.agg(F.sum("count")).first()[0] or 0
    cut = S.count_or_share(int(total), least)
    element = F.when((F.col("count") < cut), UNK).otherwise(F.col("element"))
    return rank_vocabulary(vocab.groupBy(element.alias("element")).agg(F.sum("count").alias("count")), measure)


def transform_categorical(df: DataFrame, c: str, vocab: DataFrame, value: str | None = None) -> DataFrame:
    """Null stays null, elements outside the vocabulary become UNK and their values NaN."""
    v = vocab.select(F.col("element").alias("_e"))
    rows = df.join(v, F.col(c).cast("string") == F.col("_e"), "left")
    lost = F.col(c).isNotNull() & F.col("_e").isNull()
    if value:
        rows = rows.withColumn(value, F.when(lost & F.col(value).isNotNull(), F.lit(float("nan"))).otherwise(F.col(value)))
    return rows.withColumn(c, F.when(lost, UNK).otherwise(F.col(c))).drop("_e")


def unify(vocabs: Sequence[DataFrame]) -> DataFrame:
    """All vocabularies with measurement_index (from 1, by name) and global_idx = offset + idx; 0 is padding, offsets start at 1."""
    all_ = reduce(lambda a, b: a.unionByName(b), vocabs)
    sizes = all_.groupBy("measure").agg(F.count("*").alias("size"))
    w = W.partitionBy().orderBy("measure")  # one row for each measure
    placed = sizes.select("measure", F.row_number().over(w).alias("measurement_index"), (F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).alias("offset"))
    return all_.join(F.broadcast(placed), "measure").withColumn("global_idx", F.col("offset") + F.col("idx"))


# Representations -----------------------------------------------------------------------------------------


def melt(df: DataFrame, ids: Sequence[str], measures: Sequence[Measurement], vocab: DataFrame) -> DataFrame:
    """(ids, measurement_index, index, value): one row for each measure that is present."""
    items = []
    for m in measures:
        c = F.col(m.name)
        if m.modality == "univariate_regression":
            items.append(F.when(c.isNotNull(), F.struct(F.lit(m.name).alias("measure"), F.lit(m.name).alias("element"), c.cast("double").alias("value"))))
        else:
            value = F.col(m.values_column).cast("double") if m.values_column else F.lit(None).cast("double")
            items.append(F.when(c.isNotNull(), F.struct(F.lit(m.name).alias("measure"), c.cast("string").alias("element"), value.alias("value"))))
    long = df.select(*ids, F.explode(F.array_compact(F.array(*items))).alias("_m")).select(*ids, "_m.*")
    v = vocab.select("measure", "element", "measurement_index", F.col("global_idx").alias("index"))
    return long.join(v, ["measure", "element"]).select(*ids, "measurement_index", "index", "value")


def sequences(subjects: DataFrame, events: DataFrame, static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """One row per subject: start_time, time (minutes since the start), time_delta (to the next, NaN at the end), static and per-event
    ragged arrays. ``static``: (subject_id, measurement_index, index); ``dynamic``: (event_id, measurement_index, index, value)."""
    entry = F.struct("measurement_index", "index", "value")
    per_event = dynamic.groupBy("event_id").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    empty = F.array().cast(per_event.schema["m"].dataType)
    rows = events.join(per_event, "event_id", "left").withColumn("m", F.coalesce("m", empty))
    at = F.unix_micros("timestamp")
    per = rows.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("t"), "event_id", "m"))).alias("e"))
    t0 = F.element_at("e", 1)["t"]
    time = F.transform("e", lambda x: (x["t"] - t0) / 60e6)
    nxt = F.transform("e", lambda x, i: F.coalesce((F.get(F.col("e"), i + 1)["t"] - x["t"]) / 60e6, F.lit(float("nan"))))
    per = per.select(
        "subject_id", F.timestamp_micros(t0).alias("start_time"), time.alias("time"), nxt.alias("time_delta"),
        F.transform("e", lambda x: F.transform(x["m"], lambda y: y["measurement_index"])).alias("dynamic_measurement_indices"),
        F.transform("e", lambda x: F.transform(x["m"], lambda y: y["index"])).alias("dynamic_indices"),
        F.transform("e", lambda x: F.transform(x["m"], lambda y: y["value"])).alias("dynamic_values"),
    )
    fixed = static.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("measurement_index", "index"))).alias("s"))
    fixed = fixed.select("subject_id", F.transform("s", lambda x: x["measurement_index"]).alias("static_measurement_indices"), F.transform("s", lambda x: x["index"]).alias("static_indices"))
    return subjects.select("subject_id").join(fixed, "subject_id", "left").join(per, "subject_id", "left")


def nested_schema(tables: Mapping[str, DataFrame], measures: Sequence[Measurement]) -> StructType:
    """The declared schema of nested documents: (patient_id, static_measurements, events (time, measurements)), a measurement being (code,
    numeric_value, text_value, datetime_value, modifiers). ``modifiers`` has the modifier columns of all measures, sorted by name,
    in the types of their sources (text for others than numbers, booleans, dates and times); without any there is no such field."""
    found: dict[str, DataType] = {}
    for m in measures:
        source = tables[{"static": "subjects", "functional": "events", "dynamic": "measurements"}[m.temporality]]
        for c in m.modifiers:
            if c not in source.columns:
                raise ValueError(f"{m.name} has no modifier column {c}")
            kind = source.schema[c].dataType
            kind = kind if isinstance(kind, (NumericType, BooleanType, DateType, TimestampType)) else StringType()
            if found.setdefault(c, kind) != kind:
                raise ValueError(f"modifier {c} has two types")
    fields = [StructField("code", StringType()), StructField("numeric_value", FloatType()), StructField("text_value", StringType()), StructField("datetime_value", TimestampType())]
    if found:
        fields.append(StructField("modifiers", StructType([StructField(c, found[c]) for c in sorted(found)])))
    many = ArrayType(StructType(fields))
    event = StructType([StructField("time", TimestampType()), StructField("measurements", many)])
    return StructType([StructField("patient_id", LongType()), StructField("static_measurements", many), StructField("events", ArrayType(event))])


def _nested_items(df: DataFrame, measures: Sequence[Measurement], item: StructType) -> Column:
    """The measurements of a row, conformed to the declared type. A value in ``text_value`` or ``datetime_value`` is that of a measure whose
    values column has text or times."""
    out, types = [], {f.name: f.dataType for f in df.schema}
    mods = item["modifiers"].dataType.names if "modifiers" in item.names else []
    for m in measures:
        c, alone = F.col(m.name), m.modality == "univariate_regression"
        v = c if alone else F.col(m.values_column) if m.values_column else F.lit(None)
        kind = types[m.name] if alone else types[m.values_column] if m.values_column else None
        where = "text_value" if isinstance(kind, StringType) else "datetime_value" if isinstance(kind, (TimestampType, DateType)) else "numeric_value"
        fields = {"code": F.lit(m.name) if alone else F.concat(F.lit(f"{m.name}/"), c.cast("string")), where: v}
        cols = [fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in item.fields if f.name != "modifiers"]
        if mods:
            cols.append(F.struct(*[(F.col(x) if x in m.modifiers else F.lit(None)).cast(item["modifiers"].dataType[x].dataType).alias(x) for x in mods]).alias("modifiers"))
        out.append(F.when(c.isNotNull(), F.struct(*cols)))
    return F.array_compact(F.array(*out)) if out else F.array().cast(ArrayType(item))


def nested_documents(subjects: DataFrame, events: DataFrame, measurements: DataFrame, measures: Sequence[Measurement]) -> DataFrame:
    """One nested document per subject, in the type of ``nested_schema``: static measurements, and events in time order with their type
    (``event_type/...``), functional and dynamic measurements, sorted. Events and measurements are one table grouped by subject, time
    and event, so they are not joined. A subject without events has an empty list; a subject of any size must fit a row."""
    tables = {"subjects": subjects, "events": events, "measurements": measurements}
    schema = nested_schema(tables, measures)
    item = schema["static_measurements"].dataType.elementType
    of = lambda kind: [m for m in measures if m.temporality == kind]
    at = ["subject_id", "timestamp", "event_id"]
    both = [df.select(*at, _nested_items(df, own, item).alias("m")) for df, own in ((events, [Measurement("event_type"), *of("functional")]), (measurements, of("dynamic")))]
    per_event = both[0].unionByName(both[1]).groupBy(*at).agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("measurements"))
    per = per_event.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct(F.col("timestamp").alias("time"), "measurements"))).alias("events"))
    fixed = subjects.select(F.col("subject_id").alias("patient_id"), _nested_items(subjects, of("static"), item).alias("static_measurements"))
    rows = fixed.join(per, F.col("patient_id") == F.col("subject_id"), "left")
    return rows.select(*[F.coalesce(F.col(f.name), F.array()).cast(f.dataType).alias(f.name) if f.name != "patient_id" else F.col("patient_id").cast("long") for f in schema.fields])


def feature_catalogue(vocab: DataFrame, measures: Sequence[Measurement], windows: Sequence[str] = (), least_freq: float | None = None) -> DataFrame:
    """(feature): names ``window/measure/feature/agg``, static and per-event ones (``static``, ``dynamic``) and one for each
    window; a row for each, made from the rows of the vocabulary."""
    rows = vocab.filter(F.col("element") != UNK)
    if least_freq is not None:
        rows = rows.filter(F.col("freq") >= least_freq)
    forms = None
    for m in measures:
        aggs = ["present"] if m.temporality == "static" else ["count"] if m.modality in ("single_label", "multi_label") else ["count", "has_values_count", "sum", "sum_sqd", "min", "max"]
        where = [m.temporality] if m.temporality == "static" else [m.temporality, *windows]
        own = F.array(*[F.struct(F.lit(w).alias("where"), F.lit(a).alias("agg")) for w in where for a in aggs])
        forms = F.when(F.col("measure") == m.name, own) if forms is None else forms.when(F.col("measure") == m.name, own)
    alone = [m.name for m in measures if m.modality == "univariate_regression"]
    features = rows.filter(~F.col("measure").isin(alone)).select("measure", "element") if alone else rows.select("measure", "element")
    if alone:
        names = F.explode(F.array(*map(F.lit, alone)))
        features = features.unionByName(vocab.sparkSession.range(1).select(names.alias("measure")).select("measure", F.col("measure").alias("element")))
    spread = features.select("measure", "element", F.explode(forms).alias("f"))
    return spread.select(F.concat_ws("/", "f.where", "measure", "element", "f.agg").alias("feature"))


def flat_static(subjects: DataFrame, c: str, values: Sequence[str]) -> DataFrame:
    return subjects.select("subject_id", *[F.when(F.col(c) == v, True).alias(f"static/{c}/{v}/present") for v in values])


def _flat_columns(m: Measurement, values: Sequence[str]) -> list[Column]:
    cols = []
    for v in values:
        hit = F.col(m.name) == v
        cols.append(F.count_if(hit).alias(f"dynamic/{m.name}/{v}/count"))
        if m.values_column:
            x = F.col(m.values_column).cast("double")
            ok = F.when(hit & x.isNotNull() & ~F.isnan(x), x)
            cols += [f.alias(f"dynamic/{m.name}/{v}/{a}") for a, f in (("has_values_count", F.count(ok)), ("sum", F.sum(ok)), ("sum_sqd", F.sum(ok * ok)), ("min", F.min(ok)), ("max", F.max(ok)))]
    return cols


def flat_dynamic(events: DataFrame, measurements: DataFrame, m: Measurement, values: Sequence[str]) -> DataFrame:
    """One row per event with ``dynamic/measure/feature/agg`` columns, in one aggregate."""
    need = [c for c in (m.name, m.values_column) if c]
    rows = measurements.select("subject_id", "timestamp", "event_id", *need).unionByName(events.select("subject_id", "timestamp", "event_id"), allowMissingColumns=True)
    return rows.groupBy("subject_id", "timestamp", "event_id").agg(*_flat_columns(m, values))


def flat_source(schema: InputSchema, m: Measurement, values: Sequence[str], large: DataFrame | None = None) -> DataFrame:
    """``flat_dynamic(*agg_by_time(*extract_events(schema)), m, values)`` in one exchange of the source's rows: an event's distinct rows, and
    those of its time, are in one task, so they need no further one. ``large`` (see ``large_subjects``): where it is empty, a
    subject is in one task as a whole, and windows over subjects need none either."""
    whole = large is not None and not large.limit(1).count()
    rows, names = _rows(schema, ["subject_id"] if whole else ["subject_id", "timestamp"])
    known = rows.select("subject_id", "timestamp", "event_type", *names).distinct()
    flat = known.groupBy("subject_id", "timestamp").agg(*_flat_columns(m, values))
    return flat.select("subject_id", "timestamp", F.xxhash64("subject_id", F.unix_micros("timestamp")).alias("event_id"), *[F.col(f"`{c}`") for c in flat.columns[2:]])


def normalise_columns(df: DataFrame, features: Sequence[str], ids: Sequence[str], zero_count_to_null: bool = False) -> DataFrame:
    """All features in order; missing ones are null; counts are longs (with the option, 0 is null), presence boolean, others double."""
    out = []
    for f in features:
        agg = f.rpartition("/")[2]
        kind = "long" if agg.endswith("count") else "boolean" if agg == "present" else "double"
        c = F.col(f"`{f}`") if f in df.columns else F.lit(None)
        c = c.cast(kind)
        out.append((F.when(c != 0, c) if zero_count_to_null and kind == "long" else c).alias(f))
    return df.select(*ids, *out)


_COMBINE = {"count": "sum", "has_values_count": "sum", "sum": "sum", "sum_sqd": "sum", "min": "min", "max": "max"}


def flat_windows(flat: DataFrame, windows: Sequence[str], key: str = "subject_id", ts: str = "timestamp", counted: DataFrame | None = None) -> DataFrame:
    """Per event, the flat features summed (least, greatest) over each window, named ``window/measure/feature/agg``. ``counted``: a table
    with a row at least for each event, whose subjects are cheaper to count, or their counts (``large_subjects``)."""
    feats = [c for c in flat.columns if c.startswith("dynamic/")]
    plain = flat.select(key, ts, *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(feats)])
    specs = [(f"f{i}", _COMBINE[c.rpartition("/")[2]]) for i, c in enumerate(feats)]
    wide = summarize_over_window(plain, key, ts, specs, windows, counted=counted)
    names = {f"{w}/f{i}/{a}": f"{w}/{feats[i].split('/', 1)[1]}" for w in windows for i, (_, a) in enumerate(specs)}
    return wide.select(key, ts, *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def load_flat(static: DataFrame, dynamic: DataFrame, windows: Mapping[str, DataFrame], tasks: DataFrame | None = None, key: str = "subject_id", ts: str = "timestamp", times: DataFrame | None = None, large: DataFrame | None = None) -> DataFrame:
    """Static, per-event and windowed features joined; with ``tasks`` (key, end_time, labels) only their last event at or
    before the end time, chosen before anything is joined. Counts without a value are 0. ``times``: (key, ts) of the rows of
    ``dynamic`` from a table that is cheaper to read. ``large``: (key, _n) of the subjects with very many of them, if they were counted."""
    rows = dynamic
    if tasks is not None:
        labels = [c for c in tasks.columns if c not in (key, "start_time", "end_time")]
        bounds = tasks.select(key, "end_time", *labels).distinct().withColumn("_at", F.coalesce(F.unix_micros(F.col("end_time").cast("timestamp")), F.lit(2**63 - 1)))
        events = (dynamic if times is None else times).select(key, F.col(ts).alias("_ts"), F.unix_micros(ts).alias("_at"))
        counted = large.select(key, "_n").unionByName(bounds.select(key, F.lit(1).cast("long").alias("_n"))) if large is not None else None
        keys = as_of(events, bounds, key, "_at", Running("_found", "last", F.col("_ts")), first="events", counted=counted)
        rows = dynamic.join(keys.filter("_found is not null").drop("_at").withColumnRenamed("_found", ts), [key, ts])
    for w in windows.values():
        rows = rows.join(w, [key, ts], "left")
    rows = rows.join(static, key, "left")
    return rows.fillna(0, [c for c in rows.columns if c.endswith("count")])


def mean_and_variance(flat: DataFrame) -> DataFrame:
    """Replace sum, sum_sqd and has_values_count by mean and variance."""
    out = []
    for c in flat.columns:
        base, _, agg = c.rpartition("/")
        if agg == "sum":
            out.append(F.try_divide(F.col(f"`{c}`"), F.col(f"`{base}/has_values_count`")).alias(f"{base}/mean"))
        elif agg == "sum_sqd":
            n = F.col(f"`{base}/has_values_count`")
            mean = F.try_divide(F.col(f"`{base}/sum`"), n)
            out.append((F.try_divide(F.col(f"`{c}`"), n) - mean * mean).alias(f"{base}/variance"))
        elif agg != "has_values_count":
            out.append(F.col(f"`{c}`"))
    return flat.select(*out)


def drop_empty(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop the columns that are null on every row, after one aggregate."""
    cols = [c for c in df.columns if c not in keep]
    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return df.drop(*[c for i, c in enumerate(cols) if n[f"c{i}"] == 0])


def describe(subjects: DataFrame, events: DataFrame, measurements: DataFrame, vocab: DataFrame, ends: int = 3) -> DataFrame:
    """(what, name, value): sizes, and each vocabulary's size, first and last elements."""
    sizes = [df.agg(F.count("*").alias("value")).select(F.lit("size").alias("what"), F.lit(n).alias("name"), F.col("value").cast("string").alias("value")) for n, df in (("subjects", subjects), ("events", events), ("measurements", measurements))]
    ordered = vocab.filter("idx > 0").groupBy("measure").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "element"))).alias("e"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x["element"]), ", ")
    parts = [ordered.select(F.lit(w).alias("what"), F.col("measure").alias("name"), v.alias("value")) for w, v in (("vocabulary", F.col("n").cast("string")), ("head", text(F.slice("e", 1, ends))), ("tail", text(F.slice("e", F.greatest(F.lit(1), F.size("e") - ends + 1), ends))))]
    return reduce(lambda a, b: a.unionByName(b), sizes + parts)


