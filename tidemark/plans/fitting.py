"""Fitting of all measures of a dataset at once, on its train split.

Every measure is melted to rows (measure, unit, key, value) of one table, written once: dynamic measures from the measurements,
static ones from the subjects, functional ones from the events. Observation rates, value types, thresholds, normalisers and
vocabularies of all measures then come from a fixed number of aggregates over it, however many measures there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.encodings import number_rows
from tidemark.operators import eventstream as ES
from tidemark.sources.shared import materialize

#: Source table of a temporality, and its unit, of which a measure is observed in some.
SOURCES = {"dynamic": ("measurements", "event_id"), "static": ("subjects", "subject_id"), "functional": ("events", "event_id")}
KEPT, ABSENT, RARE, UNKNOWN = "kept", "absent", "rare", "unknown only"


@dataclass(frozen=True)
class Fitted:
    """``status`` (measure, status, possible, observed, total): status is kept, absent (no such column or no row), rare (observed in too few
    units) or unknown only (no element is frequent enough). ``numeric`` (measure, key, value_type, thresh_low, thresh_high,
    mean, std). ``vocabulary`` (measure, element, count, freq, idx). The last two have kept measures only."""

    status: DataFrame
    numeric: DataFrame
    vocabulary: DataFrame


def melt_measures(tables: Mapping[str, DataFrame], measures: Sequence[ES.Measurement]) -> tuple[DataFrame, DataFrame]:
    """((measure, unit, key, value), (measure, possible)): rows with a key, and the units of each measure's source."""
    parts, units = [], []
    for when, (name, unit) in SOURCES.items():
        df = tables.get(name)
        own = [m for m in measures if m.temporality == when and df is not None and m.name in df.columns]
        if not own:
            continue
        at = (F.col(unit) if unit in df.columns else F.monotonically_increasing_id()).cast("string")
        items = []
        for m in own:
            c = F.col(f"`{m.name}`")
            key = F.lit(m.name) if m.modality == "univariate_regression" else c.cast("string")
            value = c if m.modality == "univariate_regression" else F.col(f"`{m.values_column}`") if m.values_column else F.lit(None)
            items.append(F.when(c.isNotNull(), F.struct(F.lit(m.name).alias("measure"), key.alias("key"), value.cast("double").alias("value"))))
        parts.append(df.select(at.alias("unit"), F.explode(F.array_compact(F.array(*items))).alias("m")).select("m.measure", "unit", "m.key", "m.value"))
        n = df.agg((F.count_distinct(unit) if unit in df.columns else F.count("*")).alias("possible"))
        units.append(n.select(F.explode(F.array(*[F.lit(m.name) for m in own])).alias("measure"), "possible"))
    if not parts:
        raise ValueError("no measure has a source column")
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b), dfs)
    return union(parts), union(units)


def fit_measures(
    tables: Mapping[str, DataFrame], measures: Sequence[ES.Measurement], min_observed: float | None = None, min_key: float = 1, min_element: float | None = None,
    integer_share: float = 0.9, categorical_below: int = 5, outlier_c: float | None = 5.0, bounds: DataFrame | None = None,
) -> Fitted:
    """Fit on ``tables`` (subjects, events, measurements of the train split). Cutoffs below 1 are shares: ``min_observed`` of the units of a
    measure's source, ``min_key`` and ``min_element`` of its rows. ``bounds``: (measure, key, bound columns)."""
    melted, units = melt_measures(tables, measures)
    long = materialize(melted, "melted-measures")
    seen = long.groupBy("measure").agg(F.count_distinct("unit").alias("observed"), F.count("*").alias("total"))
    names = long.sparkSession.createDataFrame([(m.name,) for m in measures], "measure string")
    rates = names.join(units, "measure", "left").join(seen, "measure", "left").fillna(0, ["possible", "observed", "total"])
    rates = materialize(rates, "measure-rates")  # a row for each measure
    few = F.col("observed") < S.count_or_share(F.col("possible"), F.lit(float(min_observed))) if min_observed is not None else F.lit(False)
    rates = rates.withColumn("status", F.when(F.col("total") == 0, ABSENT).when(few, RARE).otherwise(KEPT))
    kept = [r["measure"] for r in rates.filter(F.col("status") == KEPT).collect()]  # a row for each measure
    numbers = [m.name for m in measures if m.modality.endswith("regression") and m.name in kept]
    rows = long.filter(F.col("measure").isin(kept))
    numeric = materialize(ES.fit_numeric_long(rows.filter(F.col("measure").isin(numbers)), min_key, integer_share, categorical_below, outlier_c, bounds), "numeric-fit")

    # Elements: keys, or key__EQ_value where values are categories. A single value that stays a number has no vocabulary.
    alone = [m.name for m in measures if m.modality == "univariate_regression"]
    kinds = numeric.select(F.col("measure").alias("_m"), F.col("key").alias("_k"), "value_type")
    typed = rows.join(kinds, (F.col("measure") == F.col("_m")) & (F.col("key") == F.col("_k")), "left")
    whole = F.col("value_type") == "categorical_integer"
    shown = F.when(whole, F.round("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    category = F.col("value_type").isin("categorical_integer", "categorical_float")
    has = F.col("value").isNotNull() & ~F.isnan("value")
    element = F.when(category & has, S.key_value_name("key", shown)).otherwise(F.col("key"))
    elements = typed.filter(~F.col("measure").isin(alone) | F.coalesce(category, F.lit(False))).select("measure", element.alias("element"))
    counts = elements.groupBy("measure", "element").agg(F.count("*").alias("count"))
    if min_element is not None:
        total = rates.select(F.col("measure").alias("_m"), "total")
        cut = S.count_or_share(F.col("total"), F.lit(float(min_element)))
        counts = counts.join(total, F.col("measure") == F.col("_m")).groupBy("measure", F.when(F.col("count") < cut, ES.UNK).otherwise(F.col("element")).alias("element")).agg(F.sum("count").alias("count"))
    vocabulary = materialize(_number(counts), "vocabularies")
    empty = vocabulary.groupBy("measure").agg(F.max("idx").alias("top")).filter("top = 0").select(F.col("measure").alias("_m"), F.lit(True).alias("_none"))
    status = rates.join(empty, F.col("measure") == F.col("_m"), "left").withColumn("status", F.when(F.col("_none"), UNKNOWN).otherwise(F.col("status"))).select("measure", "status", "possible", "observed", "total")
    lost = empty.select(F.col("_m").alias("measure"))
    return Fitted(status, numeric.join(lost, "measure", "left_anti"), vocabulary.join(lost, "measure", "left_anti"))


def _number(counts: DataFrame) -> DataFrame:
    """(measure, element, count, freq, idx) of all measures: UNK is 0, then by falling count and name. One global numbering, from which the
    first number of each measure is taken away."""
    ranked = number_rows(counts.filter(F.col("element") != ES.UNK).select("measure", "element", "count"), [F.col("measure").asc(), F.desc("count"), F.desc("element")], "_n")
    first = ranked.groupBy(F.col("measure").alias("_m")).agg(F.min("_n").alias("_first"))
    placed = ranked.join(first, F.col("measure") == F.col("_m")).select("measure", "element", "count", (F.col("_n") - F.col("_first") + 1).cast("int").alias("idx"))
    sums = counts.groupBy("measure").agg(F.coalesce(F.sum(F.when(F.col("element") == ES.UNK, F.col("count"))), F.lit(0)).alias("count"), F.sum("count").alias("all"))
    every = placed.unionByName(sums.select("measure", F.lit(ES.UNK).alias("element"), "count", F.lit(0).alias("idx")))
    return every.join(sums.select(F.col("measure").alias("_m"), "all"), F.col("measure") == F.col("_m")).select("measure", "element", "count", (F.col("count") / F.col("all")).alias("freq"), "idx")
