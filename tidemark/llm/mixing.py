"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Targets come from a water-filling of the sources' weights under a repetition limit. A document's offset
in its source is a prefix sum over documents in the order of md5(id), built in two levels (leading
hex digits of md5, then inside each such bucket), so that no task holds a whole source. A source's
weight at time t in [0, 1] is ``a + (b - a) t``; its integral says how many words the source has given
by t, and the inverse of that gives the time, the training position, of any of its words.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, send_if_small, table, word_count

#: (start, end) of the weight of sources by rank, repeating: falls, stays, rises.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def _by_rank(rank: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """``totals`` (source, source_size) with rank and target. One row per source, so one window over all is small.

    With sources in the order of limit * size / weight, level k gives what is left to the sources from k
    on in proportion to weight; the level that fits is the largest that no source from k on exceeds.
    """
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("w", _by_rank(F.col("rank"), weights)).withColumn("cap", F.col("source_size") * float(limit))
    order = W.orderBy(F.col("cap") / F.col("w"), "rank")
    levels = ranked.select(
        "*",
        (F.sum("source_size").over(W.partitionBy()) * float(share)).alias("all_words"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)).alias("rest_w"),
    ).withColumn("level", (F.col("all_words") - F.col("capped")) / F.col("rest_w"))
    fits = F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(W.partitionBy())
    return levels.select("source", "rank", "source_size", F.least(F.coalesce(fits * F.col("w"), F.col("cap")), "cap").alias("target"))


def _time(share: Column, a: Column, b: Column) -> Column:
    """The t at which the integral of ``a + (b - a) t`` has reached ``share`` of its whole."""
    y = share * (a + b) / 2
    return F.when(F.abs(b - a) < 1e-12, y / a).otherwise((F.sqrt(F.greatest(a * a + 2 * (b - a) * y, F.lit(0.0))) - a) / (b - a))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    limit: float = 2.0,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, text_key, size, source_size, target, taken, offset, positions.

    ``taken`` counts words over all repeats; a source takes whole passes in md5 order and ends, in its
    last pass, at its target, where one document is cut. ``positions`` are the training times in [0, 1]
    at which the passes over this document begin (empty: not taken). A null source is a source of its
    own, last in rank; null and empty texts have size 0 and take nothing. Rows that repeat an identifier
    count each. Needs weights above 0 and schedules that stay at or above 0.
    """
    if min(weights) <= 0 or any(min(s) < 0 or max(s) <= 0 for s in schedules):
        raise ValueError("weights are above 0, schedules not below 0")
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_key"), word_count(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_md5")),
        "mix-sizes",
    )
    n = sized.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / 1024 + 1, 16)))
    rows = sized.withColumn("_bucket", F.substring("_md5", 1, digits)).withColumn("_key", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")))
    buckets = rows.groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"), F.first("source").alias("source"))
    before = F.coalesce(F.sum("_words").over(W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = buckets.select("_key", "_bucket", before.alias("_before"))
    totals = buckets.groupBy("_key").agg(F.sum("_words").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(totals.select("source", "source_size"), weights, share, limit)
    targets = targets.withColumn("_key", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))).drop("source")
    inside = W.partitionBy("_key", "_bucket").orderBy("_md5", "doc_id", "size", "text_key").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(starts, ["_key", "_bucket"]).withColumn("offset", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(targets, "_key")
    goal = F.floor("target")
    passes = math.ceil(limit)
    words_in = [F.greatest(F.lit(0), F.least("size", goal - F.col("source_size") * k - F.col("offset"))).cast("long") for k in range(passes)]
    a, b = (_by_rank(F.col("rank"), [s[i] for s in schedules]) for i in (0, 1))
    times = [F.when(taken > 0, _time((F.col("source_size") * k + F.col("offset")) / F.col("target"), a, b)) for k, taken in enumerate(words_in)]
    return placed.select("doc_id", "source", "text_key", "size", "source_size", "target", sum(words_in).alias("taken"), "offset", F.array_compact(F.array(*times)).alias("positions"))


def curriculum(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "mix_") -> DataFrame:
    """The documents in training order: a row for each pass over a document, with its mix_pass, its mix_position and
    mix_words, the words to take (fewer than its size where the target cuts it), range-sorted by position.

    ``mix`` is the result of ``mix_sources`` for ``docs``. Rows that repeat identifier and text have the passes of all of them,
    with the columns of the first row in the order of all columns. Documents that are not taken give no row. The
    other columns stay; ``prefix`` is for those that have one of the new names already."""
    own = {"pass": f"{prefix}pass", "position": f"{prefix}position", "words": f"{prefix}words"}
    if set(own.values()) & set(docs.columns):
        raise ValueError(f"docs has one of the columns {sorted(own.values())}; choose another prefix")
    passes = mix.filter("taken > 0").select(F.struct(F.col("doc_id").alias("id"), "text_key").alias("key"), "size", "taken", F.posexplode("positions").alias("pass", "position"))
    plan = passes.select("key", "pass", "position", F.least("size", F.col("taken") - F.col("pass") * F.col("size")).alias("words"))
    rows = docs.select(F.struct("*").alias("row")).withColumn("key", F.struct(F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(f"row.`{text_col}`").alias("text_key")))
    again = materialize(mix.groupBy(F.struct(F.col("doc_id").alias("id"), "text_key").alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated-rows")
    if again.count():
        again = send_if_small(again, "repeated-rows")
        rows = rows.join(again, "key", "left_anti").unionByName(rows.join(again, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row")))
    joined = rows.join(plan, "key").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *[F.col(c).alias(name) for c, name in own.items()])
    return joined.repartitionByRange(own["position"], id_col).sortWithinPartitions(own["position"], id_col)


def op7_mix_sources(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    nth = lambda k: F.get("positions", F.lit(k))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", nth(0).alias("position"), nth(1).alias("second_position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s
), w AS (
  SELECT *, CAST([5, 2, 1][1 + rank % 3] AS DOUBLE) AS w, CAST(2 AS DOUBLE) * source_size AS cap,
         CAST([1.5, 1.0, 0.5][1 + rank % 3] AS DOUBLE) AS a, CAST([0.5, 1.0, 1.5][1 + rank % 3] AS DOUBLE) AS b FROM r
), l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, a, b, least(coalesce(max(CASE WHEN level <= cap / w THEN level END) OVER () * w, cap), cap) AS target FROM l
), o AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d
), p AS (
  SELECT doc_id, size, source_size, target, a, b, off,
         greatest(0, least(size, CAST(floor(target) AS BIGINT) - off)) AS k1,
         greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - off)) AS k2,
         off / target * (a + b) / 2 AS y1, (source_size + off) / target * (a + b) / 2 AS y2
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(k1 + k2 AS BIGINT) AS taken,
       CASE WHEN k1 > 0 THEN CASE WHEN abs(b - a) < 1e-12 THEN y1 / a ELSE (sqrt(greatest(a * a + 2 * (b - a) * y1, 0)) - a) / (b - a) END END AS position,
       CASE WHEN k2 > 0 THEN CASE WHEN abs(b - a) < 1e-12 THEN y2 / a ELSE (sqrt(greatest(a * a + 2 * (b - a) * y2, 0)) - a) / (b - a) END END AS second_position
FROM p
"""
