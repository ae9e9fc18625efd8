"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and works on all rows of ``docs``.

All but the last return rows of ``docs`` unchanged, with the same columns. Columns that a stage does not name are carried,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_ROWS, lower_ascii, materialize, send_if_small, table
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.language_id import UND, fit, identify, least_score
from tidemark.llm.mixing import curriculum, mix_sources
from tidemark.llm.simhash import near_duplicates


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``docs`` is labelled with.

    Texts without a letter (null and empty ones too) go, and those whose score is below ``least_score``, a bound
    fitted on all labelled texts and random letters; rows are written with their scores, so that texts are scored once.
    The decision is per row; without labelled texts all rows go.
    """
    rows, names = docs.select(F.struct("*").alias("row")), docs.columns
    model = fit(docs)
    found = identify(rows, model, id_col="row", text_col="row.text")
    least = 0.0
    if model:
        found = materialize(found, "languages", BATCH_ROWS)
        labelled = F.col("row.lang").isNotNull() & F.col("row.text").rlike(r"\p{L}")
        least = least_score(docs, model, scored=found.filter(labelled).select("score"))
    return found.filter((F.col("lang_pred") != UND) & (F.col("score") >= least)).select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null counts as empty) the row with the largest id; of rows that repeat id and
    text, one: the first in the order of all columns. Null ids lose to others."""
    groups = exact_dedup(docs, keep="largest").groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    odd = groups.filter(~F.col("kept") | (F.col("n") > 1)).select(F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias("key"), "kept")
    odd = send_if_small(odd, "copies")
    key = F.struct(F.col("row.doc_id").alias("id"), F.sha2(lower_ascii(F.coalesce("row.text", F.lit(""))), 256).alias("sha"))
    rows = docs.select(F.struct("*").alias("row")).withColumn("key", key)
    marked = rows.join(odd, "key", "left")
    once = marked.filter("kept").groupBy("key").agg(F.min("row").alias("row"))
    left = marked.filter("kept is null").select("row").unionByName(once.select("row"))
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; documents without an id stay. Rows that repeat an
    id stay or go together."""
    groups = near_duplicates(docs)
    gone = send_if_small(groups.filter("doc_id <> component_id").select("doc_id"), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no test item of ``benchmark``. Null and empty texts overlap none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order: a row for each pass over a document, with the columns mix_pass, mix_position and
    mix_words (words to take). Documents without words, and those that the mix does not take, have none."""
    return curriculum(docs, mix_sources(docs))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
