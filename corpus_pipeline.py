"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Language ID drops texts that are in none of the corpus's languages; exact dedup keeps one row of equal
texts; near dedup keeps one document of each group of near copies; decontamination drops documents that
overlap test items; mixing puts what is left into training order, a row for each pass over a document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import shared_dir, table
from tidemark.llm.stages import STAGES


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs


#: Language identification is not expressible in SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None
