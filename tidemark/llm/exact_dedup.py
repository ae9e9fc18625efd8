"""Exact deduplication by sorting content.

Texts are range-partitioned by sampled splitters (a prefix of the normalised bytes, a hash of all of
them, and the identifier, so that one group of copies of any size spreads over many partitions),
sorted externally inside each partition, and compared in full with their neighbours. A group that
meets a partition's edge, or is longer than ``run_rows`` or ``run_bytes``, is completed by a small aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_ROWS, lower_ascii, materialize, text_bytes

#: Groups that go on over the edge of a partition: up to so many, once counted, are sent to all tasks.
BROADCAST_GROUPS = 500_000
_RUNS = "{id} {kind}, text_sha256 string, run_size long, run_keep {kind}, first boolean, open boolean"


def _compare_neighbours(keep_largest: bool, run_rows: int, run_bytes: int, id_name: str):
    def sorted_rows(batches: Iterator):
        import pyarrow as pa

        kind = None
        key, edge, rows, held = None, True, [], 0  # rows: (text, id, first) of the texts with one hash, in order; equal texts are held once
        before = None  # the text and the id of the row before, if it has the same hash

        def flush(open_: bool):
            by_text: dict = {}
            for text, i, first in rows:
                by_text.setdefault(text, []).append((i, first))
            out = ([], [], [], [], [], [])
            for text, members in by_text.items():
                ids = [i for i, _ in members if i is not None]
                best = (max(ids) if keep_largest else min(ids)) if ids else None
                sha = hashlib.sha256(text).hexdigest()
                for i, first in members:
                    for column, value in zip(out, (i, sha, len(members), best, first, open_), strict=True):
                        column.append(value)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], kind), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], kind), pa.array(out[4], pa.bool_()), pa.array(out[5], pa.bool_())],
                names=[id_name, "text_sha256", "run_size", "run_keep", "first", "open"],
            )

        for batch in batches:
            kind = batch.column(0).type
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                if h != key:
                    if rows:
                        yield flush(edge)
                    edge = key is None  # the first may have begun in the partition before
                    key, before, held = h, None, 0
                same = before is not None and before[0] == text
                if same:
                    text = before[0]
                else:
                    held += len(text)
                rows.append((text, i, not same or before[1] != i))
                before = (text, i)
                if len(rows) >= run_rows or held >= run_bytes:
                    edge, held = True, 0
                    yield flush(True)
        if rows:
            yield flush(True)  # and the last may go on in the next

    return sorted_rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", run_rows: int = 65_536, run_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null counts as the empty text. Of equal texts
    the row with the smallest (``keep="largest"``: largest) identifier stays; of rows that repeat both
    text and identifier, one. Null identifiers lose to others; a group of only null identifiers keeps one
    row and has a null keep_id. Other columns are ignored. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    kind = docs.schema[id_col].dataType.simpleString()
    norm = docs.select(F.col(id_col), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("_norm"))
    keyed = norm.select(id_col, F.xxhash64("_norm").alias("_hash"), "_norm", F.substring("_norm", 1, 32).alias("_prefix"))
    ordered = keyed.repartitionByRange("_prefix", "_hash", id_col).sortWithinPartitions("_prefix", "_hash", "_norm", id_col)
    schema = _RUNS.format(id=f"`{id_col}`", kind=kind)
    runs = materialize(ordered.select(id_col, "_hash", "_norm").mapInArrow(_compare_neighbours(keep == "largest", run_rows, run_bytes, id_col), schema), "content-runs", BATCH_ROWS)
    best = F.max if keep == "largest" else F.min
    whole = runs.filter(~F.col("open")).select(id_col, F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), "first", "text_sha256")
    totals = materialize(runs.filter("open").groupBy("text_sha256").agg(best(id_col).alias("keep_id"), F.count("*").alias("group_size")), "open-groups")
    if totals.count() <= BROADCAST_GROUPS:  # two for each partition, and long groups: rows need not meet by text
        totals = F.broadcast(totals)
    joined = runs.filter("open").select(id_col, "first", "text_sha256").join(totals, "text_sha256").select(id_col, "keep_id", "group_size", "first", "text_sha256")
    return whole.unionByName(joined).select(
        id_col, "keep_id", F.col("group_size").cast("long"), (F.col("first") & F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256"
    )


def op10_exact_dedup(spark, sf_dir):
    from tidemark.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP10_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
