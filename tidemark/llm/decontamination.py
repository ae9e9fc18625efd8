"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

A seed hashes the words that a mask selects from consecutive positions and ignores the others, so a
substituted word under a zero does no harm. An item's masks depend on its number of words and are such that
some seed meets every way in which the item may differ and still overlap (tests enumerate them all). Seeds
of the documents join those of the test items; at each hit the item is laid over the document and its
words are compared one by one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, materialize, send_if_small, table

#: Masks for items of at least so many words, for windows of 16 words of which 0.8 agree. Shorter items may not differ at all.
MASKS = {12: ("101111", "1110011"), 5: ("1011", "1101")}
#: Rows of seeds of the test items, and words of all items, up to which they are sent to all tasks; larger tables go through a shuffle.
BROADCAST_ROWS, BROADCAST_WORDS = 500_000, 4_000_000


def masks_for(words: int, masks: Mapping[int, Sequence[str]] = MASKS) -> Sequence[str]:
    """The masks of an item; the whole item where it is shorter than all that ``masks`` has."""
    fit = [n for n in masks if n <= words]
    return masks[max(fit)] if fit else ("1" * words,)


def clean_words(text: Column) -> Column:
    """Words without punctuation, A-Z lower-cased, as an array of hashes."""
    kept = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.transform(F.array_remove(F.split(kept, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, arr: str, masks: Mapping[str, Column]) -> DataFrame:
    """A row for each position and mask: at, seed; the other columns stay, but for the array. ``masks``: which rows a mask is for.

    The array is zipped with itself shifted by one, two and more, so that a row holds the words it needs."""
    span = max(map(len, masks), default=1)
    kept = [c for c in df.columns if c != arr]
    shifts = [F.slice(F.col(arr), i + 1, F.size(arr)).alias(f"w{i}") for i in range(span)]
    placed = df.select(*kept, F.posexplode(F.arrays_zip(*shifts)).alias("at", "_w"))
    word = lambda i: F.col(f"_w.w{i}")
    seeds = [F.when(own & word(len(m) - 1).isNotNull(), F.xxhash64(F.lit(m), *[word(i) for i, c in enumerate(m) if c == "1"])) for m, own in masks.items()]
    return placed.select(*kept, "at", F.explode(F.array(*seeds, F.lit(None).cast("long"))).alias("seed")).filter("seed is not null")


def _overlap(window: int) -> tuple[Column, Column]:
    """Of the item ``_iw`` laid over the document's words ``_piece``, which begin ``_skip`` words into the item: flags of
    agreement, and the largest number of them in a window (read from the flags as ``_agree``)."""
    piece = F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("_skip")), F.slice("_piece", 1, F.greatest(F.size("_iw") - F.col("_skip"), F.lit(0))))
    agree = F.zip_with(piece, "_iw", lambda a, b: F.when(a.eqNullSafe(b), 1).otherwise(0))
    width = F.least(F.size("_agree"), F.lit(window))
    sums = F.transform(F.sequence(F.lit(0), F.size("_agree") - width), lambda j: F.aggregate(F.slice("_agree", j + 1, width), F.lit(0), lambda a, x: a + x))
    return agree, F.array_max(sums)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, masks: Mapping[int, Sequence[str]] = MASKS, window: int = 16, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, text_key, item_id, matched, item_words, window_matched) for every document that overlaps a test item.

    A document overlaps an item if, laid over it somewhere, some ``window`` consecutive words of the item (all, if it has
    fewer) have at least ``similarity`` of their words at the same places in the document; so an item of one word overlaps
    all documents that have the word. Case of A-Z and punctuation are ignored. Items and documents without words match
    nothing. Null identifiers are carried; text_key tells apart rows that share one, and rows that repeat both give one.
    With the default masks, window and similarity no overlap is missed; with others see to it that the masks fit. Other columns are ignored.
    """
    d = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key")).alias("row"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), clean_words(F.col(item_text)).alias("_iw")).filter(F.size("_iw") > 0)
    items = materialize(items.distinct().withColumn("n", F.size("_iw")), "items")
    longest = max(masks)
    lengths = [r[0] for r in items.select(F.least("n", F.lit(longest))).distinct().collect()]  # at most ``longest`` rows
    own: dict = {}
    for n in lengths:
        for m in masks_for(n, masks):
            own[m] = own.get(m, F.lit(False)) | (F.least("n", F.lit(longest)) == n)
    item_seeds = send_if_small(_seeds(items, "_iw", own).withColumnRenamed("at", "_ipos").distinct(), "item-seeds", BROADCAST_ROWS)
    doc_seeds = _seeds(d.select("row", clean_words(F.col("text")).alias("_dw")), "_dw", {m: F.lit(True) for m in own})
    places = materialize(doc_seeds.join(item_seeds, "seed").select("row", "item_id", "n", (F.col("at") - F.col("_ipos")).alias("start")).distinct(), "places")
    met = d.join(send_if_small(places.select("row").distinct(), "met"), "row", "left_semi").dropDuplicates(["row"])
    met = materialize(met.select("row", clean_words(F.col("text")).alias("_dw")), "met-words")
    cut = places.join(met, "row").select(
        "row", "item_id", "n", F.greatest(-F.col("start"), F.lit(0)).alias("_skip"), F.slice("_dw", F.greatest("start", F.lit(0)) + 1, F.col("n")).alias("_piece")
    )
    words = items.agg(F.sum("n")).first()[0] or 0
    laid = cut.join(F.broadcast(items) if words <= BROADCAST_WORDS else items, ["item_id", "n"])
    agree, best = _overlap(window)
    compared = laid.select("row", "item_id", "n", agree.alias("_agree")).select("row", "item_id", F.col("n").alias("item_words"), F.aggregate("_agree", F.lit(0), lambda a, x: a + x).alias("matched"), best.alias("window_matched"))
    enough = F.col("window_matched") >= F.ceil(F.least(F.col("item_words"), F.lit(window)) * F.lit(similarity) - 1e-9)
    best_of = compared.filter(enough).groupBy("row", "item_id", "item_words")
    found = best_of.agg(F.max("matched").cast("long").alias("matched"), F.max("window_matched").cast("long").alias("window_matched"))
    return found.select("row.doc_id", "row.text_key", "item_id", "matched", "item_words", "window_matched")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that overlap no test item, with their columns."""
    found = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **how)
    found = send_if_small(found.select(F.struct("doc_id", "text_key").alias("row")).distinct(), "contaminated")
    return docs.join(found, F.struct(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_key")) == found["row"], "left_anti")


def op2_decontamination(spark, sf_dir):
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("matched", "window_matched")], F.max("item_words").cast("long").alias("item_words"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), dp AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), ip AS (
  SELECT item_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p, len(w) AS n FROM i
), c AS (
  SELECT doc_id, item_id, dp.p - ip.p AS start FROM dp JOIN ip USING (x)
  GROUP BY ALL HAVING count(*) >= min(ceil(least(n, 16) * 0.8 - 1e-9))
), a AS (
  SELECT c.doc_id, c.item_id, start, len(i.w) AS n,
         list_transform(range(1, len(i.w) + 1), lambda j: CASE WHEN start + j >= 1 AND start + j <= len(d.w) AND d.w[start + j] = i.w[j] THEN 1 ELSE 0 END) AS g
  FROM c JOIN d ON d.doc_id = c.doc_id JOIN i ON i.item_id = c.item_id
), b AS (
  SELECT doc_id, item_id, n, list_sum(g) AS matched,
         list_max(list_transform(range(1, n - least(n, 16) + 2), lambda j: list_sum(list_slice(g, j, j + least(n, 16) - 1)))) AS window_matched
  FROM a
)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(window_matched) AS BIGINT) AS window_matched, CAST(max(n) AS BIGINT) AS item_words
FROM b WHERE window_matched >= ceil(least(n, 16) * 0.8 - 1e-9) GROUP BY doc_id, item_id
"""
