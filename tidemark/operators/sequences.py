"""Shaping of per-subject sequences as table jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import portable_hash


def window(df: DataFrame, cols: Sequence[str], max_len: int, strategy: str = "TO_END", key: str = "subject_id", seed: int = 1) -> DataFrame:
    """Cut parallel arrays to ``max_len``: the last elements (TO_END), the first (FROM_START) or from a start by hash (RANDOM)."""
    n = F.size(cols[0])
    over = F.greatest(n - max_len, F.lit(0))
    start = {"TO_END": over, "FROM_START": F.lit(0), "RANDOM": (portable_hash(key, seed) % (over + 1)).cast("int")}[strategy]
    df = df.withColumn("_start", start)
    return df.withColumns({c: F.slice(F.col(c), F.col("_start") + 1, max_len) for c in cols}).withColumnRenamed("_start", "start_idx")


def pad(df: DataFrame, cols: Sequence[str], length: int, side: str = "right", value=0) -> DataFrame:
    """Pad arrays to one length, NaN to the pad value, and add ``mask`` (true at elements of the sequence)."""
    n = F.size(cols[0])
    fill = lambda k: F.greatest(F.lit(length) - n, F.lit(0)) if k else None

    def padded(c: str) -> Column:
        kind = df.schema[c].dataType.elementType.simpleString()
        own = F.transform(c, lambda x: F.when(F.isnan(x.cast("double")), F.lit(value).cast(kind)).otherwise(x)) if kind in ("double", "float") else F.col(c)
        extra = F.array_repeat(F.lit(value).cast(kind), fill(True))
        return F.concat(own, extra) if side == "right" else F.concat(extra, own)

    true, false = F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), fill(True))
    return df.withColumn("mask", F.concat(true, false) if side == "right" else F.concat(false, true)).withColumns({c: padded(c) for c in cols})


def pad_nested(df: DataFrame, c: str, width: int, value=0) -> DataFrame:
    """Pad the inner arrays of a ragged array to one width, with a mask of the same shape."""
    kind = df.schema[c].dataType.elementType.elementType.simpleString()
    gap = lambda x: F.greatest(F.lit(width) - F.size(x), F.lit(0))
    mask = F.transform(c, lambda x: F.concat(F.array_repeat(F.lit(True), F.size(x)), F.array_repeat(F.lit(False), gap(x))))
    return df.withColumn(f"{c}_mask", mask).withColumn(c, F.transform(c, lambda x: F.concat(F.slice(x, 1, width), F.array_repeat(F.lit(value).cast(kind), gap(x)))))


def depad(df: DataFrame, index: str, others: Sequence[str] = ()) -> DataFrame:
    """Keep the positions at which ``index`` is not 0, in it and in the parallel arrays."""
    keep = {c: F.filter(c, lambda x, i: F.get(F.col("_index"), i) != 0) for c in [index, *others]}
    return df.withColumn("_index", F.col(index)).withColumns(keep).drop("_index")


def ragged_slice(df: DataFrame, cols: Sequence[str], start: int, stop: int) -> DataFrame:
    return df.withColumns({c: F.slice(c, start + 1, max(0, stop - start)) for c in cols})


def ragged_concat(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per key the arrays of a followed by those of b."""
    right = b.select(key, *[F.col(c).alias(f"_b_{c}") for c in cols])
    empty = lambda c: F.array().cast(a.schema[c].dataType)
    return a.join(right, key, "full").select(key, *[F.concat(F.coalesce(c, empty(c)), F.coalesce(f"_b_{c}", empty(c))).alias(c) for c in cols])


def visit_tokens(df: DataFrame, key: str, visits: str, n_ctx: int, start: int, end: int, pad_token: int) -> DataFrame:
    """(key, position, token) rows: a start token, the codes of each visit (cut to the last n_ctx - 2), the end token at the
    position of the last visit, pad tokens after it."""
    v = F.slice(visits, F.greatest(F.size(visits) - (n_ctx - 2), F.lit(0)) + 1, n_ctx - 2)
    rows = df.select(key, F.explode(F.array(F.lit(0))).alias("_z"), v.alias("_v"))
    n = F.size("_v")
    one = lambda p, tok: F.struct(p.cast("int").alias("position"), F.lit(tok).cast("int").alias("token"))
    codes = F.flatten(F.transform("_v", lambda x, i: F.transform(x, lambda c: F.struct((i + 1).cast("int").alias("position"), c.cast("int").alias("token")))))
    pads = F.transform(F.when(n + 1 < n_ctx, F.sequence(n + 1, F.lit(n_ctx - 1))).otherwise(F.array().cast("array<int>")), lambda p: one(p, pad_token))
    return rows.select(key, F.inline(F.concat(F.array(one(F.lit(0), start)), codes, F.array(one(n, end)), pads)))


def pool(df: DataFrame, key: str, vector: str, how: str, order: Sequence[str] = (), mask: str | None = None) -> DataFrame:
    """One vector per key: last, mean or max over rows (masked ones left out; all masked gives zeros). Dimensions are aggregated
    one by one, so a key with many rows is combined before the shuffle."""
    live = F.col(mask) if mask else F.lit(True)
    if how == "last":
        best = F.max_by(F.when(live, F.col(vector)), F.when(live, F.struct(*order)))
        size = F.max(F.size(vector))
        return df.groupBy(key).agg(F.coalesce(best.cast("array<double>"), F.array_repeat(F.lit(0.0), size)).alias(vector))
    f = {"mean": F.avg, "max": F.max}[how]
    long = df.select(key, live.alias("_m"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    per = long.groupBy(key, "i").agg(F.coalesce(f(F.when(F.col("_m"), F.col("x"))), F.lit(0.0)).alias("x"))
    return per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(vector))


def encode_texts(df: DataFrame, key: str, text: str, size: int = 64, encoder: Callable[[], Callable] | None = None, wide: bool = False) -> DataFrame:
    """Texts to vectors. Default: hashed term frequencies (MLlib). ``encoder``: a factory, called once in a task, of a
    function from a list of texts to a list of float lists."""
    if encoder is None:
        from pyspark.ml.feature import HashingTF
        from pyspark.ml.functions import vector_to_array

        tokens = df.select(key, F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+").alias("_t"))
        out = HashingTF(inputCol="_t", outputCol="_v", numFeatures=size).transform(tokens).select(key, vector_to_array("_v").cast("array<float>").alias("features"))
    else:

        def encode(batches):
            model = encoder()
            for pdf in batches:
                pdf["features"] = model(pdf["_t"].fillna("").tolist())
                yield pdf[[key, "features"]]

        out = df.select(key, F.col(text).alias("_t")).mapInPandas(encode, f"{key} {dict(df.dtypes)[key]}, features array<float>")
    return out.select(key, *[F.get("features", F.lit(i)).alias(f"feature_{i + 1}") for i in range(size)]) if wide else out


def vote(df: DataFrame, key: str, label: str, valid: str) -> DataFrame:
    """Per subject the mean of the valid sampled labels and the share of invalid samples; subjects with none valid go."""
    per = df.groupBy(key).agg(F.avg(F.when(F.col(valid), F.col(label).cast("int").cast("double"))).alias("mean_label"), F.avg((~F.col(valid)).cast("double")).alias("frac_invalid"))
    return per.filter(F.col("mean_label").isNotNull())


def label_samples(df: DataFrame, labeler: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """A plug-in gives label and validity of generated samples (columns label, valid); then the vote."""
    return vote(labeler(df), key, "label", "valid")
