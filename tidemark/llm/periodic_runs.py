"""Periodic runs of words in whole texts: maximal stretches that repeat with a period at least three times.

Short periods are found by comparing all words with those a lag earlier. For longer ones, at each scale w (48, 96, ...), the
k-mers of w / 2 words are hashed and the least hash of every window of w k-mers is kept. Inside a run windows a period
apart have the same words, so their minima are a period apart too: equal minimizers at a distance of w to 2w seed a stretch, which
is extended word by word to both sides. k-mers that lie in a run of a period of at most a third of their length are left out: they would
repeat at each such period. In a run of smallest period q some k-mer of each period is not of that kind, so none is missed (the
stretch of a period and a k-mer would have both periods, and so would the whole run), and a k-mer's remaining occurrences are more
than a third of its length apart, so each minimizer meets at most twelve others.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, mix64, table, text_bytes
from tidemark.llm.language_id import remainder

#: Lags below this are scanned directly; it is the first scale.
DIRECT = 48
#: Least length of a run in words, and in periods.
LEAST, TIMES = 24, 3
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _stretches(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of at least ``least`` words in which words ``lag`` apart are equal."""
    at = np.flatnonzero(ids[lag:] == ids[:-lag])
    if len(at) < least - lag:
        return []
    cut = np.flatnonzero(np.diff(at) != 1)
    low, high = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1 + lag
    keep = high - low >= least
    return list(zip(low[keep].tolist(), high[keep].tolist(), strict=True))


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays, in growing steps."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        differ = np.flatnonzero(a[done : min(n, done + step)] != b[done : min(n, done + step)])
        if len(differ):
            return done + int(differ[0])
        done, step = min(n, done + step), step * 4
    return n


def _kmer_hashes(ids: np.ndarray, m: int) -> np.ndarray:
    """A hash of every m consecutive numbers, by doubling."""
    with np.errstate(over="ignore"):
        h = mix64(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        out, held, width = None, 0, 1
        while True:
            if m & width:
                out = h if out is None else mix64(out[: len(out) - width] * np.uint64(0x9E3779B97F4A7C15) + h[held : held + len(out) - width])
                held += width
            width *= 2
            if width > m:
                return out
            h = mix64(h[: len(h) - width // 2] * np.uint64(0xD6E8FEB86659FD93) + h[width // 2 :])


def _window_minima(key: np.ndarray, w: int) -> np.ndarray:
    """The least key of every w consecutive ones."""
    width = 1
    while 2 * width <= w:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    return np.minimum(key[: len(key) - (w - width)], key[w - width :]) if w > width else key


def _seeds(ids: np.ndarray, w: int, known: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(distance, position) of equal minimizers w to 2w words apart, by distance and position. ``known``: (start, end, period) of runs."""
    m = w // 2
    h = _kmer_hashes(ids, m)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    for low, high, period in known:
        if period <= m // 3 and high - low >= m:
            key[low : high - m + 1] = _NONE
    at = np.unique(_window_minima(key, w))
    at = (at[at != _NONE] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.lexsort((at, h[at]))]
    value, pairs = h[at], [np.empty((2, 0), dtype=np.int64)]
    for step in range(1, len(at)):
        gap = np.where(value[step:] == value[:-step], at[step:] - at[:-step], 2 * w)
        hit = np.flatnonzero((gap >= w) & (gap < 2 * w))
        pairs.append(np.stack((gap[hit], at[hit])))
        if not (gap < 2 * w).any():
            break
    found = np.concatenate(pairs, axis=1)
    order = np.lexsort((found[1], found[0]))
    yield from zip(found[0][order].tolist(), found[1][order].tolist(), strict=True)


def _laid(texts: list[np.ndarray], chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The chosen texts one after another, each followed by a number that occurs once, and their beginnings."""
    sizes = np.array([len(texts[k]) + 1 for k in chosen])
    return np.concatenate([x for k in chosen for x in (texts[k], np.array([-1 - k], dtype=np.int32))]), np.cumsum(sizes) - sizes


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text, given by the numbers (from 0) of its words: (start, length, period) of its runs, by start and period."""
    # By stretch: of the periods of one stretch the smallest comes first, and the others are its multiples.
    runs: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    chosen = [k for k, t in enumerate(texts) if len(t) >= LEAST]
    if not chosen:
        return [[] for _ in texts]
    longest = max(len(texts[k]) for k in chosen)
    ids, begins = _laid(texts, chosen)

    def add(low, high, lag):
        i = int(np.searchsorted(begins, low, side="right")) - 1
        runs[chosen[i]].setdefault((low - int(begins[i]), high - int(begins[i])), lag)

    for lag in range(1, min(DIRECT - 1, longest // TIMES) + 1):
        for low, high in _stretches(ids, lag, max(LEAST, TIMES * lag)):
            add(low, high, lag)
    w = DIRECT
    while TIMES * w <= longest:
        chosen = [k for k in chosen if len(texts[k]) >= TIMES * w]
        ids, begins = _laid(texts, chosen)
        known = [(int(b) + low, int(b) + high, q) for k, b in zip(chosen, begins, strict=True) for (low, high), q in runs[k].items()]
        before, end = 0, 0
        for lag, at in _seeds(ids, w, known):
            if lag == before and at < end:
                continue  # inside the stretch of an earlier seed
            high = at + lag + _reach(ids[at:], ids[at + lag :])
            low = at - _reach(ids[:at][::-1], ids[: at + lag][::-1])
            before, end = lag, high - lag
            if high - low >= TIMES * lag:
                add(low, high, lag)
        w *= 2
    return [sorted((low, high - low, q) for (low, high), q in r.items()) for r in runs]


def planted(h: int, n: int) -> tuple[int, int] | None:
    """(a, p) for a hash and n words: from word a on, the words repeat with period p. None: the text stays."""
    g = h // 10
    return (g % n, 1 + (n - g % n) // (3 + g % 8)) if h % 10 == 0 and n else None


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant_col: str | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): a row for each document, its runs (start, length, period; by start, then period) and the
    text with the first period of each run kept and the rest dropped, words joined by one space.

    A run is a maximal stretch of words with smallest period q, at least 24 words and three periods long. Words are
    ``[^\\x20\\x09-\\x0D]+`` and compared exactly. Null and empty texts have no word and no run. Each text is read whole, and texts
    of about 2 MB together. ``plant_col``: a column of hashes from which repeats are planted into a tenth of the texts first, for
    measuring. Repeated rows give a row each; other columns are ignored; an empty table gives no row.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator):
        import pyarrow as pa

        run = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            texts, marks = text_bytes(batch.column(1)), batch.column(2).to_pylist()
            for low, high in by_bytes(texts):
                codes: dict[bytes, int] = {}
                words, ids = [], []
                for text, mark in zip(texts[low:high], marks[low:high], strict=True):
                    own = (text or b"").split()
                    if mark is not None and (move := planted(mark, len(own))):
                        a, p = move
                        own = own[:a] + [own[a + i % p] for i in range(len(own) - a)]
                    words.append(own)
                    ids.append(np.fromiter((codes.setdefault(x, len(codes)) for x in own), dtype=np.int32, count=len(own)))
                found, kept = runs_of(ids), []
                for own, rs in zip(words, found, strict=True):
                    keep = np.ones(len(own), dtype=bool)
                    for start, length, period in rs:
                        keep[start + period : start + length] = False
                    kept.append(b" ".join(itertools.compress(own, keep.tolist()) if rs else own).decode("utf-8", "replace"))
                listed = [[{"start": s, "length": n, "period": q} for s, n, q in rs] for rs in found]
                columns = [batch.column(0).slice(low, high - low), pa.array([len(own) for own in words], pa.int64()), pa.array(listed, run), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    mark = F.col(plant_col) if plant_col else F.lit(None)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), mark.cast("long").alias("_plant"))
    made = rows.mapInArrow(apply, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return made.withColumnRenamed("doc_id", id_col)


def summarize(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) from the rows of ``find_runs``. The
    run with the greatest length / period is shown (equal ones: the smallest start, then period), compared exactly."""
    ahead = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    start = F.expr("cast(null as struct<start:long,length:long,period:long>)")
    top = F.aggregate("runs", start, lambda a, x: F.when(a.isNull() | ahead(x, a), x).otherwise(a))
    line = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), top.alias("_top"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * _top.length div _top.period").alias("exponent_milli")
    return rows.select(id_col, "n_runs", "_top.start", "_top.length", "_top.period", milli, "runs_sha256", "collapsed_sha256")


def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("_hash", remainder(F.col("doc_id"), 1 << 32))
    return summarize(find_runs(docs, plant_col="_hash"))
