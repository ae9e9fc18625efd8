"""Removal of repeated passages: every word that lies in a window of words seen in an earlier document.

Windows of ``size`` words are cut into super-k-mers: consecutive windows that share a minimiser (the
smallest hash of ``seed`` consecutive words inside the window) travel as one packed string to the bucket
of that minimiser, compressed with a dictionary sampled from the texts. Equal windows have equal minimisers, so a bucket sees all copies of its windows;
it sorts them and compares equal neighbours byte by byte. Minimisers with very many super-k-mers are
found by a count first, and their windows go to buckets of their own, by the hash of the whole window. Where a minimiser has
over ``SALT_ROWS`` super-k-mers, such a bucket is first dealt to at most ``SALTS`` tasks by document, each of which passes on one copy
of a window, that of the smallest id. What a task knows to be repeats when it cuts texts is put together to runs and passes no bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table, text_bytes

#: Tasks that a hot bucket is dealt to at first, at most.
SALTS = 64
#: Super-k-mers of a hot minimiser for each of those tasks. Up to this number one task compares all there is of a window, whose copies
#: within a part of the texts are known before; its bucket is not dealt, as that would pass on each of its windows once more.
SALT_ROWS = 250_000
#: Repeats (24 bytes each), once counted, up to which they are sent to all tasks; beyond that they meet the texts in a shuffle.
BROADCAST_REPEATS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_WORD_BASE = 0x5851F42D4C957F2D
#: Bytes that are hashed at once, for bounded memory; a single word may be longer.
_BLOCK = 1 << 19


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices of a byte buffer: a polynomial over randomised bytes, from prefix sums."""
    out = np.empty(len(starts), dtype=np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(buffer), _BLOCK)), len(starts)))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        low = starts[i]
        part = buffer[low : ends[j - 1]]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[part] * _powers(_WORD_BASE, len(part)), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = _mix((sums[e] - sums[s]) * _powers(_inverse(_WORD_BASE), len(part) + 1)[s] + (e - s).astype(np.uint64))
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    base = 0xD1342543DE82EF95
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _powers(base, len(words)), out=sums[1:])
    undo = _powers(_inverse(base), len(words) + 1)
    return _mix((sums[n:] - sums[:-n]) * undo[: len(words) - n + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class _Cut:
    """Words and windows of a list of texts, end to end in one buffer."""

    def __init__(self, texts: list, size: int, seed: int):
        joined = [b" ".join(t.split()) if t else b"" for t in texts]
        self.text = b" ".join(joined)
        self.buffer = np.frombuffer(self.text, dtype=np.uint8)
        self.counts = np.array([j.count(b" ") + 1 if j else 0 for j in joined], dtype=np.int64)
        # Word bounds: empty texts leave double spaces behind, so words are runs of other bytes.
        solid = np.concatenate(([False], self.buffer != 32, [False]))
        change = np.flatnonzero(solid[1:] != solid[:-1])
        self.starts, self.ends = change[::2], change[1::2]
        self.hashes = word_hashes(self.buffer, self.starts, self.ends)
        self.first_word = np.concatenate(([0], np.cumsum(self.counts)))
        self.size, n = size, len(self.starts)
        owner = np.repeat(np.arange(len(texts)), self.counts)
        m = max(0, n - size + 1)
        self.owner = owner[:m]
        self.valid = self.owner == owner[size - 1 :] if m else np.zeros(0, dtype=bool)
        self.minimiser = sliding_min(gram_hashes(self.hashes, seed), size - seed + 1) if m else np.zeros(0, dtype=np.uint64)

    def runs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run with one key in one text."""
        if not len(key):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (self.owner[1:] != self.owner[:-1]) | (self.valid[1:] != self.valid[:-1])
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(key)))
        good = self.valid[at]
        return at[good], length[good]


def _parts(batches: Iterator, limit: int = 4 << 20):
    """(ids, keys, texts) of about ``limit`` bytes of text; a single text may be longer."""
    ids, keys, texts, held = [], [], [], 0
    for batch in batches:
        for i, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
            ids.append(i)
            keys.append(k)
            texts.append(t)
            held += len(t or b"")
            if held >= limit:
                yield ids, keys, texts
                ids, keys, texts, held = [], [], [], 0
    if texts:
        yield ids, keys, texts


def _count_minimisers(size: int, seed: int):
    def count(batches: Iterator):
        import pyarrow as pa

        for _, _, texts in _parts(batches):
            cut = _Cut(texts, size, seed)
            at, _ = cut.runs(cut.minimiser)
            values, n = np.unique(cut.minimiser[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["minimiser", "n"])

    return count


_PACKED = "bucket long, salt int, doc_id long, text_key long, at int, n int, packed binary"


def sample_dictionary(docs: DataFrame, most: int = 400, size: int = 65_536) -> bytes:
    """A Zstandard dictionary of pieces of the beginnings of about ``most`` texts, for short strings; empty if there is too
    little. It only shapes how strings are compressed on their way; no result depends on it."""
    import zstandard

    n = docs.count()
    chosen = F.pmod(F.xxhash64("doc_id", "text", F.lit("dictionary")), F.lit(1_000_000_000)) < int(1e9 * min(1.0, most / max(n, 1)))
    some = docs.filter(chosen & F.col("text").isNotNull()).select(F.substring("text", 1, 4000).alias("t")).limit(4 * most).collect()
    raw = [r["t"].encode() for r in some]
    try:
        return zstandard.train_dictionary(size, [t[i : i + 500] for t in raw for i in range(0, len(t), 500)]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _press(dictionary: bytes):
    import zstandard

    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=own, write_dict_id=False).compress


def _unpress(dictionary: bytes):
    import zstandard

    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=own).decompress


def _pack(size: int, seed: int, hot: dict, dictionary: bytes):
    """Super-k-mers of the texts, compressed. ``hot``: hot minimisers and to how many tasks their buckets are dealt. Of equal ones in a
    part only that of the smallest id goes to the bucket; the others are repeats for sure and pass as rows with a null ``packed``, one for
    each run of neighbouring ones."""

    def pack(batches: Iterator):
        import pyarrow as pa

        often = np.array(list(hot), dtype=np.int64).view(np.uint64)
        order = np.argsort(often)
        often, tasks = often[order], np.array(list(hot.values()), dtype=np.uint64)[order]
        press = _press(dictionary)
        for ids, keys, texts in _parts(batches):
            cut = _Cut(texts, size, seed)
            if not len(cut.minimiser):
                continue
            key, dealt = cut.minimiser, np.ones(len(cut.minimiser), dtype=np.uint64)
            if len(often):
                spot = np.minimum(np.searchsorted(often, key), len(often) - 1)
                is_hot = often[spot] == key
                if is_hot.any():
                    dealt = np.where(is_hot, tasks[spot], dealt)
                    key = np.where(is_hot, gram_hashes(cut.hashes, size), key)
            at, n = cut.runs(key)
            owner = cut.owner[at]
            low, high = cut.starts[at].tolist(), cut.ends[at + n + size - 2].tolist()
            text = cut.text
            best: dict = {}  # packed -> (id, row)
            out: list = []
            first = cut.first_word
            for row, (o, a, b) in enumerate(zip(owner.tolist(), low, high, strict=True)):
                i = ids[o]
                if i is None:
                    continue  # no id: neither before nor after any other
                packed = text[a:b]
                seen = best.get(packed)
                if seen is None:
                    best[packed] = (i, [row])
                elif i < seen[0]:
                    out.extend(seen[1])
                    best[packed] = (i, [row])
                elif i == seen[0]:
                    seen[1].append(row)
                else:
                    out.append(row)
            sent, packed = [], []
            for p, (_, own) in best.items():
                sent.extend(own)
                packed.extend([press(p)] * len(own))
            known = np.array(sorted(out), dtype=np.int64)
            new = np.ones(len(known), dtype=bool)
            new[1:] = (owner[known[1:]] != owner[known[:-1]]) | (at[known[1:]] != at[known[:-1]] + n[known[:-1]])
            run = known[new]
            rows = np.append(np.array(sent, dtype=np.int64), run)
            length = np.append(n[rows[: len(sent)]], np.add.reduceat(n[known], np.flatnonzero(new)) if len(run) else run)
            who = owner[rows]
            bucket = key[at[rows]].view(np.int64).copy()
            bucket[len(sent) :] = rows[len(sent) :]  # known repeats may pass anywhere
            doc = pa.array([ids[o] for o in who.tolist()], pa.int64())
            among = dealt[at[rows]]
            salt = np.where(among > 1, _mix(doc.to_numpy().view(np.uint64)) % among, np.uint64(SALTS)).astype(np.int32)
            salt[len(sent) :] = SALTS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket),
                    pa.array(salt),
                    doc,
                    pa.array([keys[o] for o in who.tolist()], pa.int64()),
                    pa.array((at[rows] - first[who]).astype(np.int32)),
                    pa.array(length.astype(np.int32)),
                    pa.array(packed + [None] * len(run), pa.binary()),
                ],
                names=["bucket", "salt", "doc_id", "text_key", "at", "n", "packed"],
            )

    return pack


def _equal_windows(packed: list, size: int):
    """Sort all windows of the packed strings. Returns for each window, in order of strings, the number of its class."""
    text = b" ".join(packed)
    buffer = np.frombuffer(text, dtype=np.uint8)
    solid = np.concatenate(([False], buffer != 32, [False]))
    change = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = change[::2], change[1::2]
    hashes = gram_hashes(word_hashes(buffer, starts, ends), size)
    counts = np.array([p.count(b" ") + 2 - size for p in packed], dtype=np.int64)
    base = np.concatenate(([0], np.cumsum(counts + size - 1)))[:-1]
    at = np.repeat(base - np.concatenate(([0], np.cumsum(counts)))[:-1], counts) + np.arange(counts.sum())
    order = np.argsort(hashes[at], kind="stable")
    h = hashes[at][order]
    low, high = starts[at][order], ends[at + size - 1][order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    for k in np.flatnonzero(~new).tolist():  # equal hashes: compare the words themselves
        if text[low[k] : high[k]] != text[low[k - 1] : high[k - 1]]:
            return _by_content(text, low, high, order, len(h)), counts
    classes = np.empty(len(h), dtype=np.int64)
    classes[order] = np.cumsum(new) - 1
    return classes, counts


def _by_content(text: bytes, low, high, order, n: int):
    """Classes by the bytes of the windows, for the case that two hashes met."""
    seen: dict = {}
    classes = np.empty(n, dtype=np.int64)
    for k in range(n):
        classes[order[k]] = seen.setdefault(text[low[k] : high[k]], len(seen))
    return classes


_FOUND = "bucket long, doc_id long, text_key long, at int, n int, packed binary"


def _find_repeats(size: int, dictionary: bytes, limit: int = 4 << 20):
    """Runs of windows that repeat those of a smaller id (rows with a null ``packed``). Of salted buckets one copy of each
    string goes on (rows with ``packed``). Strings that are equal are held once for the smallest id, so what a bucket
    holds is its different strings."""

    def find(batches: Iterator):
        import pyarrow as pa

        unpress = _unpress(dictionary)

        def result(doc, key, at, n, bucket=None, packed=None):
            columns = [pa.nulls(len(doc), pa.int64()) if bucket is None else pa.array(bucket, pa.int64()), *[pa.array(x, k) for x, k in zip((doc, key, at, n), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]]
            columns.append(pa.nulls(len(doc), pa.binary()) if packed is None else pa.array(packed, pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "doc_id", "text_key", "at", "n", "packed"])

        def fold(rows):
            """(rows to keep, repeats): of rows (doc, key, at, n, packed) with one string those of the smallest id."""
            best: dict = {}
            for r in rows:
                least = best.get(r[4])
                if least is None or r[0] < least:
                    best[r[4]] = r[0]
            return [r for r in rows if r[0] == best[r[4]]], [r for r in rows if r[0] != best[r[4]]]

        def settle(rows):
            docs, keys, ats, _, packed = zip(*rows, strict=True)
            classes, counts = _equal_windows([unpress(p) for p in packed], size)
            who = np.repeat(np.array(docs, dtype=np.int64), counts)
            least = np.full(classes.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, classes, who)
            repeat = least[classes] < who
            string = np.repeat(np.arange(len(docs)), counts)
            new = repeat.copy()
            new[1:] &= ~repeat[:-1] | (string[1:] != string[:-1])
            begin = np.flatnonzero(new)
            stop = repeat.copy()
            stop[:-1] &= ~repeat[1:] | (string[1:] != string[:-1])
            end = np.flatnonzero(stop)
            s = string[begin]
            offset = begin - np.concatenate(([0], np.cumsum(counts)))[s]
            return result(np.array(docs, dtype=np.int64)[s], np.array(keys, dtype=np.int64)[s], np.array(ats, dtype=np.int64)[s] + offset, end - begin + 1)

        rows, held, goal, last, first = [], 0, limit, None, 0  # rows from ``first`` on are of the bucket ``last``
        for batch in batches:
            bucket, salt, doc, key, at, n, pack = batch.columns
            known = pack.is_null()
            if known.true_count:
                yield result(doc.filter(known), key.filter(known), at.filter(known), n.filter(known))
            for b, t, *row in zip(*(c.to_pylist() for c in (bucket, salt, doc, key, at, n, pack)), strict=True):
                if row[4] is None:
                    continue
                if (b, t) != last:
                    if last is not None and last[1] < SALTS:
                        keep, again = fold(rows)
                        if again:
                            yield result(*zip(*[r[:4] for r in again], strict=True))
                        yield result(*list(zip(*keep, strict=True))[:4], [last[0]] * len(keep), [r[4] for r in keep])
                        rows, held, goal = [], 0, limit
                    elif rows and (held >= limit or t < SALTS):
                        yield settle(rows)
                        rows, held, goal = [], 0, limit
                    last, first = (b, t), len(rows)
                rows.append(tuple(row))
                held += len(row[4]) + 64
                if held >= goal and len(rows) - first > 1:  # a large bucket: hold each of its strings once
                    keep, again = fold(rows[first:])
                    if again:
                        yield result(*zip(*[r[:4] for r in again], strict=True))
                    rows[first:] = keep
                    held = sum(len(r[4]) + 64 for r in rows)
                    goal = held + limit
        if rows and last[1] < SALTS:
            keep, again = fold(rows)
            if again:
                yield result(*zip(*[r[:4] for r in again], strict=True))
            yield result(*list(zip(*keep, strict=True))[:4], [last[0]] * len(keep), [r[4] for r in keep])
        elif rows:
            yield settle(rows)

    return find


def _squeeze(dictionary: bytes):
    def squeeze(batches: Iterator):
        import pyarrow as pa

        press = _press(dictionary)
        for batch in batches:
            small = pa.array([press(t or b"") for t in text_bytes(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), small], names=["doc_id", "text_key", "text"])

    return squeeze


def _remove(size: int, texts: bool, dictionary: bytes | None):
    """``dictionary``: None where the texts are not compressed."""

    def remove(batches: Iterator):
        import pyarrow as pa

        unpress = (lambda t: t) if dictionary is None else _unpress(dictionary)
        for batch in batches:
            names = batch.schema.names
            ids = batch.column(0)
            n_words, n_removed, digest, kept = [], [], [], []
            for t, runs in zip(batch.column(names.index("text")).to_pylist(), batch.column(names.index("runs")).to_pylist(), strict=True):
                words = unpress(t).split()
                if runs:
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    for r in runs:
                        cover[r["at"]] += 1
                        cover[r["at"] + r["n"] + size - 1] -= 1
                    stay = np.cumsum(cover[:-1]) == 0
                    left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                else:
                    left = words
                whole = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(whole).hexdigest())
                if texts:
                    kept.append(whole.decode("utf-8"))
            out = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())] + ([pa.array(kept, pa.string())] if texts else [])
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + (["kept_text"] if texts else []))

    return remove


def repeated_windows(docs: DataFrame, size: int = 50, seed: int = 4, dictionary: bytes = b"", hot_share: float = 1e-6, hot_least: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, at, n): n consecutive windows from word ``at`` on whose words also start in a
    document with a smaller id. A minimiser is hot with over max(hot_least, hot_share of all)
    super-k-mers, so there are at most 1 / hot_share of them; that bounds the list sent to the tasks, 8 bytes each. The result is a written table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count_minimisers(size, seed), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    often = counts.filter(F.col("n") > hot_least).select("minimiser", "n")
    total = None
    hot = often.orderBy(F.desc("n")).limit(int(1 / hot_share)).collect()
    if hot and len(hot) >= int(1 / hot_share):  # only then can the share decide
        total = counts.agg(F.sum("n")).first()[0]
        hot = [r for r in hot if r["n"] > hot_share * total]
    dealt_to = {r["minimiser"]: min(SALTS, -(-r["n"] // SALT_ROWS)) for r in hot}
    packed = rows.mapInArrow(_pack(size, seed, dictionary=dictionary, hot=dealt_to), _PACKED)
    dealt = packed.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt")
    found = materialize(dealt.mapInArrow(_find_repeats(size, dictionary), _FOUND), "repeats")
    runs = ["doc_id", "text_key", "at", "n"]
    if max(dealt_to.values(), default=1) == 1:  # no bucket was dealt, so nothing is left to compare
        return found.select(*runs)
    hot_left = found.filter("packed is not null").withColumn("salt", F.lit(SALTS)).select("bucket", "salt", "doc_id", "text_key", "at", "n", "packed")
    more = hot_left.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_find_repeats(size, dictionary), _FOUND)
    return materialize(found.filter("packed is null").select(*runs).unionByName(more.select(*runs)), "all-repeats")


def substring_dedup(docs: DataFrame, size: int = 50, seed: int = 4, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, **hot) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text.

    Words are runs of bytes other than ASCII white space. A word goes if a window that covers it also
    starts in a document with a smaller id; windows are judged on the input. A repeat inside one document
    stays. Null texts have no words; texts shorter than a window lose nothing; documents with a null id
    lose nothing and take nothing from others. Rows that repeat an id are one document for the rule.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    dictionary = sample_dictionary(rows)
    repeats = repeated_windows(docs, size, seed, dictionary, id_col=id_col, text_col=text_col, **hot)
    runs = repeats.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))  # at most one per word of the text
    kind = docs.schema[id_col].dataType.simpleString()
    if repeats.count() <= BROADCAST_REPEATS:
        joined = rows.select("doc_id", "text_key", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).join(F.broadcast(runs), ["doc_id", "text_key"], "left")
        dictionary = None
    else:  # the texts travel compressed
        joined = rows.mapInArrow(_squeeze(dictionary), f"doc_id {kind}, text_key long, text binary").join(runs, ["doc_id", "text_key"], "left")
    joined = joined.select("doc_id", "text", "runs")
    out = joined.mapInArrow(_remove(size, texts, dictionary), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
    return out.withColumnRenamed("doc_id", id_col)


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"), texts=False)


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)
), least_doc AS (
  SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN least_doc USING (h) WHERE lo < doc_id
), kept AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.p = g.p
  GROUP BY t.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
