"""Masked pseudo-likelihood: a window network predicts every word from the words on both sides.

The vocabulary comes from counts over all documents: the most frequent words and hash buckets for the
rest. The counts of the rest stay a Spark table with a row for each distinct word, and a word of a bucket has
the probability of the bucket times its own share of the bucket's counts. The network (embeddings of the two words on each side, one hidden layer, a softmax over clusters
and one inside the cluster) starts from a sample on the driver. Then the masked positions of all documents (``mask_rate`` of
each, by a hash of text and place) are dealt to groups by a hash of the document; each group trains a copy, and the copies are
averaged by their numbers of positions. Groups do not depend on how the input is partitioned. Scoring sums the conditional log-probabilities of all words: tasks
write chunks of documents with the distinct bucket words of the chunk, which a join gives their shares.
"""

from __future__ import annotations

import collections
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_ROWS, by_bytes, discard, materialize, mix64, scratch, table, text_bytes

SIDE = 2
CLUSTERS, WIDTH = 32, 32
SIZE = CLUSTERS * WIDTH
PAD = SIZE
BUCKETS = 64
#: Added to the count of every word of a bucket, and the count of all words together that the corpus does not have.
SMOOTHING = 0.5
#: Documents of a training group, on average; networks that one task averages; positions that numpy holds at once.
GROUP_DOCS, FAN_IN, BLOCK = 8192, 32, 32_768
#: Distinct words that a task counts before it passes them on, and rows of a batch of them.
COUNT_WORDS, COUNT_ROWS = 1 << 19, 65_536
#: A chunk of scored documents ends at so many documents or bucket words.
CHUNK_DOCS, CHUNK_WORDS = 2048, 262_144


class Vocabulary:
    """Words by number; words outside share ``BUCKETS`` numbers by their crc32.

    ``counts`` is a table (w, n) of the words outside, ``totals`` the smoothed sum of the counts of each bucket.
    Without counts a word outside has the probability of its bucket. Tasks get the numbers only.
    """

    def __init__(self, words: list[str], counts: DataFrame | None = None):
        self.ids = {w.encode(): i for i, w in enumerate(words[: SIZE - BUCKETS])}
        self.counts, self.totals = counts, [SMOOTHING] * BUCKETS
        if counts is not None:
            for r in counts.groupBy(_bucket(F.col("w")).alias("b")).agg((F.sum("n") + SMOOTHING * (F.count("*") + 1)).alias("t")).collect():  # a row for each bucket
                self.totals[r["b"]] = r["t"]

    def __getstate__(self):
        return {"ids": self.ids}

    def __call__(self, text: bytes | None) -> np.ndarray:
        return self.numbers((text or b"").lower().split())

    def numbers(self, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.ids.get, words, itertools.repeat(-1)), np.int64, len(words))
        outside = np.flatnonzero(ids < 0)
        ids[outside] = SIZE - BUCKETS + np.fromiter(map(zlib.crc32, map(words.__getitem__, outside.tolist())), np.int64, len(outside)) % BUCKETS
        return ids

    def both(self, texts: list, index: dict, buckets: bytearray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of each text the numbers of its words as above and how many are outside; and all words outside, as positions in ``index``.
        ``index`` grows by new ones, ``buckets`` by their buckets."""
        words = [(t or b"").lower().split() for t in texts]
        ends = np.cumsum([len(w) for w in words])
        flat = list(itertools.chain.from_iterable(words))
        ids = np.fromiter(map(self.ids.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        outside = np.flatnonzero(ids < 0)
        at = np.array([index.setdefault(flat[i], len(index)) for i in outside.tolist()], dtype=np.int32)
        new = list(itertools.islice(reversed(index), len(index) - len(buckets)))
        buckets.extend(zlib.crc32(w) % BUCKETS for w in reversed(new))
        ids[outside] = SIZE - BUCKETS + np.frombuffer(bytes(buckets), dtype=np.uint8)[at].astype(np.int64)
        return np.split(ids, ends[:-1]), np.diff(np.searchsorted(outside, ends), prepend=0), at


def _bucket(word):
    return F.crc32(word.cast("binary")) % BUCKETS


def _count_words(most: int):
    """Rows (w, n) of the words of a task's texts, A-Z lower-cased; a word has a row for each ``most`` distinct ones that were held."""

    def count(batches: Iterator):
        import pyarrow as pa

        held = collections.Counter()

        def rows():
            words, n = list(held), list(held.values())
            for low in range(0, len(words), COUNT_ROWS):
                part = slice(low, low + COUNT_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(words[part], pa.binary()).view(pa.string()), pa.array(n[part], pa.int64())], names=["w", "n"])
            held.clear()

        for batch in batches:
            texts = text_bytes(batch.column(0))
            for low, high in by_bytes(texts):
                held.update(b" ".join([t or b"" for t in texts[low:high]]).lower().split())
                if len(held) >= most:
                    yield from rows()
        yield from rows()

    return count


def vocabulary(docs: DataFrame, text_col: str = "text", most: int = COUNT_WORDS) -> Vocabulary:
    """The most frequent words over all documents, ties in the order of the words, and the counts of all others. Tasks add up
    about ``most`` distinct words before they pass them on."""
    words = docs.select(text_col).mapInArrow(_count_words(most), "w string, n long")
    counts = materialize(words.groupBy("w").agg(F.sum("n").alias("n")), "word-counts", BATCH_ROWS)
    top = [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(SIZE - BUCKETS).collect()]
    return Vocabulary(top, counts.filter(~F.col("w").isin(top)))


class WindowNetwork:
    def __init__(self, dim: int = 12, hidden: int = 32, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = lambda *shape, s=1.0: (rng.standard_normal(shape) * s).astype(np.float32)
        self.dim, self.hidden = dim, hidden
        self.p = {
            "E": n(SIZE + 1, dim, s=0.3), "W": n(2 * SIDE * dim, hidden, s=(2 * SIDE * dim) ** -0.5), "b": np.zeros(hidden, np.float32),
            "C": n(hidden, CLUSTERS, s=0.1), "cb": np.zeros(CLUSTERS, np.float32), "V": n(CLUSTERS, WIDTH, hidden, s=0.1), "vb": np.zeros((CLUSTERS, WIDTH), np.float32),
        }

    def to_bytes(self) -> bytes:
        return b"".join(v.tobytes() for v in self.p.values())

    def load(self, flat: np.ndarray) -> WindowNetwork:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def _hidden(self, context):
        x = self.p["E"][context].reshape(len(context), -1)
        return x, np.tanh(x @ self.p["W"] + self.p["b"])

    @staticmethod
    def _log_softmax(a):
        a = a - a.max(axis=1, keepdims=True)
        return a - np.log(np.exp(a).sum(axis=1, keepdims=True))

    def _groups(self, target):
        order = np.argsort((target // WIDTH).astype(np.uint8), kind="stable")
        bounds = np.searchsorted((target // WIDTH)[order], np.arange(CLUSTERS + 1))
        return [(c, order[bounds[c] : bounds[c + 1]]) for c in range(CLUSTERS) if bounds[c] < bounds[c + 1]]

    @staticmethod
    def _log_softmax_at(a, at):
        """The columns ``at`` of the rows of _log_softmax(a); overwrites a."""
        a -= a.max(axis=1, keepdims=True)
        own = a[np.arange(len(a)), at]
        np.exp(a, out=a)
        return own - np.log(a.sum(axis=1))

    def log_probs(self, context, target):
        """log p(target | context) for rows of context (SIDE words before, SIDE after)."""
        _, h = self._hidden(context)
        out = self._log_softmax_at(h @ self.p["C"] + self.p["cb"], target // WIDTH)
        for c, rows in self._groups(target):
            out[rows] += self._log_softmax_at(h[rows] @ self.p["V"][c].T + self.p["vb"][c], target[rows] % WIDTH)
        return out

    def train(self, context, target, seen: dict, rate: float):
        """One Adagrad step on the mean log loss of a batch; ``seen`` holds the sums of squares."""
        p, n = self.p, len(target)
        x, h = self._hidden(context)
        d = np.exp(self._log_softmax(h @ p["C"] + p["cb"]))
        d[np.arange(n), target // WIDTH] -= 1
        d /= n
        g = {"C": h.T @ d, "cb": d.sum(axis=0), "V": np.zeros_like(p["V"]), "vb": np.zeros_like(p["vb"])}
        dh = d @ p["C"].T
        for c, rows in self._groups(target):
            e = np.exp(self._log_softmax(h[rows] @ p["V"][c].T + p["vb"][c]))
            e[np.arange(len(rows)), target[rows] % WIDTH] -= 1
            e /= n
            g["V"][c], g["vb"][c] = e.T @ h[rows], e.sum(axis=0)
            dh[rows] += e @ p["V"][c]
        da = dh * (1 - h * h)
        g["W"], g["b"] = x.T @ da, da.sum(axis=0)
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], context.ravel(), (da @ p["W"].T).reshape(-1, self.dim))
        for k, v in g.items():
            s = seen.setdefault(k, np.full_like(v, 1e-6))
            s += v * v
            p[k] -= rate * v / np.sqrt(s)


_OFFSETS = np.array([k for k in range(-SIDE, SIDE + 1) if k])


def _laid(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with gaps between them, and the places of the words in it."""
    gap = np.full(SIDE, PAD, dtype=np.int16)
    flat = np.concatenate([x for t in ids for x in (gap, t.astype(np.int16))] + [gap])
    return flat, np.flatnonzero(flat != PAD)


def windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Context rows and targets of every word of the texts, in order."""
    flat, at = _laid(ids)
    return flat[at[:, None] + _OFFSETS], flat[at]


_MASKED = "group int, key long, masked binary"


def _mask(vocab: Vocabulary, mask_rate: float, groups: int):
    """Of each document its group, a key, and its masked positions: 16-bit numbers of the words around and of the word itself."""

    def mask(batches: Iterator):
        import pyarrow as pa

        below = np.uint64(int(mask_rate * (2**64 - 1)))
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), text_bytes(batch.column(1))
            for low, high in by_bytes(texts):
                words = [(t or b"").lower().split() for t in texts[low:high]]
                sizes = np.array([len(x) for x in words])
                owner = np.repeat(np.arange(len(words)), sizes)
                at = np.arange(len(owner)) + SIDE * (owner + 1)  # as _laid has them
                own = np.array([zlib.crc32(t or b"") for t in texts[low:high]], dtype=np.uint64)
                place = np.arange(len(at)) - (np.cumsum(sizes) - sizes)[owner]
                pick = mix64((np.repeat(own, sizes) << np.uint64(32)) + place.astype(np.uint64)) < below if mask_rate < 1 else np.ones(len(at), dtype=bool)
                count = np.bincount(owner[pick], minlength=len(words))
                # Only words at and around the picked positions are looked up.
                around = np.zeros(len(at) + SIDE * (len(words) + 1), dtype=bool)
                around[at[pick][:, None] + np.arange(-SIDE, SIDE + 1)] = True
                needed = np.flatnonzero(around[at])
                all_words = list(itertools.chain.from_iterable(words))
                flat = np.full(len(around), PAD, dtype=np.int16)
                flat[at[needed]] = vocab.numbers([all_words[i] for i in needed.tolist()])
                at = at[pick]
                rows = np.concatenate((flat[at[:, None] + _OFFSETS], flat[at][:, None]), axis=1).astype("<i2")
                some, ends = np.flatnonzero(count), np.concatenate(([0], np.cumsum(count)))
                key = keys[low:high][some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((mix64(key) % np.uint64(groups)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array([rows[ends[i] : ends[i + 1]].tobytes() for i in some.tolist()], pa.binary())],
                    names=["group", "key", "masked"],
                )

    return mask


def _train_groups(start: bytes, rate: float, batch_size: int):
    """A network for each group of the sorted rows (group, key, masked), batch after batch in the order of the keys."""

    def train(batches: Iterator):
        import pyarrow as pa

        group, net, seen, held, count, total = None, None, {}, [], 0, 0

        def learn(final: bool):
            nonlocal held, count, total
            rows = np.frombuffer(b"".join(held), dtype="<i2").reshape(-1, 2 * SIDE + 1).astype(np.int64)
            end = len(rows) if final else len(rows) // batch_size * batch_size
            # A batch takes rows from all over what is held, so it has words of many documents.
            order = np.arange(end).reshape(-1, batch_size, order="F").ravel() if end and end % batch_size == 0 else np.arange(end)
            for low in range(0, end, batch_size):
                part = rows[order[low : low + batch_size]]
                net.train(part[:, :-1], part[:, -1], seen, rate)
            total += end
            held, count = [rows[end:].astype("<i2").tobytes()], len(rows) - end

        def result():
            if count:
                learn(True)
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total], pa.int64()), pa.array([net.to_bytes()], pa.binary())], names=["group", "n", "weights"])

        for batch in batches:
            for g, masked in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if g != group:
                    if group is not None:
                        yield result()
                    group, net, seen, held, count, total = g, WindowNetwork().load(np.frombuffer(start, dtype=np.float32)), {}, [], 0, 0
                held.append(masked)
                count += len(masked) // (2 * (2 * SIDE + 1))
                if count >= 16 * batch_size:
                    learn(False)
        if group is not None:
            yield result()

    return train


def _average(batches: Iterator):
    """One network for each ``above`` of the sorted rows (above, group, n, weights)."""
    import pyarrow as pa

    above, total, sums = None, 0, None

    def result():
        return pa.RecordBatch.from_arrays([pa.array([above], pa.int32()), pa.array([total], pa.int64()), pa.array([(sums / total).astype(np.float32).tobytes()], pa.binary())], names=["group", "n", "weights"])

    for batch in batches:
        for a, n, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if a != above:
                if above is not None:
                    yield result()
                above, total, sums = a, 0, 0.0
            total, sums = total + n, sums + np.frombuffer(w, dtype=np.float32).astype(np.float64) * n
    if above is not None:
        yield result()


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask_rate: float = 0.1, rate: float = 0.03, batch_size: int = 512, warm_texts: int = 1000, warm_steps: int = 300
) -> tuple[Vocabulary, WindowNetwork]:
    """Vocabulary and network of a corpus. Only the start uses a sample: the masked positions of about ``warm_texts`` documents.

    The same rows give the same network on any partitioning. Rows that repeat identifier and text train in one group.
    """
    vocab = vocabulary(docs, text_col)
    net = WindowNetwork()
    n = docs.count()
    groups = max(1, math.ceil(n / GROUP_DOCS))
    keyed = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("_text"))
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "masked")
    keyed.mapInArrow(_mask(vocab, mask_rate, groups), _MASKED).write.parquet(folder)
    masked = spark.read.schema(_MASKED).parquet(folder)
    chosen = F.pmod(F.xxhash64("key", F.lit("start")), F.lit(1_000_000_000)) < int(1e9 * min(1.0, warm_texts / max(n, 1)))
    some = sorted((r["key"], bytes(r["masked"])) for r in masked.filter(chosen).select("key", "masked").collect())  # about ``warm_texts`` rows
    rows = np.frombuffer(b"".join(m for _, m in some), dtype="<i2").reshape(-1, 2 * SIDE + 1).astype(np.int64)
    rng, seen = np.random.default_rng(1), {}
    for _ in range(warm_steps if len(rows) else 0):
        part = rows[rng.integers(0, len(rows), batch_size)]
        net.train(part[:, :-1], part[:, -1], seen, 0.1)
    dealt = masked.repartition(groups, "group").sortWithinPartitions("group", "key", "masked")
    weights = "group int, n long, weights binary"
    parts = materialize(dealt.mapInArrow(_train_groups(net.to_bytes(), rate, batch_size), weights), "networks")
    discard(spark, folder)
    while groups > FAN_IN:
        groups = math.ceil(groups / FAN_IN)
        up = parts.select(F.floor(F.col("group") / FAN_IN).cast("int").alias("above"), "group", "n", "weights").repartition("above").sortWithinPartitions("above", "group")
        parts = materialize(up.mapInArrow(_average, weights), "networks")
    done = sorted((r["group"], r["n"], bytes(r["weights"])) for r in parts.collect())  # at most FAN_IN rows
    if done:
        net.load(sum(np.frombuffer(w, dtype=np.float32).astype(np.float64) * k for _, k, w in done) / sum(k for _, k, _ in done))
    return vocab, net


def _score_chunks(vocab: Vocabulary, net: WindowNetwork):
    """Rows (chunk, ids, sizes, sums, outs, at, buckets, words): of each document of a chunk its id, words, sum of log-probabilities
    and number of bucket words; the bucket words of all, one after the other, as positions in the distinct ones, and the
    buckets of these, a byte each."""

    def apply(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        chunk, held, n_docs, n_words, index, known = TaskContext.get().partitionId() << 32, [], 0, 0, {}, bytearray()

        def row():
            ids, sizes, sums, outs, at = zip(*held, strict=True)
            ids, whole = pa.concat_arrays(ids), lambda x, kind: pa.array(np.concatenate(x), kind)
            columns = [ids, whole(sizes, pa.int64()), whole(sums, pa.float64()), whole(outs, pa.int64()), whole(at, pa.int32()), pa.array(list(index), pa.binary())]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            buckets = pa.array([bytes(known)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists[:-1], buckets, lists[-1]], names=["chunk", "ids", "sizes", "sums", "outs", "at", "buckets", "words"])

        for batch in batches:
            ids, texts = batch.column(0), text_bytes(batch.column(1))
            for low, high in by_bytes(texts, 1 << 20):
                part = texts[low:high]
                words, outs, outside = vocab.both(part, index, known)
                sizes = np.array([len(w) for w in words])
                sums = np.zeros(len(words))
                flat, at = _laid(words)
                owner = np.repeat(np.arange(len(words)), sizes)
                for k in range(0, len(at), BLOCK):
                    place = at[k : k + BLOCK]
                    sums += np.bincount(owner[k : k + BLOCK], net.log_probs(flat[place[:, None] + _OFFSETS], flat[place].astype(np.int64)), len(words))
                held.append((ids.slice(low, len(part)), sizes, sums, outs, outside))
                n_docs, n_words = n_docs + len(part), n_words + len(outside)
                if n_docs >= CHUNK_DOCS or n_words >= CHUNK_WORDS:
                    yield row()
                    chunk, held, n_docs, n_words, index, known = chunk + 1, [], 0, 0, {}, bytearray()
        if held:
            yield row()

    return apply


def _add_shares(totals: list):
    """Documents of chunks, with the sum of the logarithms of their bucket words' shares added: the smoothed count of the word
    (``counts`` has the positions and counts of those that the corpus has) over that of its bucket."""

    def add(batches: Iterator):
        import pyarrow as pa

        whole = np.log(np.array(totals))
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, sums, outs, at, counts = (batch.column(i).slice(k, 1).flatten() for i in (1, 2, 3, 4, 5, 7))
                sizes, sums, outs, at = (x.to_numpy(zero_copy_only=False) for x in (sizes, sums, outs, at))
                bucket = np.frombuffer(batch.column(6)[k].as_py(), dtype=np.uint8)
                n = np.zeros(len(bucket))
                n[counts.field("k").to_numpy(zero_copy_only=False)] = counts.field("n").to_numpy(zero_copy_only=False)
                if len(at):
                    share = np.log(n + SMOOTHING) - whole[bucket]
                    sums = sums + np.bincount(np.repeat(np.arange(len(outs)), outs), share[at], len(outs))
                mean = [s / n if n else None for s, n in zip(sums.tolist(), sizes.tolist(), strict=True)]
                place = [pa.array(np.repeat(batch.column(0)[k].as_py(), len(ids)), pa.int64()), pa.array(np.arange(len(ids)), pa.int32())]
                columns = [*place, ids, pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(mean, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "row", "doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return add


def score(docs: DataFrame, vocab: Vocabulary, net: WindowNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, log_prob (sum over all words), mean_log_prob (null without words).

    Null, empty and blank texts have no words and log_prob 0. Repeated rows are scored each.
    Rows come in the order of ``docs``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    lists = f"chunk long, ids array<{kind}>, sizes array<long>, sums array<double>, outs array<long>, at array<int>, buckets binary, words array<binary>"
    folder = scratch(docs.sparkSession, "scored-chunks")
    rows.mapInArrow(_score_chunks(vocab, net), lists).write.parquet(folder)
    chunks = docs.sparkSession.read.schema(lists).parquet(folder)
    words = chunks.select("chunk", F.posexplode("words").alias("k", "w")).withColumn("w", F.col("w").cast("string"))
    found = words.withColumn("n", F.lit(0).cast("long")).filter("false") if vocab.counts is None else words.join(vocab.counts, "w")
    counts = found.groupBy("chunk").agg(F.collect_list(F.struct("k", "n")).alias("counts"))
    given = chunks.drop("words").join(counts, "chunk", "left")
    out = given.select("chunk", "ids", "sizes", "sums", "outs", "at", "buckets", F.coalesce("counts", F.array().cast("array<struct<k:int,n:long>>")).alias("counts"))
    # Written before they are sorted, which would run the join twice; the chunks can go then.
    scored = materialize(out.mapInArrow(_add_shares(vocab.totals), f"chunk long, row int, doc_id {kind}, n_tokens long, log_prob double, mean_log_prob double"), "scored")
    discard(docs.sparkSession, folder)
    return scored.orderBy("chunk", "row").drop("chunk", "row").withColumnRenamed("doc_id", id_col)


def op1_pseudo_likelihood(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs))
