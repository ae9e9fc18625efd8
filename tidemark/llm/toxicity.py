"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from all labelled training documents: words, and word beginnings, that stand in
toxic documents far more often than in others. Features of a text are lexicon densities, nearness of
lexicon words to second-person words, capitals, punctuation and obfuscation rates. Trees are grown in
numpy on the driver on a bounded sample of labelled rows (``sample``), a part of which calibrates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table, text_bytes
from tidemark.llm.language_id import remainder

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
#: Signs and digits that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
#: Labels of at most so many rows, once counted, are sent to all tasks instead of shuffling the texts to them.
BROADCAST_LABELS = 1_000_000
#: Length of the word beginnings of the second lexicon.
STEM = 5
FEATURES = ("lexicon", "lexicon_count", "lexicon_weight", "lexicon_max", "stems", "stem_count", "stem_max", "near_second_person", "second_person", "capitals", "capital_words", "punctuation", "exclamation", "obfuscated", "hidden_lexicon", "repeated_letters", "words")

_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_INNER = re.compile(r"[^\W\d_][\d@$!*€.\-_]+[^\W\d_]")
_FRAME = re.compile(r"^[^\w$@]+|[^\w$@]+$")
_SIGNS = re.compile(r"[\W\d_]+")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_PUNCTUATION = re.compile(rb"[!-/:-@\[-`{-~]")
_CAPITAL = re.compile(rb"[A-Z]")


def learn_lexicon(train: DataFrame, least_docs: int = 2, least_share: float = 0.001, ratio: float = 8.0, text_col: str = "text", label_col: str = "toxic") -> tuple[dict, dict, int, int]:
    """Document counts (toxic, other) of the words and of the word beginnings that tell toxic texts, from all rows of
    ``train``. Each stands in at least ``least_docs`` toxic texts and the share ``least_share`` of them, so there are at most
    1 / least_share times as many as a toxic text has words on average, whatever the number of texts. Also the numbers of toxic and other rows."""
    rows = train.select(F.lower(text_col).alias("t"), F.col(label_col).cast("int").alias("y"))
    totals = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    pos, neg = int(totals["p"]), int(totals["n"] - totals["p"])
    if not pos or not neg:
        return {}, {}, pos, neg
    words = rows.select("y", F.explode(F.array_distinct(F.split("t", r"[^\p{L}]+"))).alias("w")).filter(F.length("w") >= 3)
    stems = rows.select("y", F.explode(F.array_distinct(F.transform(F.filter(F.split("t", r"[^\p{L}]+"), lambda w: F.length(w) > STEM), lambda w: F.substring(w, 1, STEM)))).alias("w"))
    out = []
    for units in (words, stems):
        counts = units.groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
        telling = counts.filter((F.col("p") >= max(least_docs, least_share * pos)) & ((F.col("p") + 0.5) / pos >= ratio * (F.col("q") + 0.5) / neg))
        out.append({r["w"]: (int(r["p"]), int(r["q"])) for r in telling.collect()})
    return out[0], out[1], pos, neg


class Features:
    """Dense features of a text. ``label`` (training only): the text's own counts are taken out of the lexicon's."""

    def __init__(self, words: dict, stems: dict, pos: int, neg: int):
        self.words, self.stems, self.pos, self.neg = words, stems, max(pos, 1), max(neg, 1)
        self.weights = [{w: self._weight(c) for w, c in d.items()} for d in (words, stems)]

    def _weight(self, counts, label=None):
        p, q = counts
        p, q = (p - label, q - (1 - label)) if label is not None else (p, q)
        return math.log((p + 0.1) / (self.pos + 0.2)) - math.log((q + 0.5) / (self.neg + 1)) if p > 0 else 0.0

    def _look(self, which: int, w: str, label):
        found = self.weights[which].get(w, 0.0)
        return self._weight((self.words, self.stems)[which][w], label) if found and label is not None else found

    def __call__(self, text: bytes | None, label: int | None = None) -> list[float]:
        raw = text or b""
        tokens = raw.decode("utf-8", "replace").split()
        n = max(1, len(tokens))
        hits, hidden, stem_hits, stem_max = [], 0, 0, 0.0
        second, shouted, twisted, repeated = [], 0, 0, 0
        plain, stems = self.weights
        for at, token in enumerate(tokens):
            w = token.lower()
            if not w.isalpha():
                bare = _EDGE.sub("", w)
                if bare and not bare.isalpha():
                    twisted += _INNER.search(bare) is not None
                    read = _SIGNS.sub("", _FRAME.sub("", w).translate(LEET))
                    if read not in plain:
                        read = _SIGNS.sub("", w)
                    if read in plain:
                        hidden += 1
                        bare = read
                w = bare
            if w in plain:
                weight = self._look(0, w, label)
                if weight > 0:
                    hits.append((at, weight))
            if len(w) > STEM and w[:STEM] in stems:
                weight = self._look(1, w[:STEM], label)
                if weight > 0:
                    stem_hits += 1
                    stem_max = max(stem_max, weight)
            if w in SECOND_PERSON:
                second.append(at)
            if len(token) > 2 and token.isupper():
                shouted += 1
            if len(w) > 3 and _REPEATED.search(w):
                repeated += 1
        near = 0.0
        if hits and second:
            s = np.array(second)
            h = np.array([a for a, _ in hits])
            spot = np.searchsorted(s, h)
            gap = np.minimum(np.abs(s[np.minimum(spot, len(s) - 1)] - h), np.abs(s[np.maximum(spot - 1, 0)] - h)).min()
            near = 1.0 / (1 + int(gap))
        size = max(1, len(raw))
        weight = sum(x for _, x in hits)
        return [
            len(hits) / n, float(min(len(hits), 50)), weight / n, max((x for _, x in hits), default=0.0), stem_hits / n, float(min(stem_hits, 50)), stem_max, near, len(second) / n,
            len(_CAPITAL.findall(raw)) / size, shouted / n, len(_PUNCTUATION.findall(raw)) / size, raw.count(b"!") / size, twisted / n, hidden / n, repeated / n, math.log1p(len(tokens)),
        ]


class BoostedTrees:
    """Trees of a fixed depth on the log loss, grown level by level from histograms of binned features."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.trees: list = []

    def _codes(self, x):
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x, y):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        self.edges = [np.unique(np.append(e, [np.nextafter(c.min(), np.inf)])) for e, c in zip(self.edges, x.T, strict=True)]
        codes = self._codes(x)
        width = max(len(e) for e in self.edges) + 1
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = math.log(rate / (1 - rate))
        f = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            splits = []
            for level in range(self.depth):
                count = 1 << level
                best = np.full(count, 1e-6)
                choice = np.zeros((count, 2), dtype=np.int64)
                choice[:, 1] = width  # all go left
                for j in range(x.shape[1]):
                    at = node * width + codes[:, j]
                    gs, hs, ns = (np.bincount(at, w, count * width).reshape(count, width).cumsum(axis=1) for w in (g, h, None))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(ns < self.least) | (nt - ns < self.least)] = -1
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(count), k]
                    better = top > best
                    best[better] = top[better]
                    choice[better] = np.stack((np.full(count, j), k), axis=1)[better]
                splits.append(choice)
                node = node * 2 + (codes[np.arange(len(y)), choice[node, 0]] > choice[node, 1])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.trees.append((splits, value))
            f += value[node]
        return self

    def margin(self, x):
        codes = self._codes(x)
        f = np.full(len(x), self.base)
        for splits, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for choice in splits:
                node = node * 2 + (codes[np.arange(len(x)), choice[node, 0]] > choice[node, 1])
            f += value[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots x and rising values, to be read by linear interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list = []  # [sum of y, weight, lowest x, highest x]
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == a:
            blocks[-1][0] += b
            blocks[-1][1] += 1
        else:
            blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = high
    knots = [(k, s / w) for s, w, low, high in blocks for k in dict.fromkeys((low, high))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


class Scorer:
    def __init__(self, features: Features, trees: BoostedTrees | None, knots=None, prior: float = 0.0):
        self.features, self.trees, self.knots, self.prior = features, trees, knots, prior

    def __call__(self, texts: list) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.prior)
        return np.clip(np.interp(self.trees.margin(np.array([self.features(t) for t in texts])), *self.knots), 0, 1)


def fit(train: DataFrame, sample: int = 20_000, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", **lexicon) -> Scorer:
    """Learn from ``train`` (id, text, label). The lexicon uses all rows; trees and calibration at most about
    ``sample`` rows, chosen by a hash of the identifier: a quarter calibrates, the rest grows trees. Null
    labels are left out. With one class only, every score is that class's share."""
    train = train.filter(F.col(label_col).isNotNull())
    words, stems, pos, neg = learn_lexicon(train, text_col=text_col, label_col=label_col, **lexicon)
    features = Features(words, stems, pos, neg)
    if not pos or not neg:
        return Scorer(features, None, prior=float(pos > 0))
    share = min(1.0, sample / (pos + neg))
    mark = F.pmod(F.xxhash64(F.col(id_col), F.lit("toxicity")), F.lit(1_000_000))

    def measure(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            y, part = batch.column(1).to_pylist(), batch.column(2)
            rows = [features(t, label) for t, label in zip(text_bytes(batch.column(0)), y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(y, pa.int32()), part], names=["x", "y", "part"])

    chosen = train.filter(mark < share * 1_000_000).select(text_col, F.col(label_col).cast("int").alias("y"), F.pmod(mark, F.lit(4)).cast("int").alias("part"))
    rows = chosen.mapInArrow(measure, "x array<double>, y int, part int").collect()  # about ``sample`` rows at most
    rows.sort(key=lambda r: (r["part"], r["y"], r["x"]))
    x, y, part = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=float), np.array([r["part"] for r in rows])
    held = part == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.arange(len(y)) % 4 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return Scorer(features, None, prior=float(y.mean()) if len(y) else pos / (pos + neg))
    trees = BoostedTrees().fit(x[~held], y[~held])
    return Scorer(features, trees, isotonic(trees.margin(x[held]), y[held]))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score in [0, 1], predicted (1 from 0.5 on). Null and empty texts are scored as
    texts without words. Repeated rows are scored each."""
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(text_bytes(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(apply, f"doc_id {kind}, score double")
    return scored.select(F.col("doc_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # A document that has both labels counts as toxic.
    known = labels.filter(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known, "labels")
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    scorer = fit(docs.select("doc_id", "text").join(known, "doc_id"))
    held = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return score(docs, scorer).select("doc_id", held, "score", "predicted")
