"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads chunks of ``CHUNK`` bytes (a text is cut into chunks from end to end, none is left
out), labels every byte from the states of both directions, and a text's probabilities are the mean over
its bytes. It is trained in numpy by backpropagation through time on the driver, on a bounded sample of
chunks of labelled documents (``sample`` of each language, from anywhere in any text), and sent to the tasks as a few kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import quantile
from tidemark.llm.common import BATCH_ROWS, materialize, table, text_bytes

CHUNK = 64
UND = "und"


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class GRU:
    """One direction. Arrays are (features, batch); W has a column for each byte value (and one for padding)."""

    def __init__(self, hidden: int, rng):
        self.h = hidden
        self.p = {
            "W": (rng.standard_normal((3 * hidden, 257)) * 0.3).astype(np.float32),
            "U": (rng.standard_normal((2 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32),
            "V": (rng.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32),
            "b": np.zeros((3 * hidden, 1), np.float32),
        }

    def states(self, x, keep=False):
        """States after each of the positions x (length, batch); with keep also what the way back needs."""
        h, p = self.h, self.p
        table_ = np.ascontiguousarray((p["W"] + p["b"]).T)
        s = np.zeros((h, x.shape[1]), np.float32)
        out, kept = np.empty((len(x), h, x.shape[1]), np.float32), []
        for t in range(len(x)):
            g = table_[x[t]].T
            zr = _sigmoid(g[: 2 * h] + p["U"] @ s)
            z, r = zr[:h], zr[h:]
            c = np.tanh(g[2 * h :] + p["V"] @ (r * s))
            new = s + z * (c - s)
            if keep:
                kept.append((s, z, r, c))
            out[t] = s = new
        return (out, kept) if keep else out

    def gradients(self, x, kept, d_out):
        """Backpropagation through time: gradients of the parameters given those of the states."""
        h, p = self.h, self.p
        g = {k: np.zeros_like(v) for k, v in p.items()}
        carry = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            s, z, r, c = kept[t]
            d = d_out[t] + carry
            d_c = d * z * (1 - c * c)
            d_z = d * (c - s) * z * (1 - z)
            d_rs = p["V"].T @ d_c
            d_r = d_rs * s * r * (1 - r)
            d_zr = np.concatenate((d_z, d_r))
            carry = d * (1 - z) + d_rs * r + p["U"].T @ d_zr
            g["U"] += d_zr @ s.T
            g["V"] += d_c @ (r * s).T
            pre = np.concatenate((d_zr, d_c))
            g["b"] += pre.sum(axis=1, keepdims=True)
            np.add.at(g["W"].T, x[t], pre.T)
        return g


class ByteTagger:
    """Forward and backward GRU and a softmax over the languages at every byte."""

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forward, self.backward = GRU(hidden, rng), GRU(hidden, rng)
        self.out = {"O": (rng.standard_normal((len(languages), 2 * hidden)) * 0.3).astype(np.float32), "c": np.zeros((len(languages), 1), np.float32)}

    def _softmax(self, states):
        a = self.out["O"] @ states + self.out["c"]
        a -= a.max(axis=-2, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=-2, keepdims=True)
        return a

    def label(self, x):
        """Probabilities (length, languages, batch) at every position of x (length, batch), 256 where padded."""
        f, b = self.forward.states(x), self.backward.states(x[::-1])[::-1]
        return self._softmax(np.concatenate((f, b), axis=1))

    def fit(self, x, y, steps: int = 260, batch: int = 192, rate: float = 0.02, seed: int = 11):
        """Adam on the mean log loss of all positions. x: (length, chunks); y: language of each chunk."""
        rng = np.random.default_rng(seed)
        h = self.forward.h
        parts = [self.forward.p, self.backward.p, self.out]
        moments = [{k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()} for p in parts]
        for step in range(1, steps + 1):
            at = rng.integers(0, x.shape[1], batch)
            xb, yb = x[:, at], y[at]
            f, kept_f = self.forward.states(xb, True)
            b, kept_b = self.backward.states(xb[::-1], True)
            states = np.concatenate((f, b[::-1]), axis=1)
            d = self._softmax(states)
            d[:, yb, np.arange(batch)] -= 1
            d *= (xb != 256)[:, None, :]
            d /= max(1, (xb != 256).sum())
            d_states = self.out["O"].T @ d
            grads = [
                self.forward.gradients(xb, kept_f, d_states[:, :h]),
                self.backward.gradients(xb[::-1], kept_b, d_states[::-1, h:]),
                {"O": np.einsum("tkb,thb->kh", d, states), "c": d.sum(axis=(0, 2))[:, None]},
            ]
            pace = rate * min(1, 2 * (1 - step / (steps + 1)))
            for p, g, m in zip(parts, grads, moments, strict=True):
                norm = max(1.0, float(np.sqrt(sum((v * v).sum() for v in g.values()))))
                for k in p:
                    m1, m2 = m[k]
                    m1 += 0.1 * (g[k] / norm - m1)
                    m2 += 0.01 * ((g[k] / norm) ** 2 - m2)
                    p[k] -= pace * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
        return self


def chunks(text: bytes) -> np.ndarray:
    """(chunks, CHUNK) byte values of a whole text; the last chunk is padded with 256."""
    raw = np.frombuffer(text, dtype=np.uint8)
    out = np.full(-(-len(raw) // CHUNK) * CHUNK, 256, dtype=np.int16)
    out[: len(raw)] = raw
    return out.reshape(-1, CHUNK)


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo n; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def fit(docs: DataFrame, sample: int = 6000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **how) -> ByteTagger | None:
    """Train on at most about ``sample`` chunks of each language. Every labelled document of ``docs`` gives as many of
    them on average, from anywhere in its text, chosen by a hash of identifier and place. None if there is no labelled text."""
    size = F.greatest(F.ceil(F.octet_length(text_col) / CHUNK).cast("int"), F.lit(1))
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    languages = sorted(counts)
    share = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(sample / counts[k]))]), F.col(lang_col)) / size
    places = F.filter(F.sequence(F.lit(0), size - 1), lambda k: F.pmod(F.xxhash64(F.col(id_col), k), F.lit(1_000_000_000)) < share * 1e9)
    chosen = known.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("_raw"), places.alias("_places")).filter(F.size("_places") > 0)
    pieces = chosen.select("lang", "_raw", F.explode("_places").alias("_k")).select("lang", F.substring("_raw", F.col("_k") * CHUNK + 1, F.lit(CHUNK)).alias("x"))
    rows = sorted((r["lang"], bytes(r["x"])) for r in pieces.collect())  # about ``sample`` of each language at most
    if not rows:
        return None
    x = np.concatenate([chunks(piece) for _, piece in rows]).T
    by = {k: i for i, k in enumerate(languages)}
    y = np.array([by[lang] for lang, _ in rows])
    # Languages count alike, whatever their share of the sample.
    n = np.bincount(y, minlength=len(languages))
    rng = np.random.default_rng(5)
    even = np.concatenate([rng.choice(np.flatnonzero(y == k), size=n.max()) for k in range(len(languages)) if n[k]])
    return ByteTagger(languages).fit(np.ascontiguousarray(x[:, even]), y[even], **how)


def _labelled(text: Column, lang: Column) -> Column:
    return lang.isNotNull() & text.rlike(r"\p{L}")


def random_texts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(_id, _text): for every labelled text one of random letters, drawn evenly from its own by a hash of the identifier."""
    known = docs.filter(_labelled(F.col(text_col), F.col(lang_col))).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    letters = F.array_sort(F.array_distinct(F.split(F.regexp_replace("_text", r"[^\p{L}]", ""), "")))
    word = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.element_at(F.col("_letters"), (F.pmod(F.xxhash64("_id", i), F.size("_letters")) + 1).cast("int")))
    blank = F.transform(word, lambda c, i: F.when(i % 7 == 6, F.lit(" ")).otherwise(c))
    return known.withColumn("_letters", F.filter(letters, lambda c: c != "")).select("_id", F.concat_ws("", blank).alias("_text"))


def least_score(docs: DataFrame, model: ByteTagger, loss: float = 0.002, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", scored: DataFrame | None = None) -> float:
    """The score below which a text is in none of the model's languages: what 99 of 100 texts of random letters stay below,
    but no more than all but a share ``loss`` of labelled texts reach, nor less than chance. Both are exact quantiles over all
    labelled rows: of their own scores and of those of a text of random letters for each. ``scored``: a written table of the
    labelled texts' scores (score), if there is one."""
    if scored is None:
        known = docs.filter(_labelled(F.col(text_col), F.col(lang_col)))
        scored = materialize(identify(known, model, id_col, text_col).select("score"), "labelled-scores", BATCH_ROWS)
    noise = materialize(identify(random_texts(docs, text_col, lang_col, id_col), model, "_id", "_text").select("score"), "random-scores", BATCH_ROWS)
    clean = quantile(scored, "score", loss, interpolation="lower").first()[0]
    random = quantile(noise, "score", 0.99, interpolation="linear").first()[0]
    chance = 1 / len(model.languages)
    return chance if clean is None else max(chance, min(random, clean))


def _predict(model: ByteTagger, kind: str, group: int = 4096):
    def predict(batches: Iterator):
        import pyarrow as pa

        n_lang = len(model.languages)
        for batch in batches:
            ids, known = batch.column(0), batch.column(1).to_pylist()
            texts = [t if ok else b"" for t, ok in zip(text_bytes(batch.column(2)), known, strict=True)]
            sums, sizes = np.zeros((len(texts), n_lang)), np.array([max(1, len(t)) for t in texts])
            held, owners, count = [], [], 0

            def flush():
                x = np.ascontiguousarray(np.concatenate(held).T)
                who = np.concatenate(owners)
                for low in range(0, x.shape[1], group):
                    part = x[:, low : low + group]
                    probs = model.label(part)
                    if (part == 256).any():
                        probs = probs * (part != 256)[:, None, :]
                    np.add.at(sums, who[low : low + group], probs.sum(axis=0).T)

            for i, t in enumerate(texts):
                if t:
                    c = chunks(t)
                    held.append(c)
                    owners.append(np.full(len(c), i))
                    count += len(c)
                    if count >= 4 * group:
                        flush()
                        held, owners, count = [], [], 0
            if held:
                flush()
            mean = sums / sizes[:, None]
            best = mean.argmax(axis=1)
            lang = [model.languages[b] if ok else UND for b, ok in zip(best, known, strict=True)]
            score = [float(min(1.0, max(0.0, m[b]))) if ok else 0.0 for m, b, ok in zip(mean, best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: ByteTagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (mean probability over all bytes).

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if there is no
    model. Ties go to the first language in order. Repeated rows are labelled each.
    """
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select(id_col, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), letters.alias("_known"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_predict(model, kind), f"doc_id {kind}, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(remainder(F.col("doc_id"), 3) != 1))
    return identify(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
