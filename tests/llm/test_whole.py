"""Toxicity and language identification over all documents against plain versions: a walk through each tree, a step for each byte."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, lm_scoring, simhash, substring_dedup, toxicity
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_toxicity_of_every_document(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {}
    for r in labels.filter("toxic is not null").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5:
            toxic[r["doc_id"]] = max(toxic.get(r["doc_id"], 0), r["toxic"])
    train = docs.select("doc_id", "text").join(spark.createDataFrame(sorted(toxic.items()), "doc_id long, toxic int"), "doc_id")
    scorer = toxicity.fit(train)

    def plain(text):
        if scorer.trees is None:
            return scorer.prior
        x, total = scorer.features(text.encode() if text is not None else None), scorer.trees.base
        for splits, value in scorer.trees.trees:
            node = 0
            for choice in splits:
                feature, cut = choice[node]
                code = sum(e <= x[feature] for e in scorer.trees.edges[feature])
                node = 2 * node + (code > cut)
            total += value[node]
        knots, heights = scorer.knots
        if total <= knots[0]:
            return min(1.0, max(0.0, heights[0]))
        for a, b, p, q in zip(knots, knots[1:], heights, heights[1:], strict=False):
            if total <= b:
                return min(1.0, max(0.0, p + (q - p) * (total - a) / (b - a)))
        return min(1.0, max(0.0, heights[-1]))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = Q.QUERIES["op4_toxicity"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["score"] == pytest.approx(plain(texts[r["doc_id"]]), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_language_of_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.filter(language_id.remainder(F.col("doc_id"), 3) != 1))

    def states(gru, codes):
        h, p, s, out = gru.h, {k: v.astype(float) for k, v in gru.p.items()}, np.zeros(gru.h), []
        for c in codes:
            g = p["W"][:, c] + p["b"][:, 0]
            gate = 1 / (1 + np.exp(-(g[: 2 * h] + p["U"] @ s)))
            new = np.tanh(g[2 * h :] + p["V"] @ (gate[h:] * s))
            s = (1 - gate[:h]) * s + gate[:h] * new
            out.append(s)
        return out

    def plain(text):
        raw, total = text.encode(), np.zeros(len(model.languages))
        for low in range(0, len(raw), language_id.CHUNK):
            part = list(raw[low : low + language_id.CHUNK])
            padded = part + [256] * (language_id.CHUNK - len(part))
            both = zip(states(model.forward, padded), states(model.backward, padded[::-1])[::-1], strict=True)
            for f, b in list(both)[: len(part)]:
                a = model.out["O"].astype(float) @ np.concatenate((f, b)) + model.out["c"][:, 0]
                e = np.exp(a - a.max())
                total += e / e.sum()
        return total / max(1, len(raw))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = Q.QUERIES["op5_language_id"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        p = plain(text)
        assert r["score"] == pytest.approx(p.max(), abs=2e-3)
        if np.sort(p)[-1] - np.sort(p)[-2] > 5e-3:
            assert r["lang_pred"] == model.languages[int(p.argmax())]


def test_empty_tables(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert language_id.identify(empty, language_id.ByteTagger(["de", "en"])).count() == 0
    assert toxicity.score(empty, toxicity.Scorer(toxicity.Features({}, {}, 0, 0), None)).count() == 0


#: Names that the operators use inside or return, as columns of the input.
CLASHING = "w n fp key group chunk row masked keep_id group_size kept least component component_id fingerprint score predicted n_words n_removed bucket hash node text_sha256 log_prob".split()


@pytest.mark.parametrize("name", ["op1", "op4", "op6", "op9", "op10"])
def test_clashing_columns_change_nothing(spark, name):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    more = d.select("*", *[F.lit("clash").alias(c) for c in CLASHING])
    if name == "op1":
        vocab, net = lm_scoring.fit(more, warm_steps=2)
        again, same = lm_scoring.fit(d, warm_steps=2)
        assert vocab.ids == again.ids and all(np.allclose(net.p[k], same.p[k]) for k in net.p)
        run = lambda x: lm_scoring.score(x, vocab, net)
    elif name == "op4":
        scorer = toxicity.fit(more.withColumn("toxic", (F.col("doc_id") % 3 == 0).cast("int")))
        run = lambda x: toxicity.score(x, scorer)
    else:
        run = {"op6": substring_dedup.substring_dedup, "op9": simhash.simhash_components, "op10": exact_dedup.exact_dedup}[name]
    got, want = run(more), run(d)
    extra = [c for c in got.columns if c not in want.columns]
    rows = [sorted((r.asDict() for r in x.select(want.columns).collect()), key=lambda r: r["doc_id"]) for x in (got, want)]
    assert set(extra) <= set(CLASHING) and len(rows[0]) == len(rows[1]) == d.count()
    for a, b in zip(*rows, strict=True):
        assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in b.items()} == a
