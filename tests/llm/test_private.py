"""Personal data: base spans against a plain version, added spans on planted cases, redaction, odd inputs."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import private_data as P
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in v.split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def row_of(text):
    spans = plain(text)
    return (*[sum(s[0] == k for s in spans) for k in PLAIN], hashlib.sha256(",".join(":".join(map(str, s)) for s in spans).encode()).hexdigest())


COLS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def parsed(s):
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]


@pytest.fixture(scope="module")
def model(spark):
    return P.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_whole_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.QUERIES["op13_private_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLS) == row_of(texts[r["doc_id"]])
        spans = parsed(r["spans"])
        assert set(plain(texts[r["doc_id"]])) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (P.KINDS.index(s[0]), s[1]))


def test_base_spans_of_hard_texts(spark):
    texts = [
        None, "", "a@b.c@d.e_f@g.h.i@j", "x" * 5000 + "@" + "y" * 5000 + ".de", "@a.b a@ a@b a@b. a@-.-", "é a.b+c%d@ex-am.ple.org.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.000.1.01 1.2.3 00000000256.1.1.1",
        "4111111111111111 4111 1111 1111 1111 4111-1111-1111-1111-1 4111  1111 1111 1111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "7" * 20000, "+1 (743) 555-3824 +12345678 +1+2+345-678-901 +1 - - - - +49 (0) 30 . 123456.",
        "ü+49 30 1234567ü 10.0.0.1:80 😀4539 1488 0343 6467😀", "@" * 3000, "1.1.1.1 " * 700, "5 " * 9000, "99999999999999999999.1.1.1", "a@b.c " * 600 + "+1 234 567 8901",
    ]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string, start int, kind string").repartition(3)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in P.find(df, P.NO_MODEL).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t and t[:60]
    assert P.find(df.limit(0), P.NO_MODEL).count() == 0
    empty = P.fit(df.filter("doc_id < 2"))
    assert empty == P.NO_MODEL


def test_disguised_data_is_found_and_other_numbers_are_left(spark, model):
    assert all(v <= 1 for v in model.least.values())
    cases = [
        ("write to hein.19 [at] mail5 [dot] example [dot] com today", ["email"]), ("that.92(at)mail2(dot)example(dot)com", ["email"]),
        ("the card 4539.1488.0343.6467 is", ["card"]), ("to 193[.]195[.]198[.]107 on", ["ip"]), ("the of 1 (743) 555-3824 ndth", ["phone"]),
        ("in 2024 there were 1500000 of them, 12 of 13", []), ("order 1234 on 2024-05-17 for 12.50", []), ("hash 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", []),
        ("version 300.195.198.707 of", []), ("number 4539.1488.0343.6468 is", []), ("look at the red dots", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in P.find(df, model).collect()}
    assert [got[i] for i in range(len(cases))] == [k for _, k in cases]


def test_trees_grow_and_calibrate_on_all_candidates(spark, model, monkeypatch):
    """On every form of every candidate, whatever their number; the same model from any partitions."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import IsotonicRegression

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = {}
    for kind in (GBTClassifier, IsotonicRegression):
        monkeypatch.setattr(kind, "fit", lambda self, df, kind=kind, fit=kind.fit: (weights.update({kind: df.agg({"w": "sum"}).first()[0]}), fit(self, df))[1])
    assert P.fit(docs.repartition(7)) == model
    held = {r["held"]: r["count"] for r in P.forms(P.candidates(docs)).groupBy("held").count().collect()}
    assert weights == {GBTClassifier: held[False], IsotonicRegression: held[True]} and held[False] > 100


def test_spans_next_to_one_that_went_stay(spark):
    """Of 0-10, 8-20 and 18-30 the last is the best: the middle one goes, and the first overlaps nothing that stays."""
    kind = "array<struct<kind_no:int,start:long,end:long,kind:string,score:double,base:boolean>>"
    span = lambda a, b, score, no=0: (no, a, b, P.KINDS[no], score, False)
    rows = [([], [span(0, 10, 0.6), span(8, 20, 0.7), span(18, 30, 0.8)]), ([span(25, 26, 1.0)], [span(0, 10, 0.6), span(8, 20, 0.7), span(18, 30, 0.8)]), ([], [span(5, 9, 0.9, 3), span(5, 9, 0.9, 2), span(1, 6, 0.9)]), ([], [])]
    d = spark.createDataFrame(rows, f"known {kind}, more {kind}")
    got = [[(s["start"], s["kind_no"]) for s in r[0]] for r in d.select(P.chosen(F.col("known"), F.col("more"))).collect()]
    assert got == [[(18, 0), (0, 0)], [(8, 0)], [(1, 0)], []]


def test_cards_next_to_other_numbers_are_found(spark, model):
    cases = [
        ("on 2024-05-17 4539.1488.0343.6467 was", [(14, 33)]), ("é 4539.1488.0343.6467 4539/1488/0343/6467", [(2, 21), (22, 41)]), ("pay 12 4539_1488_0343_6467 7", [(7, 26)]),
        ("on 2024-05-17 4539.1488.0343.6468 was", []), ("5 " * 4000, []), ("4539148803436467 4539148803436467", [(0, 16), (17, 33)]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "card"] for r in P.find(df, model).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    near = df.filter("doc_id = 0").select(F.explode(P.wide_spans(F.col("text"), "card")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in near] == [(14, 33, "4539.1488.0343.6467", "on 2024-05-17 ", " was")]


def test_redaction(spark, model):
    df = spark.createDataFrame([(1, "é me@x.org or +1 (743) 555-3824."), (2, None), (3, "none")], "doc_id long, text string")
    got = {r["doc_id"]: r["redacted"] for r in P.redact(df, model).collect()}
    assert got == {1: "é [email] or [phone].", 2: "", 3: "none"}


def test_only_native_operations(spark):
    plan = Q.QUERIES["op13_private_data"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
