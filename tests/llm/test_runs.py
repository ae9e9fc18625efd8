"""Periodic runs against a direct search over all periods, on the whole query and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import periodic_runs as P
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """All maximal stretches by every period; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_whole_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLS) for r in Q.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert got == {r["doc_id"]: plain(r["doc_id"], r["text"]) for r in rows}
    assert sum(v[0] > 0 for v in got.values()) > len(rows) / 20


def composed(rng):
    """Words with repeats of many periods, repeats inside periods, near repeats, and repeats cut short."""
    out = []
    while len(out) < rng.choice([30, 300, 2500]):
        kind = rng.random()
        p = rng.choice([1, 2, 3, 7, 8, 9, 23, 24, 25, 47, 48, 49, 60, 95, 96, 97, 130, 191, 192, 193, 260])
        unit = [rng.randrange(rng.choice([2, 3, 50, 1000])) for _ in range(p)]
        if kind < 0.3 and p > 30:  # one word fills most of the period
            unit[: p * 2 // 3] = [5] * (p * 2 // 3)
        if kind < 0.15 and p > 60:  # a short repeat inside
            unit[10:50] = (unit[10:13] * 14)[:40]
        times = rng.choice([1, 2, 2.9, 3, 3.1, 4.5, 9])
        part = [unit[i % p] for i in range(int(p * times))]
        if kind > 0.8 and len(part) > 5:
            part[len(part) // 2] = -7
        out += part + [rng.randrange(1000) for _ in range(rng.choice([0, 1, 5]))]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_composed_texts(seed):
    rng = random.Random(seed)
    texts = [composed(rng) for _ in range(12)] + [[], [1], [3] * 24, [3] * 23, [1, 2] * 12]
    for t in texts:
        for i, x in enumerate(t):
            t[i] = x + 10
    got = P.runs_of([np.array(t, dtype=np.int32) for t in texts])
    for t, g in zip(texts, got, strict=True):
        assert g == plain_runs(t)


def test_words_of_the_thue_morse_and_fibonacci_kind():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    thue = [0]
    while len(thue) < 1024:
        thue += [1 - x for x in thue]
    for t in (b, thue, thue * 3, b[:500] * 4):
        assert P.runs_of([np.array(t, dtype=np.int32)]) == [plain_runs(t)]


def test_odd_rows(spark):
    long = " ".join(f"w{i % 700}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 20), (4, "x " * 60000), (5, long), (5, long), (6, "ä ö ü\x0b" * 9 + "ä"), (7, "Ä b " * 30)]
    df = spark.createDataFrame([(i, t, 1, [1], "c") for i, t in rows], "doc_id long, text string, _plant int, runs array<int>, collapsed string").repartition(3)
    got = sorted((str(r["doc_id"]), *(r[c] for c in COLS)) for r in P.summarize(P.find_runs(df)).collect() if r["n_runs"]), len(rows)
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if len(words) > 50000:
            want.append((str(i), 1, 0, 60000, 1, 60000000))
        elif runs := plain_runs(words):
            top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
            want.append((str(i), len(runs), *top, 1000 * top[1] // top[2]))
    assert [g[:6] for g in got[0]] == sorted(want)
    first = P.find_runs(df.filter("doc_id = 4")).first()
    assert first["collapsed"] == "x" and first["n_words"] == 60000
    assert P.summarize(P.find_runs(df.limit(0))).count() == 0
