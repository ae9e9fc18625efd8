"""Corpus operators against brute force, exact round trips, held-out accuracy and SQL; and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import types
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, differences
from tidemark.llm import chat, decontamination, exact_dedup, graph, language_id, lm_scoring, mixing, simhash, substring_dedup, toxicity, warc
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, _norm int, fp string, size int, bucket int, p double"


def docs(spark, rows):
    """Documents with extra columns whose names operators might use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", 1, "f", 2, 3, 0.5) for i, t, s in rows], DOCS).repartition(5)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "Same Text", "b"), (5, "same text", "b"), (5, "same text", "b"), (6, "same text ", None),
    (None, "same text", "c"), (7, "word " * 30_000, "a"), (8, "Ünïcode ÄÖ Text", "b"), (9, "ünïcode äö text", "b"), (10, "!!! 123 ???", "a"), (None, None, None),
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert not differences(spark, con, Q.QUERIES[name], Q.ORACLE_SQL[name], SF)


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def random_docs(seed, n, vocab=30, longest=160):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(vocab)}" for _ in range(rng.randrange(longest))] for _ in range(n // 2)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        if rng.random() < 0.5:
            other = rng.choice(base)
            at = rng.randrange(len(t) + 1)
            t[at:at] = other[rng.randrange(len(other) + 1) :]
        out.append((i * 3 % 997, " ".join(t) if rng.random() > 0.05 else None, "s"))
    return out


# Exact dedup ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("run_rows", [1, 3, 65_536])
def test_exact_dedup_brute_force(spark, keep, run_rows, run_bytes=64 << 20):
    rng = random.Random(run_rows)
    rows = ODD + [(100 + i, rng.choice(["x", "X", "y" * 50, "y" * 49 + "z", "hot", "hot", "HOT"]), "a") for i in range(60)]
    got = exact_dedup.exact_dedup(docs(spark, rows), keep=keep, run_rows=run_rows, run_bytes=run_bytes).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[low(t)].append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = collections.Counter()
    for r in got:
        ids = [i for i in by_sha[r["text_sha256"]] if i is not None]
        want = (max(ids) if keep == "largest" else min(ids)) if ids else None
        assert r["keep_id"] == want and r["group_size"] == len(by_sha[r["text_sha256"]])
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_dedup_cut_by_bytes(spark):
    test_exact_dedup_brute_force(spark, "largest", 65_536, run_bytes=1)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(docs(spark, []), keep="largest").count() == 0


# Mixing --------------------------------------------------------------------------------------------------


def test_mixing_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(60), rng.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(400)] + ODD
    got = mixing.mix_sources(docs(spark, rows)).collect()
    again = mixing.mix_sources(docs(spark, rows[::-1])).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], str(r["source"]), r["taken"], r["offset"])
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, left, target = 1.5 * sum(size.values()), set(order), {}
    while left:
        w = sum(weight[s] for s in left)
        rest = total - sum(target.values())
        full = [s for s in left if rest * weight[s] / w > 2 * size[s]]
        if not full:
            target |= {s: rest * weight[s] / w for s in left}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= set(full)
    taken = collections.Counter()
    for r in sorted(got, key=key):
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and list(r["positions"]) == sorted(r["positions"])
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_mixing_empty_and_wordless(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.mix_sources(docs(spark, [(1, None, "a"), (2, " ", None)])).collect())


def test_curriculum_counts_words(spark):
    d = docs(spark, [(i, "w " * (i % 7), "ab"[i % 2]) for i in range(50)])
    mix = mixing.mix_sources(d)
    c = mixing.curriculum(d, mix)
    assert c.agg(F.sum("mix_words")).first()[0] == mix.agg(F.sum("taken")).first()[0]
    assert c.filter("mix_words <= 0").count() == 0 and c.columns == [*d.columns, "mix_pass", "mix_position", "mix_words"]


def test_curriculum_with_repeated_identifiers(spark):
    d = docs(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (1, "d e", "x"), (1, "a b c", "y"), (None, "f g", "x"), (2, "", "x")]).withColumn("position", F.lit(1))
    mix = mixing.mix_sources(d)
    c = mixing.curriculum(d, mix)
    taken = {(r["doc_id"], r["text"]): r["n"] for r in c.groupBy("doc_id", "text").agg(F.sum("mix_words").alias("n")).collect()}
    want = {(r["doc_id"], r["text_key"]): r["n"] for r in mix.filter("taken > 0").groupBy("doc_id", "text_key").agg(F.sum("taken").alias("n")).collect()}
    assert sorted(taken.values()) == sorted(want.values()) and c.agg(F.sum("mix_words")).first()[0] == mix.agg(F.sum("taken")).first()[0]
    with pytest.raises(ValueError):
        mixing.curriculum(d.withColumn("mix_pass", F.lit(0)), mix)


# Substring dedup -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("size", "hot_least", "most_sent"), [(50, 2000, 10**6), (8, 2000, 0), (8, 1, 10**6), (8, 1, 0)])
def test_substring_dedup_brute_force(spark, monkeypatch, size, hot_least, most_sent):
    monkeypatch.setattr(substring_dedup, "BROADCAST_REPEATS", most_sent)
    rows = random_docs(size, 60) + [(i, t, s) for i, t, s in ODD if i != 5] + [(5, "a b c d e f g h i", "x"), (5, "a b c d e f g h i", "x"), (6000, "a b c d e f g h i j", "x")]
    got = substring_dedup.substring_dedup(docs(spark, rows), size=size, hot_least=hot_least).collect()
    first = {}
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                first[tuple(w[k : k + size])] = min(first.get(tuple(w[k : k + size]), i), i)
    want = collections.Counter()
    for i, t, _ in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())] += 1
    assert collections.Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_substring_dedup_of_dealt_buckets(spark, monkeypatch, most_sent):
    monkeypatch.setattr(substring_dedup, "SALT_ROWS", 1)
    test_substring_dedup_brute_force(spark, monkeypatch, 8, 1, most_sent)


def test_known_repeats_are_one_row_a_run(spark):
    """Copies in one part of the texts give a row for each run of windows, not one for each window, hot or not."""
    text = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(text), "a") for i in range(40)] + [(100 + i, " ".join([*text[:120], f"x{i}", *text[120:]]), "a") for i in range(10)]
    for hot_least in (1, 2000):
        got = substring_dedup.repeated_windows(docs(spark, rows).coalesce(1), hot_least=hot_least).collect()
        by = collections.Counter()
        for r in got:
            by[r["doc_id"]] += r["n"]
        assert by == {i: 151 if i < 100 else 102 for i, _, _ in rows[1:]}
        if hot_least == 1:
            assert len(got) == 39 + 2 * 10


def test_large_buckets_hold_each_string_once():
    """Buckets beyond the limit, salted ones too, give the same repeats as small ones."""
    import pyarrow as pa

    for salt in (substring_dedup.SALTS, 3):
        rows = [(b, salt, (i * 7) % 30, 0, 4, 3, substring_dedup._press(b"")((f"w{b}x{i % 12} " * 3 + f"v{b}x{i % 12} u t").encode())) for b in range(3) for i in range(40)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "salt", "doc_id", "text_key", "at", "n", "packed"])
        out = []
        for limit in (1, 1 << 20):
            found = collections.Counter()
            for b in substring_dedup._find_repeats(4, b"", limit)(iter([batch.slice(0, 50), batch.slice(50)])):
                for r in b.to_pylist():
                    found[(r["doc_id"], r["packed"])] += 1 if r["packed"] else r["n"]
            out.append(found)
        assert out[0] == out[1] and any(p for _, p in out[0]) == (salt == 3)


def test_windows_with_equal_hashes_are_told_apart():
    classes = substring_dedup._by_content(b"a b c a b", [0, 6], [3, 9], np.array([0, 1]), 2)
    assert classes[0] == classes[1]
    classes, counts = substring_dedup._equal_windows([b"a b c d", b"b c d e", b"x b c d"], 3)
    assert counts.tolist() == [2, 2, 2] and classes[1] == classes[2] == classes[5] and len(set(classes.tolist())) == 4


def test_substring_dedup_empty(spark):
    assert substring_dedup.substring_dedup(docs(spark, [])).count() == 0


# SimHash -------------------------------------------------------------------------------------------------


def brute_fingerprint(t, k):
    import xxhash

    w = [x.lower() for x in words(t)]
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, near):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if near(a, b):
                parent[root(a)] = root(b)
    low_ = {}
    for i, x in enumerate(ids):
        if x is not None:
            low_[root(i)] = min(low_.get(root(i), x), x)
    return [low_.get(root(i)) for i in range(len(ids))]


def test_simhash_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, t, s) for i, t, s in random_docs(3, 120, vocab=200) if i] + ODD
    for i in range(40):
        t = [f"v{k % 50}" for k in range(300)]
        t[rng.randrange(300)] = f"q{i % 9}"
        rows.append((5000 + i, " ".join(t), "s"))
    got = simhash.simhash_components(docs(spark, rows)).collect()
    fps = [brute_fingerprint(t, 3) for _, t, _ in rows]
    comp = brute_components([i for i, _, _ in rows], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    want = collections.Counter((i, f"{f:016x}", c) for (i, _, _), f, c in zip(rows, fps, comp, strict=True))
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_majority_over_many_shingles():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    counts = np.array([0, 700, 1, 0, 1299])
    got, at = simhash.majority_bits(h, counts), 0
    for g, n in zip(got, counts, strict=True):
        own = [int(x) for x in h[at : at + n]]
        at += n
        assert int(g) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > n)


def test_near_duplicates_brute_force(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(40, 200))] for _ in range(12)]
    rows = []
    for i in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 12])):
            t[rng.randrange(len(t))] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(t), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, "one two", "s"), (903, "ONE two", "s"), (None, "one two", "s")]
    sets = [set(simhash.shingles((t or "").encode(), 5)) for _, t, _ in rows]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and rows[a][0] is not None and rows[b][0] is not None
    want = {i: c for (i, _, _), c in zip(rows, brute_components([i for i, _, _ in rows], near), strict=True) if i is not None}
    for part_rows, block_rows in ((128, 1024), (5, 7)):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), part_rows=part_rows, block_rows=block_rows).collect()}
        assert got == want


def test_near_duplicates_with_repeats_and_few_shingles(spark):
    rng = random.Random(11)
    rows = []
    for i in range(30):
        t = [f"r{i}x{k}" for k in range(200)]
        line = t[40:60]
        rows += [(4 * i, " ".join([*t, *line]), "s"), (4 * i + 1, " ".join([*t, *line * (5 + i)]), "s")]
        short = [f"s{i}x{k}" for k in range(9 + i // 10 * rng.randrange(12))]
        rows += [(4 * i + 2, " ".join(short), "s"), (4 * i + 3, " ".join(short[:-1]), "s")]
    sets = [set(simhash.shingles(t.encode(), 5)) for _, t, _ in rows]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = {i: c for (i, _, _), c in zip(rows, brute_components([i for i, _, _ in rows], near), strict=True)}
    assert len(set(want.values())) == 60
    for part_rows, block_rows in ((128, 1024), (5, 7)):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), part_rows=part_rows, block_rows=block_rows).collect()}
        assert got == want


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, None), (9, 8), (8, 9)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(links).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {8: 8, 9: 8}
    assert graph.connected_components(links.filter("false")).count() == 0


def test_simhash_empty(spark):
    assert simhash.simhash_components(docs(spark, [])).count() == 0
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


# Decontamination -----------------------------------------------------------------------------------------


def test_decontamination(spark, monkeypatch):
    rng = random.Random(10)
    item = [f"t{i}" for i in range(30)]
    noise = lambda n: [f"z{rng.randrange(1000)}" for _ in range(n)]
    subs = list(item)
    for k in (3, 9, 17, 26):
        subs[k] = "changed"
    far = [w if i % 3 else "changed" for i, w in enumerate(item)]
    rows = [
        (1, " ".join(noise(40) + item + noise(5)), "a"), (2, " ".join(noise(10) + subs), "a"), (3, " ".join(noise(10) + far + noise(9)), "a"), (4, " ".join(noise(100)), "a"),
        (5, " ".join(x.upper() + "," for x in item), "a"), (6, " ".join(item[5:12] + noise(30)), "a"), (7, " ".join(item[14:]), "a"), (None, " ".join(item), "a"), (8, None, "a"), (9, "", "a"),
        (1, "other text", "b"), (10, " ".join(item[10:] + noise(3)), "a"),
    ]
    bench = spark.createDataFrame([(77, " ".join(item)), (78, "too short"), (79, None), (80, "")], "item_id long, text string")
    rows += [(11, "It is TOO short.", "a"), (12, "too very short", "a")]
    for bound in (500_000, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", bound)
        monkeypatch.setattr(decontamination, "BROADCAST_WORDS", bound)
        found = decontamination.contaminated(docs(spark, rows), bench).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 77), (2, 77), (5, 77), (7, 77), (None, 77), (10, 77), (11, 78)}
        odd = docs(spark, rows).withColumn("row", F.lit(1)).withColumn("_t", F.lit(1))
        left = decontamination.decontaminate(odd, bench)
        assert sorted((r["doc_id"], r["text"] == "other text") for r in left.collect()) == [(1, True), (3, False), (4, False), (6, False), (8, False), (9, False), (12, False)]
        assert left.columns == odd.columns
    assert decontamination.decontaminate(docs(spark, rows), bench.filter("false")).count() == len(rows)
    assert decontamination.contaminated(docs(spark, []), bench).count() == 0


@pytest.mark.parametrize("n", range(1, 40))
def test_masks_meet_every_allowed_difference(n):
    """Every choice of as many words to substitute as the rule allows, for items of each length up to the window."""
    import itertools
    import math

    width, masks = min(n, 16), decontamination.masks_for(n)
    assert n < 5 or all("0" in m for m in masks)
    for bad in itertools.combinations(range(width), width - math.ceil(width * 0.8 - 1e-9)):
        assert any(all(s + i not in bad for i, c in enumerate(m) if c == "1") for m in masks for s in range(width - len(m) + 1))


def test_decontamination_against_all_placements(spark):
    """Items of every length, substitutions at random, documents that hold only a part: against comparison at every place."""
    import math

    rng = random.Random(21)
    items = {n: [f"i{n}w{rng.randrange(9)}x{k}" if rng.random() < 0.8 else "the" for k in range(n)] for n in [*range(1, 21), 30]}
    rows = []
    for i in range(400):
        w = list(items[rng.choice([*items])])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(["the", "other", f"z{i}"])
        low_, high = (0, len(w)) if rng.random() < 0.6 else sorted(rng.sample(range(len(w) + 1), 2))
        rows.append((i, " ".join([f"q{rng.randrange(50)}" for _ in range(rng.randrange(6))] + w[low_:high] + ["the"] * rng.randrange(3)), "s"))
    want = {}
    for i, t, _ in rows:
        w = t.split()
        for n, item in items.items():
            for start in range(-n, len(w)):
                flags = [0 <= start + j < len(w) and w[start + j] == item[j] for j in range(n)]
                width = min(n, 16)
                best = max(sum(flags[j : j + width]) for j in range(n - width + 1))
                if best >= math.ceil(width * 0.8 - 1e-9):
                    a, b = want.get((i, n), (0, 0))
                    want[(i, n)] = (max(a, sum(flags)), max(b, best))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["window_matched"]) for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    assert got == want and len(want) > 150


# Language identification ---------------------------------------------------------------------------------


def test_network_gradients():
    rng = np.random.default_rng(0)
    model = language_id.ByteTagger(["a", "b"], hidden=3)
    x = rng.integers(0, 257, (5, 4)).astype(np.int16)
    for part in (model.forward, model.backward):
        for k in part.p:
            part.p[k] = part.p[k].astype(np.float64)
    out, kept = model.forward.states(x, True)
    up = rng.standard_normal(out.shape).astype(np.float32)
    grads = model.forward.gradients(x, kept, up)
    for k, at in (("U", (1, 2)), ("V", (0, 1)), ("b", (4, 0)), ("W", (2, int(x[2, 1])))):
        base = model.forward.p[k][at]
        loss = []
        for step in (1e-3, -1e-3):
            model.forward.p[k][at] = base + step
            loss.append(float((model.forward.states(x).astype(np.float64) * up).sum()))
        model.forward.p[k][at] = base
        assert grads[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=0.05, abs=1e-3)


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.QUERIES["op5_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.collect())


def test_language_odd_inputs(spark):
    d = docs(spark, ODD)
    model = language_id.fit(d, steps=3)
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language_id.identify(d, model).collect()}
    assert {i for (i, k) in got if k == "und"} == {1, 2, 3, 10, None} and len(got) >= 10
    assert all(0 <= s <= 1 for s in got.values())
    assert language_id.fit(docs(spark, [])) is None
    assert [r["lang_pred"] for r in language_id.identify(docs(spark, [(1, "a", "s")]), None).collect()] == ["und"]
    assert language_id.identify(docs(spark, []), model).count() == 0


def test_least_score_is_of_all_labelled_rows(spark):
    """Not of some thousands of them: the bound is the exact rank among 9,000 labelled texts, or among as many random ones."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(20)) + "x", rng.choice(["de", "en"])) for i in range(9000)] + [(9001, None, "en"), (9002, "12 !", "de"), (9003, "no label", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = language_id.ByteTagger(["de", "en"])
    score = lambda x, i, t: np.sort([r["score"] for r in language_id.identify(x, model, i, t).collect()])
    clean = score(d.filter("doc_id < 9000"), "doc_id", "text")
    assert language_id.least_score(d, model, loss=0.3) == clean[2699]
    noise = score(language_id.random_texts(d), "_id", "_text")
    assert len(noise) == 9000 and language_id.least_score(d, model, loss=1.0) == pytest.approx(min(np.quantile(noise, 0.99), clean[-1]))
    assert language_id.least_score(d.filter("doc_id > 9000"), model) == 0.5


# Toxicity ------------------------------------------------------------------------------------------------


def test_isotonic_rises():
    rng = np.random.default_rng(3)
    x = rng.random(200).round(2)
    y = (rng.random(200) < x).astype(float)
    kx, ky = toxicity.isotonic(x, y)
    assert (np.diff(ky) >= 0).all() and (np.diff(kx) > 0).all()
    assert np.interp(x, kx, ky).mean() == pytest.approx(y.mean(), abs=0.05)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    m = toxicity.BoostedTrees(trees=40).fit(x[:1500], y[:1500])
    assert ((m.margin(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95


def test_features_see_lexicon_and_disguise():
    f = toxicity.Features({"idiot": (10, 0)}, {}, 20, 100)
    plain, masked, near, none = (dict(zip(toxicity.FEATURES, f(t), strict=True)) for t in (b"what an idiot", b"what an 1d10t!", b"you idiot", None))
    assert plain["lexicon_count"] == 1 and masked["hidden_lexicon"] > 0 and near["near_second_person"] == 0.5
    assert none["words"] == 0 and f(b"what an idiot", 1)[1] == 1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    tp = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in got)
    assert tp / sum(r["toxic"] for r in got) > 0.8 and tp / sum(r["predicted"] for r in got) > 0.8


def test_toxicity_odd_inputs(spark):
    d = docs(spark, ODD)
    train = docs(spark, [(i, "you idiot " + "x " * i if i % 2 else "fine words " + "y " * i, "s") for i in range(60)]).withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    for scorer in (toxicity.fit(train), toxicity.fit(train.filter("toxic = 1")), toxicity.fit(train.filter("false")), toxicity.fit(train.withColumn("toxic", F.lit(None).cast("int")))):
        got = toxicity.score(d, scorer).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
        assert toxicity.score(docs(spark, []), scorer).count() == 0


# WARC ----------------------------------------------------------------------------------------------------


def test_archive_round_trip():
    payloads = [b"", b"x", "é".encode() * 1000, b"\r\n\r\n" * 9] + [b"<p>%d</p>" % i * 40 for i in range(50)]
    records = [warc.encode_record(i, f"http://a/{i}", p, "response") for i, p in enumerate(payloads)] + [warc.encode_record(99, None, b"x", "revisit", 1)]
    for part in (records, records[:2], records[-1:]):
        data = warc.encode_archive(part)
        out = list(warc.decode_archive(data))
        assert len(out) == len(part)
    out = list(warc.decode_archive(warc.encode_archive(records)))
    assert [b for _, b in out[:-1]] == payloads and out[-1][0]["warc-refers-to"] == "<urn:page:1>" and out[-1][0]["x-payload-length"] == "1"
    for bad in (data[:-3], data[:10], b"junk" + data):
        with pytest.raises(ValueError):
            list(warc.decode_archive(bad))
    with pytest.raises(ValueError):
        warc.decode_record(records[2][:-1])


def test_compressed_dictionary_is_read():
    import struct

    import zstandard

    raw = warc.train_dictionary([b"abc %d" % i * 9 for i in range(64)]).as_bytes()
    small = zstandard.ZstdCompressor().compress(raw)
    body = zstandard.ZstdCompressor(dict_data=warc._load_dictionary(raw)).compress(warc.encode_record(1, "u", b"abc", "response"))
    assert len(list(warc.decode_archive(struct.pack("<II", warc.DICTIONARY_FRAME, len(small)) + small + body))) == 1


def test_warc_through_spark(spark, tmp_path):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u\r\n", None), (4, "u", ""), (5, "u", "é" * 5000), (5, "u", "é" * 5000), (None, "u", "same"), (6, "u", "own")]
    pages = spark.createDataFrame([(*r, 1, 2, "k", "t") for r in rows], "page_id long, url string, html string, first int, row int, key string, record_type string").repartition(3)
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(warc.classify(pages), folder, roll=3000)
    # What another attempt of a task, cut elsewhere, and one that was killed have left.
    stale = warc.encode_archive([warc.encode_record(1, "u", b"same", "response")])
    (tmp_path / "w" / "000000-000000-other.warc.zst").write_bytes(stale)
    (tmp_path / "w" / "000001-000000-killed.warc.zst").write_bytes(stale[:-5])
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(spark, folder).collect()
    kinds = collections.Counter((r["record_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == {("<urn:page:1>", "revisit", "<urn:page:2>"): 1, ("<urn:page:2>", "response", None): 1, ("<urn:page:>", "revisit", "<urn:page:2>"): 1, ("<urn:page:3>", "revisit", "<urn:page:4>"): 1, ("<urn:page:4>", "response", None): 1, ("<urn:page:5>", "response", None): 2, ("<urn:page:6>", "response", None): 1}
    assert {r["payload_length"] for r in got if r["record_id"] == "<urn:page:5>"} == {10_000}
    large = warc.classify(pages, least_bytes=5).filter("record_type = 'revisit'")
    assert large.count() == 0


# Language-model scoring ----------------------------------------------------------------------------------


def test_scores_are_sums_of_conditional_log_probabilities(spark):
    d = docs(spark, [(i, f"a b c {'d ' * (i % 9)} e f", "s") for i in range(80)] + ODD)
    vocab, net = lm_scoring.fit(d, warm_steps=20)
    got = {}
    for r in lm_scoring.score(d, vocab, net).collect():
        got.setdefault(r["doc_id"], r)
    for i, t in [(3, "a b c d d d  e f"), (8, "Ünïcode ÄÖ Text"), (1, None)]:
        if i == 3:
            t = "a b c d d d e f"
            row = next(r for r in lm_scoring.score(docs(spark, [(3, t, "s")]), vocab, net).collect())
        else:
            row = got[i]
        ids = vocab((t or "").encode())
        total = 0.0
        for k in range(len(ids)):
            c = np.array([[ids[k + o] if 0 <= k + o < len(ids) else lm_scoring.PAD for o in (-2, -1, 1, 2)]])
            _, h = net._hidden(c)
            joint = []
            for cl in range(lm_scoring.CLUSTERS):
                a = net._log_softmax(h @ net.p["C"] + net.p["cb"])[0, cl]
                joint.append(a + net._log_softmax(h @ net.p["V"][cl].T + net.p["vb"][cl])[0])
            joint = np.concatenate(joint)
            assert np.exp(joint).sum() == pytest.approx(1, abs=1e-4)
            total += joint[ids[k]]
        assert row["n_tokens"] == len(ids) and row["log_prob"] == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_training_raises_likelihood_and_text_beats_shuffled_text(spark):
    rng = random.Random(1)
    cycle = "alpha beta gamma delta epsilon zeta".split()
    d = docs(spark, [(i, " ".join((cycle * 12)[rng.randrange(6) :][:60]), "s") for i in range(200)])
    vocab, net = lm_scoring.fit(d)
    mixed = [rng.choice(cycle) for _ in range(60)]
    rows = {r["doc_id"]: r["mean_log_prob"] for r in lm_scoring.score(docs(spark, [(1, " ".join(cycle * 10), "s"), (2, " ".join(mixed), "s")]), vocab, net).collect()}
    assert rows[1] > -1 and rows[1] > rows[2] + 1


def test_language_model_is_the_same_on_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "GROUP_DOCS", 40)
    monkeypatch.setattr(lm_scoring, "FAN_IN", 2)
    d = spark.createDataFrame([(i, f"a b{i % 7} c {'d ' * (i % 9)} e f", "s") for i in range(200)] + [(900, None, "s")], "doc_id long, text string, source string")
    got = []
    for parts in (5, 50):
        vocab, net = lm_scoring.fit(d.repartition(parts), warm_steps=5, mask_rate=0.5)
        got.append({r["doc_id"]: r["log_prob"] for r in lm_scoring.score(d.repartition(parts), vocab, net).collect()})
    assert got[0].keys() == got[1].keys() and all(got[0][i] == pytest.approx(got[1][i], rel=1e-5) for i in got[0])


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    vocab, net = lm_scoring.fit(docs(spark, [(i, "a b c d e", "s") for i in range(20)]), warm_steps=5)
    d = docs(spark, [(1, "a b c d e " * 3000, "s"), (2, "b c", "s"), (3, "", "s")])
    want = {r["doc_id"]: r["log_prob"] for r in lm_scoring.score(d, vocab, net).collect()}
    monkeypatch.setattr(lm_scoring, "BLOCK", 7)
    monkeypatch.setattr(lm_scoring, "by_bytes", lambda texts, limit=1: ((i, i + 1) for i in range(len(texts))))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    small = [b for b in lm_scoring._score_chunks(vocab, net)(iter([d.select("doc_id", "text").toArrow().combine_chunks().to_batches()[0]]))]
    got = {i: s for b in small for r in b.to_pylist() for i, s in zip(r["ids"], r["sums"], strict=True)}
    assert all(got[i] == pytest.approx(want[i], abs=1e-3 * max(1, abs(want[i]))) or i != 2 for i in got) and set(got) == {1, 2, 3}


def test_words_are_counted_in_tasks_and_looked_up_where_masked(spark):
    import pyarrow as pa

    rows = [(i, " ".join(f"W{(i * 7 + j * j) % 60}" for j in range(80)) + (" \x0b\u00c9a\u00a0b", "\n")[i % 2], "s") for i in range(40)] + [(90, None, "s"), (91, " ", "s")]
    want = collections.Counter(w for _, t, _ in rows for w in (t or "").encode().lower().split())
    for most in (3, 1 << 19):
        vocab = lm_scoring.vocabulary(docs(spark, rows), most=most)
        assert set(vocab.ids) == set(want)
    texts = [t for _, t, _ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    counted = pa.Table.from_batches(list(lm_scoring._count_words(1 << 19)(iter([batch]))))
    assert {w.encode(): n for w, n in zip(counted["w"].to_pylist(), counted["n"].to_pylist(), strict=True)} == want and counted.num_rows == len(want)

    looked = []

    class Counted(lm_scoring.Vocabulary):
        def numbers(self, words):
            looked.append(len(words))
            return super().numbers(words)

    small = Counted([f"w{i}" for i in range(20)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["key", "t"])
    got = {k: m for b in lm_scoring._mask(small, 0.1, 3)(iter([batch])) for k, m in zip(b["key"].to_pylist(), b["masked"].to_pylist(), strict=True)}
    assert 0 < sum(looked) < 0.6 * sum(want.values())
    for i, t in enumerate(texts):
        context, target = lm_scoring.windows([small((t or "").encode())])
        crc = np.uint64(zlib.crc32((t or "").encode()))
        pick = lm_scoring.mix64((crc << np.uint64(32)) + np.arange(len(target), dtype=np.uint64)) < np.uint64(int(0.1 * (2**64 - 1)))
        assert got.get(i, b"") == np.concatenate((context, target[:, None]), axis=1)[pick].astype("<i2").tobytes()


def test_every_word_has_its_own_probability(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_WORDS", 100)
    rare = {f"rare{i}": i % 7 + 1 for i in range(300)}
    frequent = [f"top{i}" for i in range(lm_scoring.SIZE - lm_scoring.BUCKETS)]
    corpus = [(i, " ".join([*frequent] * 10), "s") for i in range(2)] + [(9, " ".join(w for w, n in rare.items() for _ in range(n)), "s")]
    vocab = lm_scoring.vocabulary(docs(spark, corpus))
    assert {r["w"]: r["n"] for r in vocab.counts.collect()} == rare and set(vocab.ids) == {w.encode() for w in frequent}
    net = lm_scoring.WindowNetwork()
    unseen = {}  # a word that the corpus does not have for each bucket
    for i in range(5000):
        unseen.setdefault(zlib.crc32(b"new%d" % i) % lm_scoring.BUCKETS, f"new{i}")
    every = [*frequent, *rare, *unseen.values()]
    got = {r["doc_id"]: r["log_prob"] for r in lm_scoring.score(docs(spark, [*((i, w, "s") for i, w in enumerate(every)), (-1, "rare6 rare6  RARE0", "s")]), vocab, net).collect()}
    assert len(unseen) == lm_scoring.BUCKETS and np.exp([got[i] for i in range(len(every))]).sum() == pytest.approx(1, abs=1e-3)
    by = dict(zip(every, (got[i] for i in range(len(every))), strict=True))
    for w in rare:
        for v in rare:
            if zlib.crc32(w.encode()) % lm_scoring.BUCKETS == zlib.crc32(v.encode()) % lm_scoring.BUCKETS:
                assert by[w] - by[v] == pytest.approx(np.log((rare[w] + 0.5) / (rare[v] + 0.5)), abs=1e-6)
    ids = vocab(b"rare6 rare6 rare0")
    plain = net.log_probs(*lm_scoring.windows([ids])).sum()
    share = sum(by[w] - net.log_probs(*lm_scoring.windows([vocab(w.encode())])).sum() for w in ("rare6", "rare6", "rare0"))
    assert got[-1] == pytest.approx(plain + share, abs=1e-4)


def test_lm_empty(spark):
    vocab, net = lm_scoring.fit(docs(spark, []))
    assert lm_scoring.score(docs(spark, []), vocab, net).count() == 0
    vocab, net = lm_scoring.fit(docs(spark, [(1, None, "s"), (2, " ", "s")]))
    assert {r["n_tokens"] for r in lm_scoring.score(docs(spark, [(1, None, "s"), (2, " ", "s")]), vocab, net).collect()} == {0}


# Chat ----------------------------------------------------------------------------------------------------


def test_rotation_small(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, None, "ann", "first"), (2, 0, "system", "alone"), (None, 0, None, "x")], "conv_id long, turn long, role string, text string").withColumn("part", F.lit("extra"))
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(turns).groupBy("conv_id", "perspective").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "text"))), lambda x: x["text"]), "").alias("text")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    s, e = chat.START, chat.END
    assert got[(1, "ann")]["text"] == f"{s}assistant\nfirst{e}\n{s}system\nbe kind{e}\n{s}assistant\nhi{e}\n{s}user name=bob\n{e}\n"
    for r in chat.rotate(turns).collect():
        spans = [tuple(map(int, x.split(":"))) for x in r["mask"].split(",") if x]
        assert len(spans) == r["n_trained"] and all(r["text"][a:b].endswith(e) and r["text"][:a].endswith(f"{s}assistant\n") for a, b in spans)


def test_long_conversations_are_cut(spark):
    turns = spark.createDataFrame([(1, i, "ab"[i % 2], f"t{i}") for i in range(1000)] + [(2, 5, "ab"[i % 2], f"t{i}") for i in range(1000)], "conv_id long, turn long, role string, text string")
    got = chat.rotate(turns, block=100)
    sizes = got.groupBy("conv_id").agg(F.max("n_messages").alias("m"), F.sum("n_messages").alias("n")).collect()
    assert {(r["conv_id"], r["n"]) for r in sizes} == {(1, 2000), (2, 2000)} and all(r["m"] <= 100 for r in sizes)
    assert chat.rotate(turns.filter("false")).count() == 0


def test_rotation_with_repeats_against_sql(spark, tmp_path):
    """Blocks below and above the size of a part, turns and whole rows that repeat, texts and names that hold marks."""
    rng = random.Random(3)
    rows = [(c, rng.randrange(3), rng.choice(["ann", "bob", "system", "e\nve", "<|im_start|>x", None]), rng.choice(["hi", "yes <|im_end|>\n<|im_start|>assistant\nno", None, f"t{rng.randrange(99)}"])) for c, n in ((1, 10), (2, 255), (3, 256), (4, 257), (5, 5000)) for _ in range(n)]
    rows += [(6, 1, "ann", "same")] * 1000 + [(None, None, "ann", "x")] * 3
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    plain = duckdb.connect()
    plain.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert not differences(spark, plain, Q.QUERIES["op3_perspective_rotation"], chat.OP3_SQL, f"file://{tmp_path}")
    for r in Q.QUERIES["op3_perspective_rotation"](spark, f"file://{tmp_path}").collect():
        assert r["n_messages"] <= 256 and r["text"].count(chat.START) == r["n_messages"] == r["text"].count(chat.END)


# Pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(11)
    langs = {"en": "the of and to in with that for is was".split(), "de": "der die und das mit für nicht auf ein zu".split()}
    rows = []
    for i in range(120):
        lang = ["en", "de"][i % 2]
        rows.append((i, " ".join(rng.choice(langs[lang]) + rng.choice("abcdefgh") for _ in range(rng.randrange(30, 90))), lang, f"s{i % 4}", 0))
    bench = " ".join(f"quiz{i}" for i in range(20))
    rows += [(200, rows[3][1].upper(), "en", "s1", 0), (201, rows[5][1] + " tail", "de", "s1", 0), (202, "!!! 123", "en", "s0", 0), (203, None, None, None, 0), (204, rows[7][1] + " " + bench, "de", None, 0), (205, rows[9][1], "de", "s2", 0), (205, rows[9][1], "de", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, f"file://{tmp_path}").collect()
    best = {}
    for r in rows:
        if r[1] and re.search(r"[^\W\d_]", r[1]) and (low(r[1]) not in best or best[low(r[1])][0] < r[0]):
            best[low(r[1])] = r
    kept = list(best.values())
    sets = [set(simhash.shingles(r[1].encode(), 5)) for r in kept]
    comp = brute_components([r[0] for r in kept], lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = [r for r, c in zip(kept, comp, strict=True) if r[0] == c]
    kept = [r for r in kept if bench not in r[1]]
    size = {r[0]: len(words(r[1])) for r in kept}
    mix = {r["doc_id"]: (r["taken"], r["positions"]) for r in mixing.mix_sources(spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    taken = collections.Counter()
    for r in got:
        taken[r["doc_id"]] += r["mix_words"]
    assert taken == {i: t for i, (t, _) in mix.items() if t}
    assert sorted(r["mix_position"] for r in got) == sorted(p for _, at in mix.values() for p in at)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), abs=5)
    assert [name for name, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "mixing"]


def test_language_stage_drops_what_is_in_no_language(spark):
    from tidemark.llm import stages

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(4)
    letters = sorted({c for r in d.select("text").limit(50).collect() for c in (r["text"] or "").lower() if c.isalpha()})
    noise = [(10_000_000 + i, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(60)), None, "n", 0) for i in range(200)]
    both = d.unionByName(spark.createDataFrame(noise, d.schema))
    left = {r["doc_id"] for r in stages.language_stage(spark, both, SF).select("doc_id").collect()}
    assert sum(i >= 10_000_000 for i in left) < 80
    assert sum(i < 10_000_000 for i in left) > 0.99 * d.filter(F.col("text").rlike(r"\p{L}")).count()


def test_stages_hold_few_texts_at_a_time(spark, monkeypatch):
    from tidemark.llm import stages
    from tidemark.sources.shared import materialize

    most = simhash.BATCH_ROWS

    def bounded(make):
        def made(*how, **more):
            own = make(*how, **more)

            def run(batches):
                def each():
                    for b in batches:
                        if b.num_rows > most:
                            raise ValueError(f"{b.num_rows} rows at a time")
                        yield b

                yield from own(each())

            return run

        return made

    for module, name in ((language_id, "_predict"), (exact_dedup, "_compare_neighbours"), (simhash, "_sketch"), (simhash, "_candidates"), (simhash, "_shingle_sets"), (simhash, "_verify")):
        monkeypatch.setattr(module, name, bounded(getattr(module, name)))
    d = docs(spark, [(i, f"one of {i} many texts of words and numbers as {i % 4} they come", "s") for i in range(3 * most)]).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for stage in (stages.language_stage, stages.exact_stage, stages.near_stage):
        assert stage(spark, d, SF).count() <= 3 * most
    sizes = lambda rows: (type(b).from_pydict({"n": [b.num_rows]}) for b in rows)
    assert {r["n"] for r in materialize(spark.range(0, 100, 1, 1).mapInArrow(sizes, "n long"), "sizes", 40).collect()} == {40, 20}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_stages_on_odd_and_empty_tables(spark):
    from tidemark.llm import stages

    d = docs(spark, ODD).withColumn("key", F.lit(1)).withColumn("row", F.lit("r")).withColumn("_t", F.lit(2))
    texts = lambda out: sorted(map(str, ((r["doc_id"], r["text"] and r["text"][:9]) for r in out.collect())))
    want = {
        "exact_dedup": [(2, ""), (3, "  \n\t "), (5, "same text"), (6, "same text"), (7, "word word"), (8, "Ünïcode Ä"), (9, "ünïcode ä"), (10, "!!! 123 ?")],
        "near_dedup": [(1, None), (4, "Same Text"), (7, "word word"), (8, "Ünïcode Ä"), (9, "ünïcode ä"), (10, "!!! 123 ?"), (None, "same text"), (None, None)],
        "decontamination": [(i, t and t[:9]) for i, t, _ in ODD],
    }
    for name, stage in stages.STAGES:
        empty = stage(spark, d.filter("false"), SF)
        assert empty.count() == 0 and empty.columns[: len(d.columns)] == d.columns
        out = stage(spark, d, SF)
        assert out.columns[: len(d.columns)] == d.columns
        if name in want:
            assert texts(out) == sorted(map(str, want[name]))
        assert name != "language_id" or {r["doc_id"] for r in out.collect()} <= {4, 5, 6, 7, 8, 9, None}


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        assert 0 < out.count() <= d.count()
