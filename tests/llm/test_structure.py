"""Structure repair against a search over all edits, on the whole query and on odd inputs."""

from __future__ import annotations

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidemark.llm import queries as Q
from tidemark.llm import structure_repair as S

SF = "/root/testdata/sf0.001"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """Dijkstra over (rows used, last role); rows are (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        done.add((i, state))
        for r, name in (("u", "user"), ("a", "assistant")):
            if (state, r) in STEP:
                heapq.heappush(heap, (cost + 3, audit + "I", i, r, (*out, (name, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, role[:1]) in STEP:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, STEP[state, role[:1]], (*out, (role, text))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (state, r) in STEP:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, r, (*out, (name, text))))
    raise AssertionError


def plain(rows):
    """conv_id -> the result's other columns, row by row."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        by[conv] += [(turn, role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, own in by.items():
        mark = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, mark(r)))
        seen, marked = set(), []
        for _, role, text in own:
            letters = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        faults = collections.Counter(f for *_, f in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, left = cheapest(marked)
        text = "\n".join(f"{r}:{t}" for r, t in left)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


COLS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in COLS) for r in rows}


def test_whole_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(Q.QUERIES["op11_structure_repair"](spark, SF)) == plain(rows)


@pytest.mark.parametrize("block", [2, 64])
def test_odd_and_long_conversations(spark, block):
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, 0, "system", ""), (2, 0, "", "no role."), (2, 0, "", "no role."), (2, None, "user", "a"), (2, None, "User", "b.")]
    rows += [(3, t, rng.choice(["user", "assistant", "system", "other", None]), rng.choice(["One.", "Two!", "three", " ", None, "Vier? \n", "ü" * 3000 + "."])) for t in range(150)]
    rows += [(4, 7, "user", "Same.")] * 90 + [(4, 7, rng.choice(["user", "assistant"]), f"{i}.") for i in range(150)]
    rows += [(5, -3, "assistant", "Ende."), (5, 9, "user", "x?")]
    rows += [(c, t, rng.choice("usaxu") + "ser", rng.choice(["A.", "B.", "c", ""])) for c in range(10, 120) for t in range(rng.randrange(12))]
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "conv_id long, turn long, role string, text string, at int, place string, symbols int").repartition(7)
    assert result(S.digest(S.repair(df, S.damage(df), block))) == plain(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert S.digest(S.repair(df, S.damage(df))).count() == 0


def test_messages_and_other_types_of_identifier(spark):
    df = spark.createDataFrame([("x", 0, "user", "Hi."), ("x", 1, "user", "Ho."), ("x", 2, "assistant", "He.")], "conv_id string, turn int, role string, text string")
    rows = S.repair(df, df.selectExpr("*", "1L AS copies")).collect()
    assert [[tuple(m) for m in r["messages"]] for r in rows] == [[("user", "Hi."), ("assistant", ""), ("user", "Ho."), ("assistant", "He.")]]
    assert rows[0]["summary"]["audit"] == "KIKK"


def test_a_shared_suffix_has_one_node():
    a = S.SuffixAutomaton()
    for s in sorted(["uaua", "uuua", "uA", "uaua"], key=lambda s: s[::-1]):
        costs, audits = a.edits(s)
    assert a.made == len({s[i:] for s in ("uaua", "uuua", "uA") for i in range(len(s))})
    assert S.fold([a.edits("uaua")]) == (0, ["KKKK"])
    assert S.fold([a.edits("u")]) == (3, ["KI"])
    assert S.fold([]) == (0, [])
