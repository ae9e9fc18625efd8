"""Repair of conversation structure: the cheapest edits that make the roles of a dialogue alternate and drop broken turns.

Every turn becomes one symbol (its role's initial and its fault). The symbols of a conversation are cut into blocks of
bounded size; all blocks of all conversations, in the order of their reversed symbols, pass through an automaton that shares
suffixes: a node stands for one suffix, and its cost-to-go and best edit to each grammar state are computed once, when
the first block that ends so arrives. The blocks of a conversation are then folded from the last to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, send_if_small, table

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Grammar states of ``(s?(ua)+)?``: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Role initial -> state before -> state after.
FITS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
#: State -> the only state that a new or renamed message can lead to, and that message's role.
ASKS = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What is left to do at the end: state -> inserts.
ENDS = ("", "II", "I", "")
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 50
LEGAL = frozenset(("su", "ua", "au"))
FIRST = -(1 << 63)


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties
    its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes its role user. Nulls count as one space (a turn stays null)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    role = F.when(kind == 4, "user").otherwise(space(role_col))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"), kind.alias("_kind"))
    return rows.filter("_kind <> 0").drop("_kind")


def _symbol(role: Column, text: Column) -> Column:
    """A role's initial (``o``: another), in capitals if the text is truncated; ``-``: blank, to be deleted."""
    bare = F.rtrim(text, F.lit(BLANKS))
    initial = F.substring(role, 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(bare == "", "-").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), letter).otherwise(F.upper(letter))


def lay_out(rows: DataFrame, block: int = 64) -> DataFrame:
    """(conv, place, items, symbols): the damaged rows in blocks of at most about ``block`` different messages, written to the
    shared folder. ``place`` orders a conversation's blocks; ``items`` are (at, mark, role, text, copies, fault, symbol) in order.

    Rows that repeat all columns are one item with a number of copies. A block holds ``block`` consecutive turn numbers; where
    these have more messages, each turn is cut by leading digits of the messages' hashes, so no task gets a whole conversation.
    """
    mark = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))
    at = F.coalesce(F.col("turn"), F.lit(FIRST))
    rows = rows.select(F.struct("conv_id").alias("conv"), at.alias("at"), mark.alias("mark"), "role", "text", "copies")
    alike = rows.groupBy("conv", "at", "mark").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").alias("copies"))
    alike = alike.withColumn("span", F.floor(F.col("at") / block).cast("long"))
    narrow = rows.select("conv", "at", "mark").withColumn("span", F.floor(F.col("at") / block).cast("long"))
    # Messages said at several turns, and spans of more messages than a block holds: both few, counted, by narrow columns.
    repeated = narrow.groupBy(F.col("conv").alias("r_conv"), F.col("mark").alias("r_mark")).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    repeated = send_if_small(repeated.filter("first_at < last_at").drop("last_at"), "repeated-messages")
    full = narrow.groupBy(F.col("conv").alias("f_conv"), F.col("span").alias("f_span")).agg(F.count("*").alias("held")).filter(F.col("held") > block)
    full = send_if_small(full, "full-spans")
    known = alike.join(repeated, (F.col("conv") == F.col("r_conv")) & (F.col("mark") == F.col("r_mark")), "left")
    known = known.join(full, (F.col("conv") == F.col("f_conv")) & (F.col("span") == F.col("f_span")), "left")
    large, digits = F.col("held").isNotNull(), F.ceil(F.log(16.0, F.col("held") / block)).cast("int")
    place = F.struct("span", F.when(large, F.col("at")).otherwise(0).alias("turn"), F.when(large, F.substring(F.col("mark"), F.lit(1), digits)).otherwise("").alias("cell"))
    symbol = _symbol(F.col("role"), F.col("text"))
    seen = F.coalesce(F.col("at") > F.col("first_at"), F.lit(False))
    fault = F.when(symbol == "-", "blank").when(seen, "duplicate").when(symbol == F.upper(symbol), "truncated").otherwise("")
    marked = known.select("conv", place.alias("place"), "at", "mark", "role", "text", "copies", fault.alias("fault"), F.when(seen, "-").otherwise(symbol).alias("symbol"))
    items = F.array_sort(F.collect_list(F.struct("at", "mark", "role", "text", "copies", "fault", "symbol")))
    blocks = marked.groupBy("conv", "place").agg(items.alias("items"))
    spelled = F.transform("items", lambda x: F.concat(x["symbol"], F.repeat(F.lit("-"), (x["copies"] - 1).cast("int"))))
    return materialize(blocks.withColumn("symbols", F.array_join(spelled, "")), "conversation-blocks")


class Node:
    """A suffix of symbols: for each state before it and state after it the least cost and the first edit of the ASCII-least
    cheapest edits. Inserts stand before the edit of a row; those at a conversation's end are added by the fold.

    From one state each edit leads to one state, so equal costs are told apart by their first letter alone."""

    __slots__ = ("cost", "edit", "symbol")

    def __init__(self, symbol: str | None, rest: Node | None):
        self.symbol = symbol
        if rest is None:
            self.cost = [[0 if s == t else NEVER for t in range(4)] for s in range(4)]
            self.edit = None
            return
        role, extra = (symbol or "").lower(), TRUNCATED if symbol != "-" and symbol.isupper() else 0
        self.cost, self.edit = [[0] * 4 for _ in range(4)], [[""] * 4 for _ in range(4)]
        for t in range(4):
            best = []
            for s in range(4):
                ways = [(DELETE + rest.cost[s][t], "D")]
                if symbol != "-":
                    if s in FITS[role]:
                        ways.append((extra + rest.cost[FITS[role][s]][t], "K"))
                    ways.append((RENAME + extra + rest.cost[ASKS[s]][t], "R"))
                best.append(min(ways))
            plain = list(best)
            best[USER] = min(plain[USER], (INSERT + plain[ASSISTANT][0], "I"))
            best[ASSISTANT] = min(plain[ASSISTANT], (INSERT + plain[USER][0], "I"))
            best[NOTHING] = min(plain[NOTHING], (INSERT + best[USER][0], "I"))
            best[SYSTEM] = min(plain[SYSTEM], (INSERT + best[USER][0], "I"))
            for s in range(4):
                self.cost[s][t], self.edit[s][t] = best[s]


class SuffixAutomaton:
    """Nodes of the suffixes of symbol strings that come in the order of their reversed symbols: only the nodes of the last
    string are held, and a suffix that the next string shares keeps its node. ``made`` counts nodes."""

    def __init__(self):
        self.stack, self.made = [Node(None, None)], 0

    def walk(self, symbols: str) -> list[Node]:
        backwards = symbols[::-1]
        shared = 0
        while shared < len(backwards) and shared + 1 < len(self.stack) and self.stack[shared + 1].symbol == backwards[shared]:
            shared += 1
        del self.stack[shared + 1 :]
        for c in backwards[shared:]:
            self.stack.append(Node(c, self.stack[-1]))
            self.made += 1
        return self.stack

    def edits(self, symbols: str) -> tuple[list[int], list[str]]:
        """Costs and edits from each state before to each state after, row by row."""
        stack = self.walk(symbols)
        costs, audits = [], []
        for s in range(4):
            for t in range(4):
                cost = stack[-1].cost[s][t]
                costs.append(min(cost, NEVER))
                out, at = [], s
                for node in stack[:0:-1] if cost < NEVER else ():
                    while (edit := node.edit[at][t]) == "I":
                        out.append("I")
                        at = ASKS[at]
                    out.append(edit)
                    at = FITS[node.symbol.lower()][at] if edit == "K" else ASKS[at] if edit == "R" else at
                audits.append("".join(out))
        return costs, audits


def fold(blocks: list[tuple[list[int], list[str]]]) -> tuple[int, list[str]]:
    """Cheapest edits of the blocks of one conversation, the ASCII-least of equal ones, in pieces by block. Two ways through a
    block from one state differ before the block's last edit, so comparing the block's own edits is enough."""
    costs = [len(e) * INSERT for e in ENDS]
    chosen = []
    for cost, audits in reversed(blocks):
        best = [min((cost[4 * s + t] + costs[t], audits[4 * s + t], t) for t in range(4)) for s in range(4)]
        chosen.append([(audit, t) for _, audit, t in best])
        costs = [min(c, NEVER) for c, _, _ in best]
    pieces, state = [], NOTHING
    for step in reversed(chosen):
        audit, state = step[state]
        pieces.append(audit)
    if pieces:
        pieces[-1] += ENDS[state]
    return costs[NOTHING], pieces


def apply_edits(items: list[dict], edits: str, state: int) -> tuple[list[dict], int]:
    """The messages (role, text) that are left of a block, and the grammar state after it."""
    rows = ((x["role"], x["text"]) for x in items for _ in range(x["copies"]))
    out = []
    for e in edits:
        if e == "I":
            state = ASKS[state]
            out.append({"role": ROLES[state], "text": ""})
            continue
        role, text = next(rows)
        if e == "K":
            state = FITS[role[:1]][state]
            out.append({"role": role, "text": text})
        elif e == "R":
            state = ASKS[state]
            out.append({"role": ROLES[state], "text": text})
    return out, state


def repair(turns: DataFrame, rows: DataFrame, block: int = 64, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, part, messages, summary): the repaired messages (role, text) of every conversation of ``turns``, whose rows now
    are ``rows`` (conv_id, turn, role, text, copies), a row for each block; the last row of a conversation has its summary
    (gaps, blank, duplicate, truncated, illegal, cost, audit). Rows of a conversation are together and in order.

    Rows are in the order of their turns, nulls first; equal turns in the order of a hash of role and text. A null conversation
    is one of its own. A conversation without rows has one row without messages; an empty table gives none. A row's first
    fault counts: blank, duplicate (role and text seen earlier), truncated (does not end in ``.!?``). Other columns are ignored.
    Texts stay in blocks; one task sees the blocks of a conversation one after another and holds one letter for each edit.
    """
    blocks = lay_out(rows, block)
    kind = blocks.schema["conv"].dataType["conv_id"].dataType.simpleString()
    matrix = f"conv_id {kind}, place struct<span:long,turn:long,cell:string>, costs array<long>, audits array<string>"

    def resolve(batches: Iterator):
        import pyarrow as pa

        automaton = SuffixAutomaton()
        for batch in batches:
            done = [automaton.edits(s) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in done], pa.list_(pa.int64())), pa.array([a for _, a in done], pa.list_(pa.string()))], names=["conv_id", "place", "costs", "audits"])

    keyed = blocks.select("conv.conv_id", "place", "symbols", F.reverse("symbols").alias("_back"), F.xxhash64("conv", "place").alias("_salt"))
    sorted_ = keyed.repartitionByRange("_back", "_salt").sortWithinPartitions("_back").select("conv_id", "place", "symbols")
    edits = materialize(sorted_.mapInArrow(resolve, matrix), "conversation-edits")

    everyone = turns.select(F.col(conv_col).alias("conv_id")).distinct().withColumn("step", F.lit(0))
    lines = everyone.unionByName(edits.withColumn("step", F.lit(1)), allowMissingColumns=True).unionByName(blocks.select("conv.conv_id", "place", "items", F.lit(2).alias("step")), allowMissingColumns=True)
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "step", "place").select("conv_id", "step", "costs", "audits", "items")
    summary = "struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>"

    def stream(batches: Iterator):
        import pyarrow as pa

        message = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        shape = pa.struct([(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
        now, out, held = None, [], 0

        def flush():
            nonlocal out, held
            cols = list(zip(*out, strict=True)) or [[]] * 4
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (ids, pa.int64(), message, shape), strict=True)], names=["conv_id", "part", "messages", "summary"])
            out, held = [], 0
            return made

        ids = None
        for batch in batches:
            ids = batch.column(0).type
            for conv, step, costs, audits, items in zip(*(batch.column(i) for i in range(5)), strict=True):
                step = step.as_py()
                if step == 0:
                    if now is not None:
                        out.append(now.end())
                    now = _Conversation(conv.as_py())
                elif step == 1:
                    now.blocks.append((costs.as_py(), audits.as_py()))
                else:
                    done = now.add(items.as_py())
                    if done is not None:
                        out.append(done)
                        held += sum(len(m["text"]) for m in done[2])
                if len(out) >= 2000 or held > 8 << 20:
                    yield flush()
        if now is not None:
            out.append(now.end())
        if ids is not None:
            yield flush()

    return lines.mapInArrow(stream, f"conv_id {kind}, part long, messages array<struct<role:string,text:string>>, summary {summary}")


class _Conversation:
    """What one pass over a conversation's blocks, in order, has to remember."""

    def __init__(self, conv):
        self.conv, self.blocks, self.part, self.state = conv, [], 0, NOTHING
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.turns, self.low, self.high, self.illegal, self.before = 0, None, None, 0, None
        self.pieces, self.cost, self.waiting = None, 0, None

    def add(self, items):
        """Take the next block; gives the row of the block before."""
        if self.pieces is None:
            self.cost, self.pieces = fold(self.blocks)
            self.blocks = []
        for x in items:
            fault, k = x["fault"], x["copies"]
            if fault in ("blank", "duplicate"):
                self.faults[fault] += k
            else:
                self.faults["truncated"] += fault == "truncated"
                self.faults["duplicate"] += k - 1
            own = x["role"][:1]
            self.illegal += (self.before is not None and (self.before + own) not in LEGAL) + (k - 1)
            self.before = own
            if x["at"] != FIRST and x["at"] != self.high:
                self.turns += 1
                self.low, self.high = x["at"] if self.low is None else self.low, x["at"]
        messages, self.state = apply_edits(items, self.pieces[self.part], self.state)
        done, self.waiting = self.waiting, (self.conv, self.part, messages, None)
        self.part += 1
        return done

    def end(self):
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        sums = {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.pieces or ())}
        conv, part, messages, _ = self.waiting or (self.conv, 0, [], None)
        return conv, part, messages, sums


def digest(repaired: DataFrame) -> DataFrame:
    """One row per conversation: its summary and the SHA-256 of its repaired lines ``role:text``, one after another. Takes the rows
    of ``repair`` as they lie, in order, and holds one part of a conversation at a time."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def stream(batches: Iterator):
        import pyarrow as pa

        sha, any_ = hashlib.sha256(), False
        for batch in batches:
            out = []
            for conv, messages, sums in zip(*(batch.column(i) for i in range(3)), strict=True):
                for m in messages.as_py():
                    sha.update((("\n" if any_ else "") + f"{m['role']}:{m['text']}").encode("utf-8"))
                    any_ = True
                sums = sums.as_py()
                if sums is not None:
                    out.append((conv.as_py(), *(sums[n] for n in names), sums["audit"], sha.hexdigest()))
                    sha, any_ = hashlib.sha256(), False
            cols = list(zip(*out, strict=True)) or [[]] * 9
            types = [batch.column(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", *names, "audit", "repaired_sha256"])

    schema = f"conv_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string"
    return repaired.select("conv_id", "messages", "summary").mapInArrow(stream, schema)


def op11_structure_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return digest(repair(turns, damage(turns)))
