"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select. DataFrame functions only.

Narrow patterns with checks (part sizes, Luhn, digit counts) give base spans, which always stay. Wide patterns propose overlapping
candidates: the same data written with other separators, without a plus, or with its signs spelled out. Trees that read the format and the
surroundings of a candidate are grown on all the corpus's own candidates: those that are base spans are positive, those
that fail the checks negative, and both also stand there in disguise, so that the other ways of writing are learned. What scores at
least its kind's threshold, and overlaps no base span and no better candidate, is added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import inf, nextafter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Base patterns. Where a match can begin is stated, and repeats give nothing back, so that the time is linear in the text; the
#: matches are those of the plain patterns (a run of a class is entered at its beginning or where the match before has ended).
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:@|\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\.|\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20)"
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]++(?:[\x20._/-]{1,2}+[0-9]++)*+(?![A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])\+?\(?[0-9][0-9\x20()./-]{5,22}[0-9](?![0-9A-Za-z])",
}
#: Cheap conditions without which neither pattern of a kind can match.
MAY = {"email": r"@|dot|DOT", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
#: Words that announce a kind.
ANNOUNCE = {
    "email": r"(?i)mail|contact|write|reach|address",
    "ip": r"(?i)\bip\b|host|server|addr|client|node|login",
    "card": r"(?i)card|visa|master|amex|credit|debit|\bcc\b|pay",
    "phone": r"(?i)phone|\btel|call|fax|mobile|cell|sms|dial",
}
#: Code points of surroundings that are looked at.
BEFORE, AFTER = 30, 8
FEATURES = ("kind", "digits", "luhn", "groups", "longest_group", "shortest_group", "distinct_digits", "plus", "brackets", "separators", "letters", "octets", "spelled", "last_part", "length", "announced", "joined_before", "joined_after", "first_digit")
_CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str) -> Column:
    """All matches, left to right: (start, end, text, before, after). Places are sums of the lengths of the pieces between and of the
    matches, in two levels, so that a text of many matches needs no array of sums for each."""
    size = lambda c: F.char_length(c).cast("long")
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")

    def placed(s):
        steps = F.transform(s["m"], lambda v, i: size(v) + size(F.get(s["g"], i)))
        return let(steps, lambda st: let(chunks(st), lambda base: F.transform(s["m"], lambda v, i: span(s, st, base, v, i))))

    def chunks(st):
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(st) / _CHUNK).cast("int")), lambda c: F.aggregate(F.slice(st, c * _CHUNK + 1, _CHUNK), zero, add))
        return F.aggregate(sums, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def span(s, st, base, v, i):
        start = F.get(base, F.floor(i / _CHUNK).cast("int")) + F.aggregate(F.slice(st, i - i % _CHUNK + 1, i % _CHUNK), zero, add) + size(F.get(s["g"], i))
        return let(start, lambda a: F.struct(a.alias("start"), (a + size(v)).alias("end"), v.alias("text"), F.right(F.get(s["g"], i), F.lit(BEFORE)).alias("before"), F.left(F.get(s["g"], i + 1), F.lit(AFTER)).alias("after")))

    return let(F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m")), placed)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    return F.call_function("luhn_check", d)


def _octet(p: Column) -> Column:
    return let(F.ltrim(p, F.lit("0")), lambda x: (F.char_length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))


def valid(kind: str, v: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), _octet)
    low, high = (16, 19) if kind == "card" else (8, 15)
    return let(_digits(v), lambda d: F.char_length(d).between(low, high) & (_luhn(d) if kind == "card" else F.lit(True)))


def base_spans(text: Column, kind: str) -> Column:
    """Matches of the base pattern that pass the check; failing ones take their place in the text all the same."""
    return F.filter(F.when(text.rlike(MAY[kind]), _matches(text, BASE[kind])).otherwise(F.array().cast(_SPANS)), lambda s: valid(kind, s["text"]))


_SPANS = "array<struct<start:long,end:long,text:string,before:string,after:string>>"


def _hidden_cards(s: Column) -> Column:
    """Runs of a match's digit groups with one way of parting them, but not the match itself, that pass the check of a card: a card
    stands next to another number there."""

    def runs(g):
        start = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.size(g) - i, F.lit(19))), lambda k: F.struct(F.slice(g, i + 1, k).alias("g"), (k == F.size(g)).alias("whole")))
        ok = lambda r: ~r["whole"] & let(F.array_join(F.transform(r["g"], lambda x: x["text"]), ""), lambda d: F.char_length(d).between(16, 19) & _luhn(d))
        return F.flatten(F.transform(g, lambda _, i: F.transform(F.filter(start(i), ok), lambda r: span(r["g"][0]["start"], F.element_at(r["g"], -1)["end"]))))

    def span(a, b):
        cut = lambda low, size: F.substring(s["text"], low.cast("int"), size.cast("int"))
        before = F.right(F.concat(s["before"], cut(F.lit(1), a)), F.lit(BEFORE))
        after = F.left(F.concat(cut(b + 1, F.lit(AFTER)), s["after"]), F.lit(AFTER))
        return F.struct((s["start"] + a).alias("start"), (s["start"] + b).alias("end"), cut(a + 1, b - a).alias("text"), before.alias("before"), after.alias("after"))

    many = (F.char_length(_digits(s["text"])) > 16) & s["text"].rlike("[0-9][^0-9]+[0-9]")
    alike = lambda r: F.size(F.array_distinct(F.filter(F.split(r["text"], "[0-9]+"), lambda p: p != ""))) <= 1
    return F.when(many, F.filter(let(_matches(s["text"], "[0-9]+"), runs), alike)).otherwise(F.array().cast(_SPANS))


def wide_spans(text: Column, kind: str) -> Column:
    """Candidates. Numbers need 12 to 19 digits to be a card, 8 to 15 to be a phone. Where a match has more numbers than a card, the cards in it
    are candidates too."""
    found = F.when(text.rlike(MAY[kind]), _matches(text, WIDE[kind])).otherwise(F.array().cast(_SPANS))
    if kind == "card":
        found = let(found, lambda f: F.concat(f, F.flatten(F.transform(f, _hidden_cards))))
    if kind in ("card", "phone"):
        low, high = (12, 19) if kind == "card" else (8, 15)
        return F.filter(found, lambda s: F.char_length(_digits(s["text"])).between(low, high))
    return found


def features(kind: Column, v: Column, before: Column, after: Column) -> Column:
    """The array of ``FEATURES`` of a candidate."""
    yes = lambda c: c.cast("double")
    announced = reduce(lambda a, k: F.when(kind == k, before.rlike(ANNOUNCE[k])).otherwise(a), KINDS, F.lit(False))

    def row(s):
        d, parts = s["d"], s["g"]
        sizes = F.transform(parts, F.char_length)
        octets = F.when((F.size(parts) == 4) & F.forall(parts, _octet), 1.0).otherwise(0.0)
        last = F.char_length(F.regexp_extract(v, "([A-Za-z]*)$", 1)).cast("double")
        return F.array(
            reduce(lambda a, x: F.when(kind == x[1], float(x[0])).otherwise(a), enumerate(KINDS), F.lit(-1.0)),
            F.char_length(d).cast("double"), yes(F.coalesce(_luhn(F.when(d != "", d)), F.lit(False))), F.size(parts).cast("double"),
            F.coalesce(F.array_max(sizes).cast("double"), F.lit(0.0)), F.coalesce(F.array_min(sizes).cast("double"), F.lit(0.0)), F.size(F.array_distinct(F.split(d, ""))).cast("double"),
            yes(v.startswith("+") | v.startswith("00")), yes(v.contains("(")), F.size(F.array_distinct(F.split(F.regexp_replace(v, r"[0-9A-Za-z]", ""), ""))).cast("double"),
            F.char_length(F.regexp_replace(v, "[^A-Za-z]", "")).cast("double"), octets, yes(v.rlike(r"(?i)[\[({<]|\bat\b|\bdot\b")), last, F.char_length(v).cast("double"), yes(announced),
            yes(before.rlike(r"[0-9A-Za-z._=/-]$")), yes(after.rlike(r"^[0-9A-Za-z_=/-]")), F.coalesce(F.left(d, F.lit(1)).try_cast("double"), F.lit(-1.0)),
        )

    return let(F.struct(_digits(v).alias("d"), F.filter(F.split(v, "[^0-9]+"), lambda p: p != "").alias("g")), row)


def disguises(kind: Column, v: Column) -> Column:
    """Other ways to write a candidate, as an array of texts."""
    spell = lambda c, at, dot: F.replace(F.replace(c, F.lit("@"), F.lit(at)), F.lit("."), F.lit(dot))
    domain = F.substring_index(v, "@", -1)
    local = F.substring_index(v, "@", 1)
    email = F.array(*[F.concat(local, F.lit(at), F.replace(domain, F.lit("."), F.lit(dot))) for at, dot in ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."))])
    ip = F.array(spell(v, "@", "[.]"), spell(v, "@", " dot "), spell(v, "@", "(.)"))
    joined = F.regexp_replace(v, r"[\x20._/-]+", "")
    card = F.array(*[F.regexp_replace(joined, r"([0-9]{4})(?=[0-9])", f"$1{sep}") for sep in (".", "/", "_", "  ")])
    bare = F.regexp_replace(v, r"^\+", "")
    grouped = F.size(F.filter(F.split(v, "[^0-9]+"), lambda p: p != "")) > 2
    phone = F.when(grouped, F.array(bare, F.concat(F.lit("00"), bare), F.regexp_replace(bare, r"[\x20().-]+", "."), F.regexp_replace(bare, r"[\x20().-]+", "/"))).otherwise(F.array().cast("array<string>"))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).otherwise(phone)


def spoiled(kind: Column, v: Column) -> Column:
    """A base span changed so that it fails its check (null for kinds without one): a part over 255, another last digit."""
    ip = F.concat((F.substring_index(v, ".", 1).try_cast("int") + 256).cast("string"), F.lit("."), F.substring_index(v, ".", -3))
    card = F.concat(F.left(v, F.char_length(v) - 1), F.translate(F.right(v, F.lit(1)), "0123456789", "1234567890"))
    return F.when(kind == "ip", ip).when(kind == "card", card)


@dataclass(frozen=True)
class Model:
    """Trees in the order of the heap, knots of the calibration, and the least score of each kind that is selected."""

    base: float
    trees: list[tuple[list[int], list[float], list[float]]]
    knots: list[tuple[float, float]]
    least: dict[str, float]

    def margin(self, x: Column) -> Column:
        """Sum of the leaves that an array of features reaches."""
        literal = F.array(*[F.struct(F.array(*map(F.lit, f)).alias("f"), F.array(*map(F.lit, h)).alias("h"), F.array(*map(F.lit, v)).alias("v")) for f, h, v in self.trees])

        def leaf(t, node):
            if node >= 7:
                return t["v"][node - 7]
            return F.when(F.get(x, t["f"][node]) >= t["h"][node], leaf(t, 2 * node + 2)).otherwise(leaf(t, 2 * node + 1))

        return F.aggregate(literal, F.lit(self.base), lambda a, t: a + leaf(t, 0))

    def score(self, x: Column) -> Column:
        """Calibrated probability of an array of features."""
        if not self.trees:
            return F.lit(0.0)
        return let(self.margin(x), self.calibrated)

    def calibrated(self, m: Column) -> Column:
        steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in self.knots])
        return F.aggregate(steps, F.lit(0.0), lambda a, s: F.when(m >= s["k"], s["p"]).otherwise(a))


#: Finds no candidate; for corpora without base spans to learn from.
NO_MODEL = Model(0.0, [], [], {k: 2.0 for k in KINDS})


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, text, before, after, label): a row for each candidate that is a base span (1) or overlaps none of its kind (0)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = F.array(*[F.struct(F.lit(k).alias("kind"), base_spans(text, k).alias("base"), wide_spans(text, k).alias("wide")) for k in KINDS])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(both).alias("b")).select("doc_id", "b.kind", "b.base", "b.wide").filter(F.size("wide") > 0)
    long = rows.select("doc_id", "kind", "base", F.explode("wide").alias("w"))
    own = F.exists("base", lambda b: (b["start"] == F.col("w.start")) & (b["end"] == F.col("w.end")))
    part = F.exists("base", lambda b: (b["start"] < F.col("w.end")) & (b["end"] > F.col("w.start")))
    return long.withColumn("label", F.when(own, 1).when(~part, 0)).filter("label is not null").select("doc_id", "kind", "w.start", "w.text", "w.before", "w.after", "label")


def forms(found: DataFrame) -> DataFrame:
    """(kind, before, after, label, held, text): candidates as they stand, the positive ones also spoiled, and all of these in disguise. ``held``: a quarter
    of the documents, by a hash."""
    kind, seen = F.col("kind"), F.struct("text", "label")
    failing = F.when(F.col("label") == 1, F.struct(spoiled(kind, F.col("text")).alias("text"), F.lit(0).alias("label")))
    held = (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) == 0).alias("held")
    both = found.select("kind", "before", "after", held, F.explode(F.array(seen, failing)).alias("t")).select("kind", "before", "after", "held", "t.*").filter("text is not null")
    return both.select("kind", "before", "after", "label", "held", F.explode(F.concat(F.array("text"), disguises(kind, F.col("text")))).alias("text"))


def _heap(node, weight: float, at: int = 0, depth: int = 0) -> dict[int, tuple]:
    """A fitted tree as {place: (feature, least value that goes right, None)} and, in the last row of the heap, {place: (0, 0.0, value)}."""
    if depth == DEPTH:
        return {at: (0, 0.0, weight * node.prediction())}
    if node.getClass().getSimpleName() == "LeafNode":
        return {at: (0, inf, None)} | _heap(node, weight, 2 * at + 1, depth + 1) | _heap(node, weight, 2 * at + 2, depth + 1)
    split = node.split()
    return {at: (split.featureIndex(), nextafter(split.threshold(), inf), None)} | _heap(node.leftChild(), weight, 2 * at + 1, depth + 1) | _heap(node.rightChild(), weight, 2 * at + 2, depth + 1)


#: Levels of a tree; rows that a node stands for at least; equal rows up to which trees are grown in one task, in a fixed order.
DEPTH, LEAST, TOGETHER = 3, 8, 200_000


def fit(docs: DataFrame, precision: float = 0.98, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from the candidates of all documents and their disguises; those of a quarter of the documents calibrate. Rows with equal features
    are one row with a weight, so what trees are grown on grows far slower than the corpus; all of it stays in Spark. A kind's threshold
    is the least score of at least 0.5 from which on ``precision`` of the calibrating candidates of the kind are positive; a kind without
    positive ones adds nothing."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    x = features(F.col("kind"), F.col("text"), F.col("before"), F.col("after")).alias("x")
    rows = materialize(forms(candidates(docs, id_col, text_col)).select(x, "label", "held").groupBy("x", "label", "held").agg(F.count("*").cast("double").alias("w")), "candidates")
    sizes = {(r["held"], r["label"]): (r["n"], r["w"]) for r in rows.groupBy("held", "label").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    if len(sizes) < 4:
        return NO_MODEL
    few = sum(n for n, _ in sizes.values()) <= TOGETHER
    grown_on = rows.filter("not held").select(array_to_vector("x").alias("_x"), "label", "w", "x")
    grown_on = grown_on.coalesce(1).sortWithinPartitions("x", "label") if few else grown_on
    total = sizes[False, 0][1] + sizes[False, 1][1]
    least = {"minWeightFractionPerNode": (LEAST - 0.5) / total} if total >= 2 * LEAST else {"minInstancesPerNode": LEAST}
    grown = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="w", maxIter=60, maxDepth=DEPTH, stepSize=0.15, maxBins=64, seed=1, **least).fit(grown_on)
    trees = []
    for tree, weight in zip(grown.trees, grown.treeWeights, strict=True):
        heap = _heap(tree._call_java("rootNode"), weight)
        inner, leaves = range(2**DEPTH - 1), range(2**DEPTH - 1, 2 ** (DEPTH + 1) - 1)
        trees.append(([heap[i][0] for i in inner], [heap[i][1] for i in inner], [heap[i][2] for i in leaves]))
    bare = Model(0.0, trees, [], {})
    held = materialize(rows.filter("held").select(F.col("x")[0].cast("int").alias("kind"), "label", "w", bare.margin(F.col("x")).alias("m")).groupBy("kind", "label", "m").agg(F.sum("w").alias("w")), "margins")
    line = IsotonicRegression(featuresCol="m", labelCol="label", weightCol="w").fit(held.withColumn("label", F.col("label").cast("double")))
    steps = Model(0.0, trees, [(float(k), float(p)) for k, p in zip(line.boundaries, line.predictions, strict=True)], {})
    by_score = held.withColumn("p", steps.calibrated(F.col("m"))).groupBy("kind", "p").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("y")).orderBy("kind", "p").collect()  # a row for each step and kind
    thresholds = {}
    for i, kind in enumerate(KINDS):
        own = [r for r in by_score if r["kind"] == i]
        enough = [r["p"] for j, r in enumerate(own) if r["p"] >= 0.5 and sum(q["y"] for q in own[j:]) >= precision * sum(q["n"] for q in own[j:])]
        thresholds[kind] = float(enough[0]) if enough else 2.0
    return Model(0.0, trees, steps.knots, thresholds)


def chosen(known: Column, more: Column) -> Column:
    """Of the spans ``more`` that overlap none of ``known``, by falling score (ties: start, then kind): each that overlaps none taken before it."""
    meets = lambda a, b: (a["start"] < b["end"]) & (a["end"] > b["start"])
    free = F.filter(more, lambda a: ~F.exists(known, lambda b: meets(a, b)))
    order = F.array_sort(F.transform(free, lambda a: F.struct((-a["score"]).alias("o"), a["start"].alias("start"), a["kind_no"].alias("k"), a["end"].alias("end"), a.alias("s"))))
    first = F.transform(F.slice(order, 1, 0), lambda o: o["s"])
    return F.aggregate(order, first, lambda taken, o: F.when(F.exists(taken, lambda b: meets(o, b)), taken).otherwise(F.concat(taken, F.array(o["s"]))))


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, spans): a row for each document; spans are (kind_no, start, end, kind, score, base) by kind as listed and start,
    in code points, the end exclusive.

    Null counts as the empty text; whole texts are read. Base spans have score 1. An added span overlaps no base span, and of added
    spans that overlap the one with the greatest score stays, of equal ones the first; one that overlaps only spans that went stays
    too. Repeated rows give a row each, other columns (but ``keep``) are ignored, an empty table gives no row. All of it is row by row:
    nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def shape(kind, s, score, base):
        return F.struct(F.lit(KINDS.index(kind)).alias("kind_no"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"), F.lit(base).alias("base"))

    def known_of(kind):
        return F.transform(base_spans(text, kind), lambda s: shape(kind, s, F.lit(1.0), True))

    def more_of(kind):
        wide = wide_spans(text, kind)
        wide = F.filter(wide, lambda s: _luhn(_digits(s["text"]))) if kind == "card" else wide  # what fails is none, whatever its score
        made = F.transform(wide, lambda s: shape(kind, s, let(features(F.lit(kind), s["text"], s["before"], s["after"]), model.score), False))
        return F.filter(made, lambda s: s["score"] >= model.least[kind])

    known = F.concat(*[known_of(k) for k in KINDS])
    scored = [more_of(k) for k in KINDS if model.trees and model.least[k] <= 1]
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep], known.alias("_known"), (F.concat(*scored) if scored else F.array_except(known, known)).alias("_more"))
    spans = F.array_sort(F.concat("_known", chosen(F.col("_known"), F.col("_more"))))
    return rows.select(F.col("doc_id").alias(id_col), *keep, spans.alias("spans"))


def redact(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, redacted): the text with each span replaced by its kind in square brackets; of overlapping spans the first
    gives the name and all their text goes."""
    found = find(docs, model, id_col, text_col, keep=(text_col,))
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(a, s):
        fresh = F.concat(a["out"], cut(a["at"], s["start"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = let(F.aggregate(ordered, start, step), lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2147483647))))
    return found.select(id_col, "spans", done.alias("redacted"))


def op13_private_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
