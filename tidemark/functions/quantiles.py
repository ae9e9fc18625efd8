"""Exact quantiles of many columns and groups, by radix selection: at most two scans of the table, no shuffle of its values.

A value's cell is its sign, its binary exponent and the leading bits of its mantissa, so that cells are in the order of the values. One
aggregate counts the cells of all columns and groups; the counts tell which cell holds each wanted rank. A second scan keeps
only the values of those cells and ranks them. Where a cell holds more than ``MOST`` values, they are written to the shared
folder first and cells of more bits select inside them, so no task ranks more than that, whatever the number of rows (but for equal values, which are counted).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import materialize

#: Bits of the mantissa in a cell; each further round adds as many.
BITS = 8
#: Different values of a cell that are ranked in one task.
MOST = 1_000_000
#: Up to so many wanted cells, counted, are sent to all tasks.
SENT = 200_000


def _name(q: float) -> str:
    return f"q{q * 100:g}".replace(".", "_")


def _ranks(n: Column, q: float, interpolation: str) -> tuple[Column, Column]:
    """The two ranks, counted from 0, between which a quantile of n values lies."""
    if interpolation == "nearest":  # half ranks round away from 0
        k = F.round((n - 1) * F.lit(float(q))).cast("long")
        return k, k
    if interpolation == "lower":  # the smallest value with at least a share q at or below it
        k = F.greatest(F.ceil(n * F.lit(float(q)) - 1e-9) - 1, F.lit(0)).cast("long")
        return k, k
    return F.floor((n - 1) * F.lit(float(q)) + 1e-9).cast("long"), F.ceil((n - 1) * F.lit(float(q)) - 1e-9).cast("long")


def _cell(v: Column, bits: int) -> Column:
    """A long that never falls as the value rises. Where the logarithm rounds to a neighbouring exponent the cell is the same."""
    x = F.abs(v.cast("double"))
    exponent = F.greatest(F.floor(F.log2(x)), F.lit(-1074))
    size = ((exponent + 1100) * (1 << bits) + F.floor((x / F.pow(F.lit(2.0), exponent) - 1) * (1 << bits))).cast("long")
    size = F.when(x == float("inf"), F.lit(4000 << bits)).otherwise(size)
    return F.when(x == 0, F.lit(0).cast("long")).when(v.cast("double") < 0, -size).otherwise(size)


def _select(rows: DataFrame, wanted, bits: int) -> DataFrame:
    """(c, g, at, v) of ``rows`` (c, g, v, n: a column's number, a group, a value and how often it is there); ``wanted(all)`` gives an
    array of (at, k), the ranks wanted of a group of that many values, or is a table (c, g, at, k)."""
    celled = rows.withColumn("r", _cell(F.col("v"), bits))
    cells = celled.groupBy("c", "g", "r").agg(F.sum("n").alias("s"))
    group = W.partitionBy("c", "g")  # a row for each cell that is not empty
    placed = cells.select("c", "g", "r", "s", (F.sum("s").over(group.orderBy("r")) - F.col("s")).alias("before"), F.sum("s").over(group).alias("all"))
    if callable(wanted):
        asked = placed.select("*", F.explode(wanted(F.col("c"), F.col("all"))).alias("t")).select("*", "t.at", "t.k").drop("t")
    else:
        asked = placed.join(wanted.select(F.col("c").alias("wc"), F.col("g").alias("wg"), "at", "k"), (F.col("c") == F.col("wc")) & (F.col("g") == F.col("wg"))).drop("wc", "wg")
    targets = asked.filter("k >= before AND k < before + s").select(F.struct("c", "g", "r").alias("cell"), "at", (F.col("k") - F.col("before")).alias("k"), "s", "all")
    targets = materialize(targets, "quantile-cells")
    found = targets.agg(F.count("*").alias("n"), F.max("s").alias("s")).first()
    hit = targets.select("cell").distinct()
    kept = celled.join(F.broadcast(hit) if found["n"] <= SENT else hit, F.struct("c", "g", "r") == F.col("cell"), "left_semi")
    counted = kept.groupBy(F.struct("c", "g", "r").alias("cell"), "v").agg(F.sum("n").alias("n"))
    if (found["s"] or 0) > MOST and bits < 48:
        counted = materialize(counted, "quantile-values")
        if counted.groupBy("cell").agg(F.count("*").alias("d")).filter(F.col("d") > MOST).limit(1).count():
            deeper = counted.select(F.col("cell.c").alias("c"), F.col("cell").alias("g"), "v", "n")
            chosen = targets.select(F.col("cell.c").alias("c"), F.col("cell").alias("g"), "at", "k")
            out = _select(deeper, chosen, bits + BITS).select("c", F.col("g.g").alias("g"), F.col("g").alias("cell"), "at", "v")
            return out.join(targets.select(F.col("cell").alias("tc"), F.col("at").alias("ta"), "all"), (F.col("cell") == F.col("tc")) & (F.col("at") == F.col("ta"))).select("c", "g", "at", "v", "all")
    upto = counted.withColumn("upto", F.sum("n").over(W.partitionBy("cell").orderBy("v")))
    mine = targets.select(F.col("cell").alias("tc"), "at", "k", "all")
    return upto.join(mine, F.col("cell") == F.col("tc")).filter("upto > k").groupBy("tc", "at", "all").agg(F.min("v").alias("v")).select(F.col("tc.c").alias("c"), F.col("tc.g").alias("g"), "at", "v", "all")


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[tuple[float, str]]], by: Sequence[str] = ()) -> DataFrame:
    """(key, c, at, lower, upper, all): for the column with number ``c`` of ``wanted`` and its (share, interpolation) with number ``at``
    the values at the two ranks between which it lies, and the number of values. ``key`` is a struct of ``by``. All columns
    share the two scans. Nulls and NaNs are left out. Columns of different types are compared as doubles."""
    if not {how for qs in wanted.values() for _, how in qs} <= {"nearest", "lower", "linear"}:
        raise ValueError("nearest, lower or linear")
    kinds = {dict(df.dtypes)[c] for c in wanted}
    one = kinds.pop() if len(kinds) == 1 else "double"
    value = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`")).cast(one)
    items = F.array(*[F.struct(F.lit(i).alias("c"), value(c).alias("v")) for i, c in enumerate(wanted)])
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_"))
    rows = df.select(group.alias("g"), F.explode(items).alias("x")).select("x.c", "g", "x.v", F.lit(1).cast("long").alias("n")).filter("v is not null")

    def ranks(c, n):
        out = None
        for i, qs in enumerate(wanted.values()):
            own = F.array(*[F.struct(F.lit(2 * j + e).alias("at"), k.alias("k")) for j, (q, how) in enumerate(qs) for e, k in enumerate(_ranks(n, q, how)) if e == 0 or how == "linear"])
            out = F.when(c == i, own) if out is None else out.when(c == i, own)
        return out

    long = _select(rows, ranks, BITS)
    at = lambda e: F.max(F.when(F.col("at") % 2 == e, F.col("v")))
    return long.groupBy(F.col("g").alias("key"), "c", F.floor(F.col("at") / 2).cast("int").alias("at"), "all").agg(at(0).alias("lower"), at(1).alias("upper"))


def _value(q: float, interpolation: str) -> Column:
    if interpolation != "linear":
        return F.col("lower")
    n = F.col("all")
    part = (n - 1) * F.lit(float(q)) - F.floor((n - 1) * F.lit(float(q)) + 1e-9)
    return (F.col("lower") + (F.col("upper") - F.col("lower")) * part).cast("double")


def wide(df: DataFrame, names: Mapping[str, tuple], by: Sequence[str] = (), interpolation: str = "linear") -> DataFrame:
    """One row per group with a column for each name -> (column, share) or (column, share, interpolation); a group without any value
    gives no row (without ``by``: a row of nulls). All columns and shares take two scans."""
    full = {n: (c, q, *(how or [interpolation])) for n, (c, q, *how) in names.items()}
    cols: dict[str, list[tuple[float, str]]] = {}
    for c, q, how in full.values():
        if (q, how) not in cols.setdefault(c, []):
            cols[c].append((q, how))
    numbers = {c: i for i, c in enumerate(cols)}
    long = quantiles(df, cols, by)
    pick = [F.max(F.when((F.col("c") == numbers[c]) & (F.col("at") == cols[c].index((q, how))), _value(q, how))).alias(n) for n, (c, q, how) in full.items()]
    if not by:
        return long.agg(*pick)
    return long.groupBy("key").agg(*pick).select(*[F.col(f"key.`{c}`").alias(c) for c in by], *[F.col(f"`{n}`") for n in names])


def quantile(df: DataFrame, col: str, q: Sequence[float] | float, by: Sequence[str] = (), interpolation: str = "nearest") -> DataFrame:
    """One row per group with columns q<percent>: the value at the nearest rank, ``lower``, or ``linear`` between two. Nulls and
    NaNs are left out; a group without values gives no row (without ``by``: a row of nulls)."""
    qs = [q] if isinstance(q, (int, float)) else list(q)
    return wide(df, {_name(x): (col, x) for x in qs}, by, interpolation)


def with_quantiles(grouped: DataFrame, df: DataFrame, col: str, qs: dict[str, float], by: Sequence[str] = (), interpolation: str = "linear") -> DataFrame:
    """``grouped`` (a row for each group of ``by``) with columns of quantiles of ``df``: name -> share."""
    found = wide(df, {k: (col, x) for k, x in qs.items()}, by, interpolation)
    found = found.select(F.struct(*by).alias("_key") if by else F.lit(0).alias("_key"), *qs)
    keyed = grouped.withColumn("_key", F.struct(*by) if by else F.lit(0))
    return keyed.join(found, "_key", "left").drop("_key")
