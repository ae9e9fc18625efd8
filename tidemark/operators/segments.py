"""Windows of subjects of any size: a segmented scan.

A window over a subject sorts all of it in one task. Here subjects of more than ``most`` rows are counted first, and their rows,
and only theirs, are cut into segments: sorted by subject and order into ranges of about ``most`` rows by sampled splitters, and
written to the shared folder with the number of their range. Each segment gives a carry (count, sum, least, greatest, first
or last value); the carries, a row for each segment, are scanned; and the window runs inside segments, with the carry added.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import materialize

#: Rows of a subject from which on it is cut.
MOST = 1_000_000

_BEFORE = (W.unboundedPreceding, -1)
_AFTER = (1, W.unboundedFollowing)
#: Frame -> rows of the window; and the segments whose carries are added.
_ROWS = {"upto": (W.unboundedPreceding, 0), "peers": (W.unboundedPreceding, 0), "before": _BEFORE, "from": (W.unboundedPreceding, 0), "after": _BEFORE, "all": (W.unboundedPreceding, W.unboundedFollowing)}
_SEGMENTS = {"upto": _BEFORE, "peers": _BEFORE, "before": _BEFORE, "from": _AFTER, "after": _AFTER}
#: Frames that run in the descending order: a frame that ends at the last row is computed anew for each row, in quadratic time.
_REVERSED = ("from", "after")


@dataclass(frozen=True)
class Running:
    """A column made from the rows of a frame: ``op`` is count, sum, min, max, or last / first (the nearest value that is not null,
    of frames that end / begin at the row). Frames: upto, before, from, after (the row itself in or not), peers (upto, with all rows that
    tie with the row in the order, so that the order of ties has no part in it), all."""

    name: str
    op: str
    value: Column
    frame: str = "upto"

    def __post_init__(self):
        near = {"last": ("upto", "before"), "first": ("from", "after")}.get(self.op)
        if self.op not in ("count", "sum", "min", "max", "last", "first") or self.frame not in _ROWS or (near and self.frame not in near):
            raise ValueError(f"{self.op} over {self.frame}")

    def over(self, w, value: Column | None = None, reverse: bool = False) -> Column:
        """With ``reverse`` the window is in the descending order, whose last value is the first one."""
        v = self.value if value is None else value
        if self.op in ("last", "first"):
            return (F.last if reverse else getattr(F, self.op))(v, ignorenulls=True).over(w)
        return getattr(F, self.op)(v).over(w)

    def carry(self, order: Sequence[str]) -> Column:
        v = self.value
        at = F.when(v.isNotNull(), F.struct(*order))
        return {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.max_by(c, at), "first": lambda c: F.min_by(c, at)}[self.op](v)

    def add(self, own: Column, carried: Column) -> Column:
        if self.op in ("count", "sum"):
            return F.coalesce(own + carried, own, carried)
        return {"min": F.least, "max": F.greatest}.get(self.op, F.coalesce)(own, carried)


def previous(c: str | Column, name: str = "_prev") -> Running:
    """The value of the row before, nulls too, in a struct ``v``."""
    return Running(name, "last", F.struct((F.col(c) if isinstance(c, str) else c).alias("v")), "before")


def following(c: str | Column, name: str = "_next") -> Running:
    return Running(name, "first", F.struct((F.col(c) if isinstance(c, str) else c).alias("v")), "after")


class Segments:
    """Rows by subject (``key``) in an order (column names), as a part of whole subjects and a part of cut ones.

    Nulls are a subject of their own and come first in an order. Rows that tie in the order are in any order, as in a window."""

    def __init__(self, key: Sequence[str], order: Sequence[str], light: DataFrame, heavy: DataFrame | None):
        self.key, self.order, self.light, self.heavy = list(key), list(order), light, heavy

    @classmethod
    def of(cls, df: DataFrame, key: str | Sequence[str], order: Sequence[str], most: int = MOST, counted: DataFrame | None = None) -> Segments:
        """Counts rows by subject (a narrow aggregate) and cuts the large ones; of subjects over ``most`` rows there are few, a row each.
        ``counted``: a table with a row at least for each row of ``df``, by subject, that is cheaper to count; or, with a column ``_n``,
        such counts, of which those up to ``most`` may be left out."""
        keys = [key] if isinstance(key, str) else list(key)
        source = df if counted is None else counted
        number = F.sum("_n") if counted is not None and "_n" in counted.columns else F.count("*")
        sizes = source.groupBy(*keys).agg(number.alias("_n")).filter(F.col("_n") > most)
        large = sizes.agg(F.count("*").alias("k"), F.sum("_n").alias("n")).first()
        if not large["k"]:
            return cls(keys, order, df, None)
        names = sizes.select(F.struct(*keys).alias("_large"))
        own = F.struct(*[F.col(k) for k in keys])
        heavy = df.join(names, own == F.col("_large"), "left_semi")
        cut = heavy.repartitionByRange(max(2, -(-int(large["n"]) // most)), *keys, *order).withColumn("_segment", F.spark_partition_id())
        return cls(keys, order, df.join(names, own == F.col("_large"), "left_anti"), materialize(cut, "segments"))

    def running(self, *specs: Running) -> Segments:
        """Add the columns."""
        light = self._windows(self.light, self.key, specs)
        if self.heavy is None:
            return Segments(self.key, self.order, light, None)
        carries = self.heavy.groupBy(*self.key, "_segment").agg(*[s.carry(self.order).alias(f"_c{i}") for i, s in enumerate(specs)])
        along = W.partitionBy(*self.key).orderBy("_segment")  # a row for each segment of a subject
        scanned = [s.over(along.rowsBetween(*_SEGMENTS.get(s.frame, _ROWS["all"])), F.col(f"_c{i}")) if s.op != "count" else F.sum(f"_c{i}").over(along.rowsBetween(*_SEGMENTS.get(s.frame, _ROWS["all"]))) for i, s in enumerate(specs)]
        carried = carries.select(F.struct(*self.key, "_segment").alias("_carry_at"), *[c.alias(f"_d{i}") for i, c in enumerate(scanned)])
        inside = self._windows(self.heavy, [*self.key, "_segment"], specs)
        joined = inside.join(carried, F.struct(*[F.col(k) for k in self.key], F.col("_segment")) == F.col("_carry_at"))
        made = {s.name: F.col(f"_d{i}") if s.frame == "all" else s.add(F.col(s.name), F.col(f"_d{i}")) for i, s in enumerate(specs)}
        return Segments(self.key, self.order, light, joined.withColumns(made).drop("_carry_at", *[f"_d{i}" for i in range(len(specs))]))

    def _windows(self, df, by, specs):
        def window(s):
            w = W.partitionBy(*by)
            order = [F.desc(c) for c in self.order] if s.frame in _REVERSED else self.order
            if s.frame == "all":
                return w
            return (w.orderBy(*order).rangeBetween if s.frame == "peers" else w.orderBy(*order).rowsBetween)(*_ROWS[s.frame])

        return df.select("*", *[s.over(window(s), reverse=s.frame in _REVERSED).alias(s.name) for s in specs])

    def with_columns(self, columns: dict[str, Column], *drop: str) -> Segments:
        change = lambda d: d.withColumns(columns).drop(*drop) if d is not None else None
        return Segments(self.key, self.order, change(self.light), change(self.heavy))

    def frame(self, *drop: str) -> DataFrame:
        """All rows."""
        out = self.light if self.heavy is None else self.light.unionByName(self.heavy.drop("_segment"))
        return out.drop(*drop)


_PARTIAL = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def rolling(segments: Segments, key: str, at: str, length: int, forward: bool, specs: Sequence[Running], most: int = MOST) -> Segments:
    """Columns over times in (t - length, t], or (t, t + length] with ``forward``; ``at`` is a number such as microseconds.

    Whole subjects use a range window. Of a cut subject equal times are one row first (its partial results). Each row then sends the
    far end of its window into a cut of rows and ends. A row reads its window inside its own segment, its far end's part of the
    segment that it fell into, and the partial results of whole segments between, of which there are at most as many pairs as segments.
    """
    if any(s.op not in _PARTIAL for s in specs):
        raise ValueError("rolling windows have counts, sums, least and greatest values")
    reach = (1, length) if forward else (-length + 1, 0)
    light = segments.light.select("*", *[s.over(W.partitionBy(key).orderBy(at).rangeBetween(*reach)).alias(s.name) for s in specs])
    heavy = segments.heavy
    if heavy is not None:
        done = _rolling_times(heavy, key, at, length, forward, specs, most)
        heavy = heavy.join(done, F.struct(F.col(key), F.col(at)) == F.col("_time"), "left").drop("_time")
    return Segments(segments.key, segments.order, light, heavy)


def _rolling_times(rows: DataFrame, key: str, at: str, length: int, forward: bool, specs: Sequence[Running], most: int) -> DataFrame:
    """(_time, columns): the results for every time of the cut subjects, from two written tables."""
    reach = (1, length) if forward else (-length + 1, 0)
    names = [f"_v{i}" for i in range(len(specs))]
    each = list(zip([_PARTIAL[s.op] for s in specs], names, strict=True))
    times = rows.filter(F.col(at).isNotNull()).groupBy(key, at).agg(*[getattr(F, s.op)(s.value).alias(v) for s, v in zip(specs, names, strict=True)])
    mine = times.select(key, F.explode(F.array(F.struct(F.col(at).alias("at"), F.lit(False).alias("far")), F.struct((F.col(at) + (length if forward else -length)).alias("at"), F.lit(True).alias("far")))).alias("p"), F.col(at).alias("_owner"), *names)
    points = mine.select(key, F.col("p.at").alias("_at"), F.col("p.far").alias("_far"), "_owner", *[F.when(~F.col("p.far"), F.col(v)).alias(v) for v in names])
    parts = max(2, -(-2 * rows.count() // most))
    cut = materialize(points.repartitionByRange(parts, key, "_at").withColumn("_segment", F.spark_partition_id()), "rolling-segments")
    inside = W.partitionBy(key, "_segment").orderBy("_at")
    part = inside.rangeBetween(W.unboundedPreceding, 0) if forward else W.partitionBy(key, "_segment").orderBy(F.desc("_at")).rangeBetween(W.unboundedPreceding, -1)
    seen = cut.select(key, "_owner", "_far", "_segment", *[F.when(F.col("_far"), f(v).over(part)).otherwise(f(v).over(inside.rangeBetween(*reach))).alias(v) for f, v in each])
    pick = lambda c, far: F.max(F.when(F.col("_far") == far, F.col(c)))
    paired = seen.groupBy(key, "_owner").agg(pick("_segment", False).alias("_s"), pick("_segment", True).alias("_r"), *[pick(v, False).alias(f"{v}o") for v in names], *[pick(v, True).alias(f"{v}f") for v in names])
    paired = materialize(paired, "rolling-times")
    low, high = F.least("_s", "_r"), F.greatest("_s", "_r")
    carries = cut.filter(~F.col("_far")).groupBy(F.struct(key).alias("_k"), F.col("_segment").alias("_q")).agg(*[f(v).alias(f"{v}c") for f, v in each])
    pairs = paired.select(F.struct(key).alias("_pk"), "_s", "_r").distinct().filter(high - low > 1)
    between = pairs.select("_pk", F.col("_s").alias("_ps"), F.col("_r").alias("_pr"), F.explode(F.sequence(low + 1, high - 1)).alias("_b"))
    whole = between.join(carries, (F.col("_pk") == F.col("_k")) & (F.col("_b") == F.col("_q"))).groupBy("_pk", "_ps", "_pr").agg(*[f(f"{v}c").alias(f"{v}w") for f, v in each])
    full = paired.join(whole, (F.struct(F.col(key)) == F.col("_pk")) & (F.col("_s") == F.col("_ps")) & (F.col("_r") == F.col("_pr")), "left")
    apart = F.col("_s") != F.col("_r")
    results = [s.add(s.add(F.col(f"{v}o"), F.when(apart, F.col(f"{v}f"))), F.col(f"{v}w")) for s, v in zip(specs, names, strict=True)]
    results = [F.coalesce(c, F.lit(0)) if s.op == "count" else c for c, s in zip(results, specs, strict=True)]
    return full.select(F.struct(F.col(key), F.col("_owner")).alias("_time"), *[c.alias(s.name) for c, s in zip(results, specs, strict=True)])
