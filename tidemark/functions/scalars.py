"""Column functions: Column -> Column, all inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
MICROS_PER_YEAR = int(365.25 * MICROS_PER_DAY)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c, fmt: str = "MM/dd/yyyy") -> Column:
    """Text to date; what does not parse becomes null."""
    return F.try_to_timestamp(_c(c), F.lit(fmt)).cast("date")


def parse_timestamp(c, fmt: str) -> Column:
    return F.try_to_timestamp(_c(c), F.lit(fmt))


def micros(c) -> Column:
    """A timestamp (with or without zone) as microseconds since 1970, for arithmetic and window ranges."""
    return F.unix_micros(_c(c).cast("timestamp"))


def date_plus_seconds(day, seconds) -> Column:
    """Date and seconds of the day to a timestamp; null seconds count as 0, others are clipped to the day."""
    s = F.greatest(F.lit(0), F.least(F.lit(86_399), F.coalesce(_c(seconds).cast("int"), F.lit(0))))
    return F.timestamp_seconds(F.unix_seconds(_c(day).cast("timestamp")) + s)


def days_between(start, end, inclusive: bool = False) -> Column:
    d = F.datediff(_c(end).cast("date"), _c(start).cast("date"))
    return d + 1 if inclusive else d


def minutes_between(start, end) -> Column:
    return (micros(end) - micros(start)) / 60e6


def years_between(start, end) -> Column:
    """Years of 365.25 days."""
    return (micros(end) - micros(start)) / float(MICROS_PER_YEAR)


def add_months(c, n) -> Column:
    """Calendar months later, clamped to the month's end; keeps the time of day of a timestamp."""
    return F.try_add(_c(c), F.make_interval(months=F.lit(n) if isinstance(n, int) else n))


def shift_micros(c, n: int) -> Column:
    return F.timestamp_micros(micros(c) + F.lit(n))


def earliest(*cols) -> Column:
    """The least of several columns in a row; nulls are skipped."""
    return F.least(*map(_c, cols)) if len(cols) > 1 else _c(cols[0])


def clip(c, low=None, high=None) -> Column:
    """Null stays null."""
    c = _c(c)
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def cut_right(c, breaks: Sequence[float], labels: Sequence | None = None) -> Column:
    """Bin number of intervals (a, b], or its label; null stays null."""
    c = _c(c)
    at = F.lit(0)
    for b in sorted(breaks):
        at = at + F.when(c > F.lit(b), 1).otherwise(0)
    if labels is not None:
        at = F.element_at(F.array(*map(F.lit, labels)), at + 1)
    return F.when(c.isNotNull(), at)


def between(c, low, high, closed: str = "both") -> Column:
    """``closed``: both, left, right or none."""
    c = _c(c)
    left = c >= low if closed in ("both", "left") else c > low
    right = c <= high if closed in ("both", "right") else c < high
    return left & right


def fill(c, value) -> Column:
    """Null and NaN to ``value``."""
    return F.coalesce(F.nanvl(_c(c).cast("double"), F.lit(None).cast("double")), F.lit(value))


def nan_to_null(c) -> Column:
    return F.when(~F.isnan(_c(c)), _c(c))


def before_dot(c) -> Column:
    return F.regexp_replace(_c(c), r"\..*$", "")


def blank_to_null(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


def key_value_name(key, value) -> Column:
    return F.concat(_c(key).cast("string"), F.lit("__EQ_"), _c(value).cast("string"))


def join_sorted(c, sep: str = "&") -> Column:
    """Distinct elements of an array in order, joined."""
    return F.array_join(F.array_sort(F.array_distinct(_c(c))), sep)


def row_list(*cols) -> Column:
    """Columns as one array without null, empty and repeated elements."""
    return F.array_distinct(F.filter(F.array(*map(_c, cols)), lambda x: x.isNotNull() & (x != "")))


def insertion_point(arr, v) -> Column:
    """Number of elements below v in a sorted array."""
    v = _c(v)
    return F.size(F.filter(_c(arr), lambda x: x < v))


def portable_hash(c, seed: int, salt: str = "") -> Column:
    """A number in [0, 2^32) from the first 8 hex digits of md5('value:seed'): the same on any engine and partitioning."""
    text = F.concat(_c(c).cast("string"), F.lit(f":{seed}{salt}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def surrogate_id(*cols) -> Column:
    return F.xxhash64(*map(_c, cols))


def drop_or_censor(c, drop_lower_bound=None, drop_lower_bound_inclusive=False, drop_upper_bound=None, drop_upper_bound_inclusive=False, censor_lower_bound=None, censor_upper_bound=None) -> Column:
    """Values beyond a drop bound become NaN, beyond a censor bound the bound. Bounds are numbers or
    columns; a bound that is None or null does nothing."""
    c = _c(c).cast("double")
    out = c
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    for bound, lower in ((censor_upper_bound, False), (censor_lower_bound, True)):
        if bound is not None:
            b = lit(bound)
            out = F.when((out < b) if lower else (out > b), b).otherwise(out)
    for bound, inclusive, lower in ((drop_lower_bound, drop_lower_bound_inclusive, True), (drop_upper_bound, drop_upper_bound_inclusive, False)):
        if bound is not None:
            b, i = lit(bound), F.coalesce(lit(inclusive), F.lit(False))
            beyond = (c < b) if lower else (c > b)
            out = F.when(F.coalesce(beyond | (i & (c == b)), F.lit(False)), F.lit(float("nan"))).otherwise(out)
    return out


def count_or_share(total, cutoff) -> Column | int:
    """A cutoff below 1 is a share of the total, rounded; from 1 on a count."""
    if isinstance(total, Column) or isinstance(cutoff, Column):
        cutoff = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
        return F.when(cutoff < 1, F.rint(total * cutoff)).otherwise(cutoff).cast("long")
    if isinstance(cutoff, int) or cutoff >= 1:
        return int(cutoff)
    if cutoff <= 0:
        raise ValueError("a cutoff is above 0")
    return round(total * cutoff)


def below_cutoff(n: int, cutoff, total: int | None = None) -> bool:
    """Whether a count is below a cutoff (None: never)."""
    return cutoff is not None and n < count_or_share(total, cutoff)


def age_years(birth, ts) -> Column:
    return years_between(birth, ts)


def time_of_day(ts) -> Column:
    """EARLY_AM before 6, AM before 12, PM before 21, then LATE_PM."""
    h = F.hour(_c(ts))
    return F.when(h < 6, "EARLY_AM").when(h < 12, "AM").when(h < 21, "PM").when(h.isNotNull(), "LATE_PM")
