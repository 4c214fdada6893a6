"""Interval algebra on pairs of columns; an interval is half-open, [start, end).

The axis is an opaque 64-bit integer.  ``NEG_INF`` and ``POS_INF`` stand for open
ends; lengths that touch them are NULL, never an overflow.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = -(1 << 63)
POS_INF = (1 << 63) - 1


class Interval(NamedTuple):
    """A pair of columns."""

    start: Column
    end: Column


def interval(start, end) -> Interval:
    of = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x).cast("long")
    return Interval(of(start), of(end))


def as_struct(i: Interval) -> Column:
    return F.struct(i.start.alias("start_ts"), i.end.alias("end_ts"))


def checked(i: Interval) -> Column:
    """The interval as a struct; an error where it doesn't start before its end."""
    wrong = F.raise_error(F.concat(F.lit("invalid interval: start "), i.start.cast("string"), F.lit(" >= end "), i.end.cast("string")))
    return F.when(i.start < i.end, as_struct(i)).otherwise(wrong.cast("struct<start_ts:bigint,end_ts:bigint>"))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch, rounded down."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)).cast("long")


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def shift_to_utc(local_seconds: Column, offset_seconds: Column) -> Column:
    """Wall-clock seconds at a fixed offset from UTC as UTC seconds."""
    return local_seconds - offset_seconds


def from_start(start: Column) -> Interval:
    return Interval(start, F.lit(POS_INF))


def until_end(end: Column) -> Interval:
    return Interval(F.lit(NEG_INF), end)


def all_time() -> Interval:
    return Interval(F.lit(NEG_INF), F.lit(POS_INF))


def closed_with(start: Column, end: Column) -> Interval:
    """NULL ends become open ends."""
    return Interval(F.coalesce(start, F.lit(NEG_INF)), F.coalesce(end, F.lit(POS_INF)))


def contains(i: Interval, instant: Column) -> Column:
    return (i.start <= instant) & (instant < i.end)


def is_empty(i: Interval) -> Column:
    return i.start >= i.end


def is_finite(i: Interval) -> Column:
    return (i.start != NEG_INF) & (i.end != POS_INF)


def duration(i: Interval) -> Column:
    return F.when(is_finite(i), F.try_subtract(i.end, i.start))


def duration_or_zero(i: Interval) -> Column:
    return F.coalesce(duration(i), F.lit(0).cast("long"))


def overlaps(a: Interval, b: Interval) -> Column:
    """Some instant is in both; touching isn't enough."""
    return (a.start < b.end) & (b.start < a.end)


def adjacent(a: Interval, b: Interval) -> Column:
    return (a.end == b.start) | (b.end == a.start)


def encloses(outer: Interval, inner: Interval) -> Column:
    return (outer.start <= inner.start) & (outer.end >= inner.end)


def meet(a: Interval, b: Interval) -> Interval:
    """The common part, empty (start >= end) where there is none."""
    return Interval(F.greatest(a.start, b.start), F.least(a.end, b.end))


def overlap_duration(a: Interval, b: Interval) -> Column:
    """The length of the common part, 0 where there is none or it can't be told in 64 bits."""
    part = meet(a, b)
    return F.when(overlaps(a, b), F.coalesce(F.try_subtract(part.end, part.start), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def intersect(a: Interval, b: Interval) -> Column:
    """Struct or NULL."""
    return F.when(overlaps(a, b), as_struct(meet(a, b)))


def hull(a: Interval, b: Interval) -> Interval:
    return Interval(F.least(a.start, b.start), F.greatest(a.end, b.end))


def union(a: Interval, b: Interval) -> Column:
    """The hull where the two overlap or touch, else NULL."""
    return F.when(overlaps(a, b) | adjacent(a, b), as_struct(hull(a, b)))


def difference(a: Interval, b: Interval) -> Column:
    """What of ``a`` isn't in ``b``: an array of 0 to 2 structs, in order of time."""
    left = Interval(a.start, F.least(a.end, b.start))
    right = Interval(F.greatest(a.start, b.end), a.end)
    pieces = F.filter(F.array(as_struct(left), as_struct(right)), lambda p: p["start_ts"] < p["end_ts"])
    return F.when(overlaps(a, b), pieces).otherwise(F.array(as_struct(a)))


def allen_relation(a: Interval, b: Interval) -> Column:
    """The name of the relation of ``a`` to ``b``.

    Of two intervals with one end, the one that starts earlier is said to
    ``finishes``, and the later one to be ``finished_by``.
    """
    s, e = a.start, a.end
    t, f = b.start, b.end
    return (
        F.when(e < t, "precedes")
        .when(f < s, "preceded_by")
        .when(e == t, "meets")
        .when(f == s, "met_by")
        .when((s == t) & (e == f), "equals")
        .when(s == t, F.when(e < f, "starts").otherwise("started_by"))
        .when(e == f, F.when(s < t, "finishes").otherwise("finished_by"))
        .when((s > t) & (e < f), "during")
        .when((s < t) & (e > f), "contains")
        .when(s < t, "overlaps")
        .otherwise("overlapped_by")
    )


def display(i: Interval) -> Column:
    """``[s, e)`` with infinity signs for open ends."""
    left = F.when(i.start == NEG_INF, F.lit("(-∞")).otherwise(F.concat(F.lit("["), i.start.cast("string")))
    right = F.when(i.end == POS_INF, F.lit("+∞")).otherwise(i.end.cast("string"))
    return F.concat(left, F.lit(", "), right, F.lit(")"))
