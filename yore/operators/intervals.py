"""Predicates over time: points and intervals in epoch milliseconds, where a null start or end is unbounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: Column | str) -> Column:
    """Epoch milliseconds of a timestamp column; one without a zone counts as UTC."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def meets(earliest: Column, latest: Column, lo: int | None, hi: int | None) -> Column:
    """Whether the closed range [earliest, latest] meets [lo, hi]. Null bounds on either side are open."""
    ok = F.lit(True)
    if hi is not None:
        ok &= F.coalesce(earliest <= hi, F.lit(True))
    if lo is not None:
        ok &= F.coalesce(latest >= lo, F.lit(True))
    return ok


def feed_window(start: Column, end: Column, since: int | None, until: int | None) -> Column:
    """Whether something is in a feed's window [since, until): it starts before the window ends and ends in or after its start."""
    ok = F.lit(True)
    if until is not None:
        ok &= start < until
    if since is not None:
        ok &= F.coalesce(end, start) >= since
    return ok


def compared(at: Column, op: str, lower: int, upper: int) -> Column:
    """A point against a date of some precision [lower, upper]: > is after all of it, >= from its start, < before its start, <= to its end, = within."""
    return {">": at > upper, ">=": at >= lower, "<": at < lower, "<=": at <= upper, "=": at.between(lower, upper)}[op]


def valid(start: Column, end: Column, scope: str, lo: int | None = None, hi: int | None = None, seen: Column | None = None) -> Column:
    """Whether a run of validity [start, end) is in a scope.

    ever; current (no end); past (ended); at lo; during [lo, hi] (overlaps); throughout [lo, hi] (contains); before lo
    (ended by then); after lo (starts then or later); asof lo (known by then: `seen` is when it was first observed). A
    null start is unbounded, a null end open.
    """
    began = lambda t: F.coalesce(start <= t, F.lit(True))
    lasts = lambda t: F.coalesce(end > t, F.lit(True))
    if scope == "ever":
        return F.lit(True)
    if scope == "current":
        return end.isNull()
    if scope == "past":
        return end.isNotNull()
    if scope == "at":
        return began(lo) & lasts(lo)
    if scope == "during":
        return began(hi) & lasts(lo)
    if scope == "throughout":
        return began(lo) & lasts(hi)
    if scope == "before":
        return F.coalesce(end <= lo, F.lit(False))
    if scope == "after":
        return F.coalesce(start >= lo, F.lit(False))
    if scope == "asof":
        return seen <= lo
    raise ValueError(f"unknown scope {scope!r}")


def duration(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; nothing without an end lasts."""
    return F.coalesce(end, start) - start
