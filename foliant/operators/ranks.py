"""Exact order statistics by repeated histograms: no sort, and no task that gets all values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096
#: Values that are fetched and sorted once a bin has no more of them.
FEW = 10_000


@dataclass
class Span:
    """The values from lo to hi, of which the first has ``before`` smaller ones in all."""

    lo: float
    hi: float
    before: int
    n: int


def _bin(x: Column, s: Span) -> Column:
    return F.least(F.floor((x - s.lo) / (s.hi - s.lo) * BINS), F.lit(BINS - 1))


def value_at(rows: DataFrame, column: str, rank: int, span: Span) -> tuple[float, Span]:
    """The value with ``rank`` smaller or equal ones before it, and the span it was found in. Each round counts the values of a span in BINS bins and goes on with the one that has
    the rank, from its least to its largest value: a bin of two values or more is divided, so rounds end, and ties end them at once."""
    x = F.col(column).cast("double")
    while span.lo < span.hi:
        own = rows.filter(x.between(span.lo, span.hi))
        if span.n <= FEW:
            return sorted(r[0] for r in own.select(x).collect())[rank - span.before], span
        at = span.before
        for r in sorted(own.groupBy(_bin(x, span).alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect(), key=lambda r: r.b):
            if rank < at + r.n:
                span = Span(r.lo, r.hi, at, r.n)
                break
            at += r.n
    return span.lo, span


def quantile(rows: DataFrame, column: str, q: float = 0.5) -> float | None:
    """The exact quantile of a column, between two values in proportion; None if it has none. Nulls and NaN do not count; infinite values are an error."""
    x = F.col(column).cast("double")
    own = rows.filter(x.isNotNull() & ~F.isnan(x))
    total = own.agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if not total.n:
        return None
    if float("inf") in (total.hi, -total.lo):
        raise ValueError(f"{column} has infinite values")
    place = q * (total.n - 1)
    low, span = value_at(own, column, int(place), Span(total.lo, total.hi, 0, total.n))
    if place == int(place):
        return low
    after = int(place) + 1
    high, _ = value_at(own, column, after, span if after < span.before + span.n else Span(total.lo, total.hi, 0, total.n))
    return low + (high - low) * (place - int(place))
