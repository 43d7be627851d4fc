"""Exact percentiles by rank selection: counting passes narrow the values down, and no task holds all of them.

A pass cuts each interval that still holds a wanted rank into BINS bins of equal width on a logarithmic scale, which
keeps the order, and counts them. Only the bins' counts, least and largest values reach the driver, at most BINS for
each wanted rank; the bin with the rank is the next interval. An interval with at most LIMIT values ends the search:
those values are counted one by one. Every pass parts the interval's least from its largest value, so that the search ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.operators.translate import clean

BINS = 1024
#: Values of an interval that are counted one by one.
LIMIT = 20_000


@dataclass(frozen=True)
class _Interval:
    """Values from low to high, ends included: how many they are, and how many are less."""

    low: float
    high: float
    count: int
    before: int

    def has(self, c: Column) -> Column:
        return (c >= F.lit(self.low)) & (c <= F.lit(self.high))

    def done(self, limit: int) -> bool:
        return self.low == self.high or self.count <= limit


def _scaled(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def _bin(c: Column, x: _Interval, bins: int) -> Column:
    """The bin of a value; a scale on which the ends are the same gives way to the values themselves."""
    low, high = F.lit(x.low), F.lit(x.high)
    share = F.when(_scaled(low) < _scaled(high), (_scaled(c) - _scaled(low)) / F.nullif(_scaled(high) - _scaled(low), F.lit(0.0))).otherwise((c - low) / (high - low))
    inner = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(share * bins)))
    return F.when(c == low, 0).when(c == high, bins - 1).otherwise(inner).cast("int")


def rank_values(values: DataFrame, column: str, ranks: Sequence[int] | None = None, limit: int = LIMIT, bins: int = BINS, shares: Sequence[float] = ()) -> tuple[int, dict[int, float]]:
    """(count, value at each rank from 0) of a column of doubles, nulls and NaN left out.

    shares asks for the ranks beside their places in the column, too. Ranks that the column doesn't have are left out.
    """
    c = F.col("_v")
    own = values.select(clean(F.col(column).cast("double")).alias("_v")).filter(c.isNotNull())
    least, most, n = own.agg(F.min("_v"), F.max("_v"), F.count("*")).first()
    places = [s * (n - 1) for s in shares] if n else []
    wanted = sorted({r for r in [*(ranks or []), *(f(p) for p in places for f in (floor, ceil))] if 0 <= r < n})
    if not wanted:
        return n, {}
    of = {r: _Interval(least, most, n, 0) for r in wanted}
    while wide := list(dict.fromkeys(x for x in of.values() if not x.done(limit))):
        at = reduce(lambda e, p: e.when(p[1].has(c), p[0] * bins + _bin(c, p[1], bins)), list(enumerate(wide))[1:], F.when(wide[0].has(c), _bin(c, wide[0], bins)))
        counted = own.select("_v", at.alias("_bin")).filter("_bin IS NOT NULL").groupBy("_bin").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        by: dict[int, list] = {i: [] for i in range(len(wide))}
        for r in sorted(counted.collect()):
            by[r["_bin"] // bins].append((r["n"], r["low"], r["high"]))
        for i, x in enumerate(wide):
            ends = list(accumulate((m for m, _, _ in by[i]), initial=x.before))
            for rank in [r for r, own_ in of.items() if own_ == x]:
                k = next(j for j, end in enumerate(ends[1:]) if rank < end)
                of[rank] = _Interval(by[i][k][1], by[i][k][2], by[i][k][0], ends[k])
    few = list(dict.fromkeys(x for x in of.values() if x.low < x.high))
    found = {r: x.low for r, x in of.items() if x.low == x.high}
    if few:
        some = own.filter(reduce(lambda a, b: a | b, [x.has(c) for x in few])).groupBy("_v").agg(F.count("*").alias("n"))
        counts = sorted((r["_v"], r["n"]) for r in some.collect())  # at most LIMIT for each rank
        for rank, x in of.items():
            seen = x.before
            for v, m in (p for p in counts if x.low <= p[0] <= x.high) if rank not in found else ():
                seen += m
                if rank < seen:
                    found[rank] = v
                    break
    return n, found


def percentiles(values: DataFrame, column: str, shares: Sequence[float], limit: int = LIMIT, bins: int = BINS) -> list[float | None]:
    """The exact percentiles of a column, between two values in proportion; null of a column without values."""
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares are from 0 to 1")
    n, found = rank_values(values, column, None, limit, bins, shares)
    out = []
    for s in shares:
        if not n:
            out.append(None)
            continue
        at = s * (n - 1)
        low, high = found[floor(at)], found[ceil(at)]
        out.append(low if low == high else (ceil(at) - at) * low + (at - floor(at)) * high)
    return out
