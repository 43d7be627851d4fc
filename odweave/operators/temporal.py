"""Joins and groups along time: the last row before, overlapping intervals, sessions.

Rows of a key are cut into ranges of time, so that no task has all rows of a hot key. What a range needs of those before
it, one row for each key and range, is carried forward in a small table of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

#: Ranges of time that a key's rows are cut into at most.
RANGES = 128


def ticks(df: DataFrame, column: str) -> Column:
    """A time as a number that grows with it: microseconds, days, or the number itself."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, TimestampNTZType):
        c = c.cast("timestamp")  # in the session's time zone
    if isinstance(kind, (TimestampNTZType, TimestampType)):
        return F.unix_micros(c)
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, NumericType):
        return c
    raise TypeError(f"{column} is no time")


def cuts(times: DataFrame, column: str, ranges: int = RANGES) -> list:
    """Bounds of ranges with about as many rows each."""
    got = times.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    return sorted(set(got or []))


def range_of(c: Column, bounds: Sequence) -> Column:
    """The number of bounds under a value, by halving."""
    if not bounds:
        return F.lit(0)
    mid = len(bounds) // 2
    upper = range_of(c, bounds[mid + 1 :]) + (mid + 1) if bounds[mid + 1 :] else F.lit(mid + 1)
    return F.when(c > F.lit(bounds[mid]), upper).otherwise(range_of(c, bounds[:mid]))



def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    by: Sequence[str] = (),
    take: Sequence[str] | None = None,
    ties: Sequence[str] = (),
    tolerance: float | None = None,
    ranges: int = RANGES,
) -> DataFrame:
    """left with columns of the last row of right that has the same keys and is not later; null where there is none.

    Rows of right at the same time come in the order of ties, and the last is taken. With a tolerance, in ticks,
    an older row than that counts for none. A null key or time has no match. Names in ``take``, by default all of
    right's but the keys, must be new to left.
    """
    take = [c for c in right.columns if c not in by] if take is None else list(take)
    if clash := [c for c in take if c in left.columns]:
        raise ValueError(f"columns that both sides have: {', '.join(clash)}")
    t, keys = F.col("_t"), [f"_k{i}" for i in range(len(by))]
    named = lambda df: [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)]
    a = left.select(*named(left), ticks(left, left_time).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"))
    own = F.struct(ticks(right, right_time).alias("_t"), *[F.col(f"`{c}`").alias(f"_tie{i}") for i, c in enumerate(ties)], *[F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(take)])
    b = right.select(*named(right), ticks(right, right_time).alias("_t"), own.alias("_r"))
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in ["_t", *keys]])
    lone = a.filter(~known).select("_l.*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take])
    both = a.filter(known).withColumn("_r", F.lit(None).cast(b.schema["_r"].dataType)).unionByName(b.filter(known), allowMissingColumns=True)
    bounds = cuts(both, "_t", ranges)
    both = both.withColumn("_range", range_of(t, bounds))
    of = [*keys, "_range"]
    order = [F.col(f"_r._tie{i}") for i in range(len(ties))]
    # rows of right come before those of left at the same time
    past = Window.partitionBy(*of).orderBy(t, F.col("_l").isNotNull(), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_own", F.last("_r", ignorenulls=True).over(past)).filter("_l IS NOT NULL").drop("_r")
    last = both.groupBy(*of).agg(F.max_by("_r", F.when(F.col("_l").isNull(), F.struct("_t", *order))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*of, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    joined = seen.join(carried, of, "left").withColumn("_m", F.coalesce("_own", "_carried"))
    if tolerance is not None:
        joined = joined.withColumn("_m", F.when(t - F.col("_m._t") <= tolerance, F.col("_m")))
    return joined.select("_l.*", *[F.col(f"_m._x{i}").alias(c) for i, c in enumerate(take)]).unionByName(lone)


def _cells(df: DataFrame, levels: Column, side: str) -> DataFrame:
    """A row for each cell, at each of some levels, that an interval (_s, _e) touches."""
    each = df.withColumn("_level", F.explode(levels))
    at = lambda c: F.call_function("shiftright", F.col(c), F.col("_level"))
    return each.withColumn(f"_{side}first", at("_s")).withColumn("_cell", F.explode(F.sequence(at("_s"), at("_e")))).withColumnsRenamed({"_s": f"_{side}s", "_e": f"_{side}e"})


def interval_join(a: DataFrame, b: DataFrame, a_ends: tuple[str, str], b_ends: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Rows of a and b whose intervals, ends included, overlap and whose keys are the same; columns of both.

    An interval's level is the least whose cells, of 2 ** level ticks, are longer than it: it touches two at most. Of a
    pair the interval of the lower level is filed under the cells of the higher one too, and the pair counts in
    the first cell that both touch, so that it comes once and no interval is cut into many cells. A null key or
    end, or an end before its start, joins nothing. Other columns of both sides must differ.
    """
    if clash := [c for c in a.columns if c in b.columns and c not in by]:
        raise ValueError(f"columns that both sides have: {', '.join(clash)}")

    def filed(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        own = df.withColumns({"_s": ticks(df, ends[0]).cast("bigint"), "_e": ticks(df, ends[1]).cast("bigint")}).filter("_s <= _e")
        return own.withColumn("_own", F.ceil(F.log2((F.col("_e") - F.col("_s") + 1).cast("double"))).cast("int"))

    x, y = filed(a, a_ends), filed(b, b_ends)
    levels = [sorted(r[0] for r in df.select("_own").distinct().collect()) for df in (x, y)]  # 64 at most
    of = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<int>")
    keys = [*by, "_level", "_cell"]
    upper = _cells(x, F.array("_own"), "a").drop("_own"), _cells(y, F.filter(of(levels[0]), lambda v: v >= F.col("_own")), "b").drop("_own")
    lower = _cells(x, F.filter(of(levels[1]), lambda v: v > F.col("_own")), "a").drop("_own"), _cells(y, F.array("_own"), "b").drop("_own")
    met = F.expr("_as <= _be AND _bs <= _ae AND _cell = greatest(_afirst, _bfirst)")
    columns = [*a.columns, *[c for c in b.columns if c not in by]]
    pairs = [p.join(q, keys).filter(met).select(*[F.col(f"`{c}`") for c in columns]) for p, q in (upper, lower)]
    return pairs[0].unionByName(pairs[1])


def sessions(events: DataFrame, by: Sequence[str], time: str, gap: float, ranges: int = RANGES) -> DataFrame:
    """events with ``session``, from 1 for each key: a row more than gap ticks after the one before begins a new one.

    Rows without a key or time are in none and are left out. Rows of one time are in the same session.
    """
    t = F.col("_t")
    own = events.withColumn("_t", ticks(events, time)).filter(reduce(lambda x, y: x & y, [F.col(f"`{c}`").isNotNull() for c in by], t.isNotNull()))
    own = own.withColumn("_range", range_of(t, cuts(own, "_t", ranges)))
    of = [*by, "_range"]
    part, before = Window.partitionBy(*of).orderBy("_t"), Window.partitionBy(*by).orderBy("_range")
    new = own.withColumn("_new", F.when(t - F.lag("_t").over(part) > gap, 1).otherwise(0))
    # a range's first row begins a session unless the range before ends near by; lengths of ranges are added up
    spans = new.groupBy(*of).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.sum("_new").alias("_n"))
    starts = F.when(F.col("_first") - F.lag("_last").over(before) <= gap, 0).otherwise(1)
    spans = spans.withColumn("_starts", starts)
    sofar = F.sum(F.col("_n") + F.col("_starts")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    placed = spans.select(*of, (F.coalesce(sofar, F.lit(0)) + F.col("_starts")).alias("_before"))
    inside = F.sum("_new").over(part.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return new.withColumn("_inside", inside).join(placed, of).withColumn("session", F.col("_before") + F.col("_inside")).select(*events.columns, "session")
