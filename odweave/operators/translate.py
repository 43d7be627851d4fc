"""Zone translation: vectors and matrices of one zoning system expressed in another.

Plans aggregate by zone before they join, so that a join's input is as large as the zoning system and not as
the data; hot zones are summed up before the shuffle. No side is broadcast by a hint: the planner does that
up to its threshold of bytes. A matrix goes row zones first, is summed up, then column zones.

Missing values count as 0, null zones are left out, repeated keys add up.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from odweave.operators.correspondence import Correspondence

#: Relative difference of totals that passes for equal.
TOLERANCE = 1e-4


def clean(c: Column | str) -> Column:
    """A value with NaN as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c.cast("double")), None).otherwise(c)


def total(c: Column | str) -> Column:
    """A sum that skips NaN and null, and is 0 over nothing."""
    return F.coalesce(F.sum(clean(c)), F.lit(0))


def common_type(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> str:
    """The type that two key columns are compared in: numbers if both are or can be read as numbers."""
    x, y = a.schema[a_col].dataType, b.schema[b_col].dataType
    if x == y:
        return x.simpleString()
    if isinstance(x, NumericType) and isinstance(y, NumericType):
        return "double" if "double" in (x.simpleString(), y.simpleString()) or "float" in (x.simpleString(), y.simpleString()) else "bigint"
    if isinstance(x, StringType) or isinstance(y, StringType):
        return "string"
    raise ValueError(f"keys of types {x.simpleString()} and {y.simpleString()} can't be compared")


def _keyed(data: DataFrame, zone: str, lookup: Correspondence) -> tuple[DataFrame, DataFrame]:
    """Both sides with keys of one type."""
    kind, pairs = common_type(data, zone, lookup.table, lookup.source), lookup.pairs()
    return data.withColumn("_zone", F.col(zone).cast(kind)), pairs.withColumn("_from", F.col("_from").cast(kind))


class Losses:
    """What translations leave out, counted by the job that runs them: hand it to check, run the result, and call warn.

    Totals and the zones that lead nowhere are observed where the rows pass; there is no job but the caller's.
    """

    def __init__(self):
        self._totals: dict[str, list[tuple[str, Observation]]] = {"before": [], "after": []}
        self._sides: list[tuple[str, Sequence[str], Observation]] = []

    def total(self, when: str, df: DataFrame, values: Sequence[str]) -> DataFrame:
        """df, whose totals are observed as those before or after a translation."""
        seen = Observation()
        self._totals[when] += [(v, seen) for v in values]
        return df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[total(v).cast("double").alias(v) for v in values])

    def side(self, joined: DataFrame, zone: str, values: Sequence[str]) -> DataFrame:
        """Zones left-joined to their pairs, of which those without one are observed."""
        seen, lost = Observation(), F.col("_from").isNull()
        self._sides.append((zone, values, seen))
        sums = [F.coalesce(F.sum(F.when(lost, F.col(v))), F.lit(0)).cast("double").alias(v) for v in values]
        return joined.observe(seen, F.approx_count_distinct(F.when(lost, F.col("_zone")), 0.005).alias("_zones"), *sums)

    def lost(self, zone: str) -> tuple[int, dict[str, float]]:
        """(zones that lead nowhere, what is lost of each value) of the sides by this column; waits for the job."""
        rows = [(seen.get, values) for name, values, seen in self._sides if name == zone]
        return sum(r["_zones"] for r, _ in rows), {v: sum(r[v] for r, values in rows if v in values) for _, values in rows for v in values}

    def totals(self, value: str) -> tuple[float, float]:
        """(before, after) of a value over all translations; waits for the job."""
        before, after = (sum(seen.get[v] for v, seen in self._totals[k] if v == value) for k in ("before", "after"))
        return before, after

    def warn(self, stacklevel: int = 2) -> None:
        """Warn of zones that lead nowhere and of changed totals; waits for the job that runs the translation."""
        for zone, values, seen in self._sides:
            row = seen.get
            for v in values if row["_zones"] else ():
                warnings.warn(f"{row['_zones']} values of {zone} lead nowhere; {row[v]} of {v} is left out", stacklevel=stacklevel)
        for (v, before), (_, after) in zip(self._totals["before"], self._totals["after"], strict=True):
            a, b = before.get[v], after.get[v]
            if abs(a - b) > TOLERANCE * max(abs(a), abs(b)):
                warnings.warn(f"the total of {v} was {a} and is {b} after translation", stacklevel=stacklevel)


def _watched(check: bool | Losses) -> Losses | None:
    return check if isinstance(check, Losses) else Losses() if check else None


def _told(out: DataFrame, check: bool | Losses, losses: Losses | None) -> DataFrame:
    """out, run once for its warnings if check is no Losses of the caller's."""
    if losses is not None and losses is not check:
        out.write.format("noop").mode("overwrite").save()
        losses.warn(4)
    return out


def translate_vector(
    vector: DataFrame,
    lookup: Correspondence | DataFrame | str,
    zone: str,
    values: Sequence[str],
    segments: Sequence[str] = (),
    dtype: str | None = None,
    check: bool | Losses = False,
) -> DataFrame:
    """Sums of value times factor by target zone, and by segments if there are any.

    Without segments every target zone of the lookup has a row, 0 where nothing arrives; with segments only
    what arrives has one. dtype is the type that values and factors are cast to first. check runs the translation once
    and warns of losses; given a Losses, nothing runs, and its warn tells after the caller's own job.
    """
    losses, lookup = _watched(check), Correspondence.accepted(lookup, vector.sparkSession)
    if losses:
        vector = losses.total("before", vector, values)
    out = _moved(vector, lookup, zone, values, segments, dtype, losses)
    return _told(losses.total("after", out, values) if losses else out, check, losses)


def _moved(vector: DataFrame, lookup: Correspondence, zone: str, values: Sequence[str], segments: Sequence[str], dtype: str | None, losses: Losses | None) -> DataFrame:
    cast = (lambda c: c.cast(dtype)) if dtype else (lambda c: c)
    data, pairs = _keyed(vector, zone, lookup)
    summed = data.filter(F.col("_zone").isNotNull()).groupBy("_zone", *segments).agg(
        *[F.sum(cast(clean(v))).alias(v) for v in values]
    )
    if losses:
        joined = losses.side(summed.join(pairs, F.col("_zone") == F.col("_from"), "left"), zone, values).filter(F.col("_from").isNotNull())
    else:
        joined = summed.join(pairs, F.col("_zone") == F.col("_from"))
    moved = joined.groupBy("_to", *segments)
    out = moved.agg(*[total(F.col(v) * cast(F.col("_factor"))).alias(v) for v in values])
    for s in segments:
        out = out.filter(F.col(s).isNotNull())
    if not segments:
        out = lookup.targets("_to").join(out, "_to", "left").select("_to", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])
    out = out.withColumnRenamed("_to", lookup.target)
    return out.select(lookup.target, *segments, *[cast(F.col(v)).alias(v) for v in values])


def translate_matrix(
    matrix: DataFrame,
    lookup: Correspondence | DataFrame | str,
    columns: Correspondence | DataFrame | str | None = None,
    origin: str = "origin",
    destination: str = "destination",
    value: str = "value",
    out_names: tuple[str, str] | None = None,
    dtype: str | None = None,
    dense: bool = True,
    check: bool | Losses = False,
) -> DataFrame:
    """A long matrix by the target zones of lookup (rows) and of columns (the same lookup by default).

    dense gives every pair of target zones a row, 0 where nothing arrives; that product is the result's own
    size. dtype is the type that values and factors are cast to first. check warns of losses on either side, as
    in translate_vector.
    """
    losses = _watched(check)
    lookup = Correspondence.accepted(lookup, matrix.sparkSession)
    columns = lookup if columns is None else Correspondence.accepted(columns, matrix.sparkSession)
    if extra := [c for c in matrix.columns if c not in (origin, destination, value)]:
        warnings.warn(f"columns that a matrix doesn't have, and that are left out: {', '.join(extra)}", stacklevel=2)
    names = out_names or (origin, destination)
    if len(names) != 2 or None in names:
        raise ValueError("give both names of the result's zones or none")
    if losses:
        matrix = losses.total("before", matrix, [value])
    by_row = _moved(matrix.filter(F.col(destination).isNotNull()), lookup, origin, [value], [destination], dtype, losses)
    by_row = by_row.withColumnRenamed(lookup.target, "_row")
    both = _moved(by_row, columns, destination, [value], ["_row"], dtype, losses).withColumnRenamed(columns.target, "_col")
    if dense:
        spine = lookup.targets("_row").crossJoin(columns.targets("_col"))
        both = spine.join(both, ["_row", "_col"], "left")
    out = both.select(
        F.col("_row").alias(names[0]), F.col("_col").alias(names[1]), F.coalesce(value, F.lit(0)).alias(value)
    )
    return _told(losses.total("after", out, [value]) if losses else out, check, losses)


def dropped_zones(data: DataFrame, lookup: Correspondence, zone: str, value: str) -> DataFrame:
    """(zones, value, missing_cells): what a translation leaves out for want of a correspondence."""
    keyed, pairs = _keyed(data, zone, lookup)
    lost = keyed.join(pairs.select("_from").distinct(), F.col("_zone") == F.col("_from"), "left_anti")
    return lost.agg(
        F.count_distinct("_zone").alias("zones"),
        total(value).alias("value"),
        F.count_if(clean(value).isNull()).alias("missing_cells"),
    )


def totals(before: DataFrame, after: DataFrame, value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(before, after, equal): totals of a table and its translation."""
    a = before.agg(total(value).cast("double").alias("before"))
    b = after.agg(total(value).cast("double").alias("after"))
    close = F.abs(F.col("before") - F.col("after")) <= tolerance * F.greatest(F.abs("before"), F.abs("after"))
    return a.join(b).withColumn("equal", close)


def require_totals(before: DataFrame, after: DataFrame, value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """after, once its total is known to equal before's; ValueError otherwise."""
    row = totals(before, after, value, tolerance).first()
    if not row.equal:
        raise ValueError(f"the total was {row.before} and is {row.after} after translation")
    return after
