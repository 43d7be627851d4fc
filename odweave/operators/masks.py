"""Selections of matrix cells by zone, as boolean expressions over the long form."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.operators.translate import total


def inside(col: str, zones: Iterable) -> Column:
    """Whether a zone is one of some; false for null."""
    return F.coalesce(F.col(col).isin(list(zones)), F.lit(False))


def mask(
    origins: Iterable,
    destinations: Iterable,
    combine: Callable[[Column, Column], Column] = and_,
    origin: str = "origin",
    destination: str = "destination",
) -> Column:
    """A mask of origins and destinations, combined by any function of two Columns."""
    return combine(inside(origin, origins), inside(destination, destinations))


def internal_mask(zones: Iterable, origin: str = "origin", destination: str = "destination") -> Column:
    """Cells with both ends in zones."""
    zones = list(zones)
    return mask(zones, zones, and_, origin, destination)


def external_mask(zones: Iterable, origin: str = "origin", destination: str = "destination") -> Column:
    """Cells with either end in zones."""
    zones = list(zones)
    return mask(zones, zones, or_, origin, destination)


def masked(matrix: DataFrame, where: Column, value: str = "value") -> DataFrame:
    """The matrix with 0 outside the mask."""
    return matrix.withColumn(value, F.when(where, F.col(value)).otherwise(F.lit(0)))


def mark_internal_external(
    matrix: DataFrame,
    internal: Iterable,
    keep_external: bool = True,
    origin: str = "origin",
    destination: str = "destination",
    name: str = "zone_class",
    check: bool = False,
) -> DataFrame:
    """matrix with II, IE, EI or EE by which ends are internal; EE rows may be left out.

    check reads the matrix once: no internal zone on either side raises, on one side only warns.
    """
    lacking = [c for c in (origin, destination) if c not in matrix.columns]
    if lacking:
        raise ValueError(f"the matrix lacks columns: {', '.join(lacking)}")
    internal = list(internal)
    o, d = inside(origin, internal), inside(destination, internal)
    if check:
        row = matrix.agg(F.max(o).alias("o"), F.max(d).alias("d")).first()
        if not row.o and not row.d:
            raise ValueError("no internal zone occurs in the matrix")
        if not row.o or not row.d:
            warnings.warn("internal zones occur on one side of the matrix only", stacklevel=2)
    letter = lambda c: F.when(c, F.lit("I")).otherwise(F.lit("E"))
    out = matrix.withColumn(name, F.concat(letter(o), letter(d)))
    return out if keep_external else out.filter(F.col(name) != "EE")


def internal_external_report(
    matrix: DataFrame, internal: Iterable, external: Iterable, origin: str = "origin", destination: str = "destination", value: str = "value"
) -> DataFrame:
    """(origin_class, internal, external, total): nine sums, in one aggregate.

    A zone that is in both lists counts in both; zones that are in neither are left out.
    """
    zones = {"internal": list(internal), "external": list(external)}
    cells = {
        (a, b): total(F.when(mask(zones[a], zones[b], and_, origin, destination), F.col(value)))
        for a in zones
        for b in zones
    }
    sums = matrix.agg(*[c.alias(f"{a}_{b}") for (a, b), c in cells.items()])
    row = lambda name, i, e: F.struct(F.lit(name).alias("origin_class"), i.alias("internal"), e.alias("external"), (i + e).alias("total"))
    ii, ie, ei, ee = (F.col(f"{a}_{b}") for a in zones for b in zones)
    rows = F.array(row("internal", ii, ie), row("external", ei, ee), row("total", ii + ei, ie + ee))
    return sums.select(F.explode(rows).alias("r")).select("r.*")
