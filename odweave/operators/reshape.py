"""Long and wide forms, infilling of missing combinations, and coordinates of arrays."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odweave.operators.translate import clean, totals

#: Most cells of an array that is brought to the driver.
DENSE_CELLS = 50_000_000


def full_index(spark: SparkSession, values: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of given key values."""
    frames = [spark.createDataFrame([(v,) for v in vs], [k]) for k, vs in values.items()]
    return reduce(lambda a, b: a.crossJoin(b), frames)


def product_infill(
    data: DataFrame, keys: Sequence[str], infill=0, values: Mapping[str, Sequence] | None = None, check: bool = False
) -> DataFrame:
    """data with a row for every combination of key values, and nulls filled.

    Key values are the given ones, or all that occur; rows with other values go. The product is the size of the
    result. check raises ValueError if none of the given values occur.
    """
    others = [c for c in data.columns if c not in keys]
    kinds = {data.schema[c].dataType.typeName() == "string" for c in others}
    if len(kinds) > 1:
        raise TypeError("columns of numbers and strings can't take the same infill")
    lists = [
        full_index(data.sparkSession, {k: values[k]}).select(F.col(k).cast(data.schema[k].dataType).alias(k))
        if values and k in values
        else data.select(k).filter(F.col(k).isNotNull()).distinct()
        for k in keys
    ]
    spine = reduce(lambda a, b: a.crossJoin(b), lists)
    if check and data.join(spine, list(keys), "left_semi").isEmpty():
        raise ValueError("none of the keys' values occur in the data")
    joined = spine.join(data, list(keys), "left")
    own = (lambda c: F.col(c)) if True in kinds else (lambda c: clean(F.col(c)))
    fill = [F.coalesce(own(c), F.lit(infill).cast(data.schema[c].dataType)).alias(c) for c in others]
    return joined.select(*keys, *fill)


def long_to_wide(
    data: DataFrame, row: str, column: str, value: str, columns: Sequence | None = None, infill=0, check: bool = False, rows: Sequence | None = None, check_total: bool = False
) -> DataFrame:
    """A row for each value of row and a column for each value of column; combinations without a row get infill.

    Without the list of columns one pass over the data finds it. check raises ValueError for repeated cells. With both
    rows and columns given the result has just these, and cells that are null get infill too. check_total warns
    of a total that isn't the data's.
    """
    if columns is None:
        columns = sorted(r[0] for r in data.select(column).distinct().collect() if r[0] is not None)
    if check and not data.groupBy(row, column).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("some cells have several rows")
    wide = data.groupBy(row).pivot(column, list(columns)).agg(F.first(F.struct(F.col(value).alias("v"))))
    # a cell that has a row keeps its null
    filled = [F.when(F.col(f"`{c}`").isNull(), F.lit(infill)).otherwise(F.col(f"`{c}`.v")).alias(str(c)) for c in columns]
    if rows is not None:
        spine = full_index(data.sparkSession, {row: rows}).select(F.col(row).cast(data.schema[row].dataType).alias(row))
        wide = spine.join(wide, row, "left")
        filled = [F.coalesce(clean(F.col(f"`{c}`.v")), F.lit(infill)).alias(str(c)) for c in columns]
    out = wide.select(row, *filled)
    if check_total:
        was = totals(data, wide_to_long(out, row, "_column", value), value).first()
        if not was.equal:
            warnings.warn(f"the total was {was.before} and is {was.after} in the wide form", stacklevel=2)
    return out


def wide_to_long(
    wide: DataFrame, row: str, column: str = "destination", value: str = "val", rows: Sequence | None = None, columns: Sequence | None = None, infill=None
) -> DataFrame:
    """A row for each cell; nulls stay. With both rows and columns given there are just their cells, and nulls get infill."""
    long = wide.unpivot([row], [c for c in wide.columns if c != row], column, value)
    if rows is None or columns is None:
        return long
    return product_infill(long, [row, column], infill, {row: rows, column: [str(c) for c in columns]})


def transpose(matrix: DataFrame, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """A long matrix with its sides exchanged."""
    swapped = {origin: destination, destination: origin}
    return matrix.select(*[F.col(swapped.get(c, c)).alias(c) for c in matrix.columns])


def positions(data: DataFrame, key: str) -> DataFrame:
    """(key, position): the distinct values of a key in order, from 0. A dimension is small; its data isn't."""
    order = Window.orderBy(key)
    return data.select(key).filter(F.col(key).isNotNull()).distinct().select(key, (F.row_number().over(order) - 1).alias("position"))


def to_coordinates(
    data: DataFrame, keys: Sequence[str], value: str, maps: Mapping[str, Sequence] | None = None, drop: float | None = None, strict: bool = False
) -> DataFrame:
    """(i0, i1, ..., value): cells by the positions of their keys, in given lists or in order; drop leaves a value out.

    Cells with a null key are left out; strict raises ValueError for them.
    """
    if strict and not data.filter(" OR ".join(f"`{k}` IS NULL" for k in keys)).isEmpty():
        raise ValueError(f"some cells have no {' or '.join(keys)}")
    out = data if drop is None else data.filter(F.col(value) != drop)
    for n, k in enumerate(keys):
        if maps and k in maps:
            rows = [(v, i) for i, v in enumerate(maps[k])]
            place = data.sparkSession.createDataFrame(rows, [k, "position"]).select(F.col(k).cast(data.schema[k].dataType).alias(k), F.col("position").cast("int"))
        else:
            place = positions(data, k)
        out = out.join(place.withColumnRenamed("position", f"i{n}"), k)
    return out.select(*[f"i{n}" for n in range(len(keys))], value)


def sparse_feasible(data: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(n_rows, cells, utilisation, feasible): whether so few cells are taken that a sparse form is the smaller."""
    row = data.agg(F.count("*").alias("n_rows"), *[F.count_distinct(k).alias(f"_{k}") for k in keys])
    cells = reduce(lambda a, b: a * b, [F.col(f"_{k}").cast("double") for k in keys])
    share = F.try_divide(F.col("n_rows").cast("double"), cells)
    return row.select("n_rows", cells.alias("cells"), share.alias("utilisation"), (share < 1 / (len(keys) + 1)).alias("feasible"))


def to_array(data: DataFrame, keys: Sequence[str], value: str, maps: Mapping[str, Sequence] | None = None, fill: float = np.nan) -> tuple[np.ndarray, dict]:
    """(array, values of each key by position), on the driver and so only up to DENSE_CELLS cells."""
    maps = {k: list(maps[k]) if maps and k in maps else [r[0] for r in positions(data, k).orderBy("position").collect()] for k in keys}
    shape = tuple(len(v) for v in maps.values())
    if (cells := int(np.prod(shape, dtype=np.float64))) > DENSE_CELLS:
        raise ValueError(f"an array of {cells} cells is too large for the driver; use to_coordinates, or blocks.chunks_of_keys")
    out = np.full(shape, fill)
    got = to_coordinates(data, keys, value, maps).toPandas()
    out[tuple(got[f"i{n}"].to_numpy() for n in range(len(keys)))] = got[value]
    return out, maps


def array_or_coordinates(
    data: DataFrame, keys: Sequence[str], value: str, sparse: str = "disallow", maps: Mapping[str, Sequence] | None = None, fill: float = np.nan
) -> tuple[np.ndarray, dict] | DataFrame:
    """to_array's result, or to_coordinates' if sparse forces it, finds it feasible, or allows it for want of room."""
    if sparse not in ("disallow", "allow", "feasible", "force"):
        raise ValueError("sparse is disallow, allow, feasible or force")
    told = sparse_feasible(data, keys).first() if sparse in ("allow", "feasible") else None
    if sparse == "force" or sparse == "feasible" and told.feasible or sparse == "allow" and told.cells > DENSE_CELLS:
        return to_coordinates(data, keys, value, maps, strict=True)
    return to_array(data, keys, value, maps, fill)


def explode_array(data: DataFrame, keys: Sequence[str], column: str, names: Sequence[str], value: str = "value", drop_zeros: bool = False) -> DataFrame:
    """A row for each cell of a column of arrays, nested once for each of names, with keys and the cell's places."""
    out = data.select(*keys, F.col(column).alias(value))
    for n, name in enumerate(names):
        out = out.select(*keys, *names[:n], F.posexplode(value).alias(name, value))
    return out.filter(F.col(value) != 0) if drop_zeros else out


def from_array(spark: SparkSession, array: np.ndarray, keys: Mapping[str, Sequence], value: str = "value", drop_zeros: bool = False) -> DataFrame:
    """A row for each cell of an array whose axes have these names and values."""
    if array.shape != tuple(len(v) for v in keys.values()):
        raise ValueError("the array's shape doesn't fit the values of its axes")
    at = np.nonzero(array) if drop_zeros else tuple(x.ravel() for x in np.indices(array.shape))
    columns = {k: pa.array([*v]).take(pa.array(i)) for (k, v), i in zip(keys.items(), at, strict=True)}
    return spark.createDataFrame(pa.table(columns | {value: pa.array(array[at])}))


def square_zones(matrix: DataFrame, origin: str = "origin", destination: str = "destination", value: str = "value") -> DataFrame:
    """A matrix over the union of its zones on both sides, null where it has no cell; unequal sides warn."""
    rows, cols = (matrix.select(F.col(c).alias("zone")).distinct() for c in (origin, destination))
    if not rows.exceptAll(cols).isEmpty() or not cols.exceptAll(rows).isEmpty():
        warnings.warn("the matrix has zones on one side only", stacklevel=2)
    zones = rows.union(cols).distinct()
    spine = zones.select(F.col("zone").alias(origin)).crossJoin(zones.select(F.col("zone").alias(destination)))
    return spine.join(matrix, [origin, destination], "left").select(origin, destination, value)
