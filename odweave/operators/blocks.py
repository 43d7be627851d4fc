"""Sparse matrices and N-D arrays as tables of blocks, which tasks make, multiply and read; none passes through the driver."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.operators.reshape import positions
from odweave.operators.translate import clean

#: Rows and columns of a block.
SIDE = 256
#: Cells of a chunk of an array at most.
CHUNK_CELLS = 1 << 22


def _checked(c: Column, n: int, what: str) -> Column:
    """A place, which raises where it is outside a side of n."""
    wrong = F.concat(F.lit(f"{what} "), c.cast("string"), F.lit(f" is outside of 0 to {n - 1}"))
    return F.when((c >= 0) & (c < n), c).otherwise(F.raise_error(wrong).cast("bigint"))


@dataclass(frozen=True)
class Blocks:
    """A sparse matrix of a known shape: rows (br, bc, i, j, v) of blocks, places inside them and values.

    Made from coordinates; places outside of the shape raise in the plan that reads them. Cells that several rows
    name add up, null and NaN count as 0.
    """

    table: DataFrame
    shape: tuple[int, int]
    side: int = SIDE

    @classmethod
    def of(cls, cells: DataFrame, shape: tuple[int, int], i: str = "i", j: str = "j", value: str = "value", side: int = SIDE) -> Blocks:
        """The blocks of cells (i, j, value)."""
        at = [_checked(F.col(c).cast("bigint"), n, w).alias(k) for c, n, w, k in ((i, shape[0], "row", "i"), (j, shape[1], "column", "j"))]
        own = cells.select(*at, clean(F.col(value).cast("double")).alias("v")).groupBy("i", "j").agg(F.sum("v").alias("v")).filter("v <> 0")
        return cls(cls._packed(own, side), tuple(shape), side)

    @staticmethod
    def _packed(cells: DataFrame, side: int) -> DataFrame:
        block = lambda c: F.floor(F.col(c) / side).cast("bigint")
        inside = [F.pmod(F.col(c), F.lit(side)).cast("int").alias(c) for c in ("i", "j")]
        rows = cells.select(block("i").alias("br"), block("j").alias("bc"), F.struct(*inside, "v").alias("c"))
        # a block has side * side cells at most
        return rows.groupBy("br", "bc").agg(F.collect_list("c").alias("c")).select("br", "bc", "c.i", "c.j", "c.v")

    def cells(self) -> DataFrame:
        """(i, j, value) of all cells that aren't 0."""
        each = self.table.select("br", "bc", F.explode(F.arrays_zip("i", "j", "v")).alias("c"))
        place = lambda b, c: (F.col(b) * self.side + F.col(f"c.{c}")).alias(c)
        return each.select(place("br", "i"), place("bc", "j"), F.col("c.v").alias("value"))

    @property
    def T(self) -> Blocks:  # noqa: N802
        """The transpose."""
        swapped = self.table.select(F.col("bc").alias("br"), F.col("br").alias("bc"), F.col("j").alias("i"), F.col("i").alias("j"), "v")
        return Blocks(swapped, self.shape[::-1], self.side)

    def __matmul__(self, other: Blocks) -> Blocks:
        """The product: blocks meet by their inner side, and products of blocks are added up by cells."""
        if self.shape[1] != other.shape[0]:
            raise ValueError(f"a matrix of {self.shape} can't be multiplied by one of {other.shape}")
        if self.side != other.side:
            raise ValueError("both matrices need blocks of the same side")
        side = self.side
        a = self.table.select("br", F.col("bc").alias("k"), *[F.col(c).alias(f"a{c}") for c in "ijv"])
        b = other.table.select(F.col("br").alias("k"), "bc", *[F.col(c).alias(f"b{c}") for c in "ijv"])

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(len(batch)):
                    br, bc = batch["br"][r].as_py(), batch["bc"][r].as_py()
                    ai, aj, av, bi, bj, bv = (batch[c][r].values.to_numpy() for c in ("ai", "aj", "av", "bi", "bj", "bv"))
                    x, y = np.zeros((side, side)), np.zeros((side, side))
                    x[ai, aj], y[bi, bj] = av, bv
                    rows, cols = np.unique(ai), np.unique(bj)
                    z = x[rows] @ y[:, cols]
                    p, q = np.nonzero(z)
                    yield pa.RecordBatch.from_pydict({"i": br * side + rows[p].astype(np.int64), "j": bc * side + cols[q].astype(np.int64), "v": z[p, q]})

        made = a.join(b, "k").select("br", "bc", "ai", "aj", "av", "bi", "bj", "bv").mapInArrow(multiply, "i long, j long, v double")
        added = made.groupBy("i", "j").agg(F.sum("v").alias("v")).filter("v <> 0")
        return Blocks(self._packed(added, side), (self.shape[0], other.shape[1]), side)


def translate_blocks(matrix: Blocks, rows: Blocks, columns: Blocks | None = None) -> Blocks:
    """RᵀMC: a square matrix by the factors (from, to) of its rows and of its columns, the same by default."""
    columns = columns or rows
    if matrix.shape[0] != matrix.shape[1]:
        raise ValueError(f"a matrix of {matrix.shape} isn't square")
    for name, x in (("row", rows), ("column", columns)):
        if x.shape[0] != matrix.shape[0]:
            raise ValueError(f"{name} factors of {x.shape} don't fit a matrix of {matrix.shape}")
    return rows.T @ matrix @ columns


def translate_vector_blocks(vector: Blocks, factors: Blocks) -> Blocks:
    """A vector, as a matrix of one row or one column, by factors (from, to)."""
    if 1 not in vector.shape:
        raise ValueError(f"a vector has one row or one column, not the shape {vector.shape}")
    row = vector if vector.shape[0] == 1 else vector.T
    if row.shape[1] != factors.shape[0]:
        raise ValueError(f"factors of {factors.shape} don't fit a vector of {row.shape[1]}")
    return row @ factors


@dataclass(frozen=True)
class ArrayChunks:
    """An N-D array as rows (c0, c1, ..., data): which chunk it is, and its cells as little-endian doubles, the last axis running fastest.

    Chunks without a cell have no row; cells that none names have the fill value. A chunk at the array's far end is as
    large as what is left.
    """

    table: DataFrame
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    fill: float

    @classmethod
    def of(cls, cells: DataFrame, axes: Sequence[str], value: str, shape: Sequence[int], chunk: Sequence[int], fill: float = float("nan")) -> ArrayChunks:
        """The chunks of cells by their places along the axes; two rows for one cell raise, and so do places outside."""
        shape, chunk = tuple(shape), tuple(min(c, n) for c, n in zip(chunk, shape, strict=True))
        if len(axes) != len(shape) or prod(chunk) > CHUNK_CELLS or min(chunk, default=1) < 1:
            raise ValueError(f"an axis for each side, and chunks of 1 to {CHUNK_CELLS} cells")
        n = range(len(shape))
        places = [_checked(F.col(a).cast("bigint"), s, a) for a, s in zip(axes, shape, strict=True)]
        at = cells.select(*[p.alias(f"i{k}") for k, p in zip(n, places, strict=True)], F.col(value).cast("double").alias("v"))
        # a chunk at the far end is narrower, which its cells' places follow
        wide = [F.least(F.lit(chunk[k]), F.lit(shape[k]) - F.floor(F.col(f"i{k}") / chunk[k]) * chunk[k]) for k in n]
        flat = reduce(lambda e, k: e * wide[k] + F.pmod(F.col(f"i{k}"), F.lit(chunk[k])), n, F.lit(0).cast("bigint"))
        own = at.select(*[F.floor(F.col(f"i{k}") / chunk[k]).cast("bigint").alias(f"c{k}") for k in n], flat.alias("at"), "v")
        keys = [f"c{k}" for k in n]

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            sides = [min(c, s - k.as_py() * c) for k, c, s in zip(key, chunk, shape, strict=True)]
            out, place = np.full(prod(sides), fill), rows["at"].to_numpy()
            if len(np.unique(place)) < len(place):
                raise ValueError("a cell has several rows")
            out[place] = rows["v"].to_numpy(zero_copy_only=False)
            return pa.table({**{c: pa.array([k.as_py()]) for c, k in zip(keys, key, strict=True)}, "data": pa.array([out.astype("<f8").tobytes()])})

        made = own.groupBy(*keys).applyInArrow(pack, ", ".join(f"{c} long" for c in keys) + ", data binary")
        return cls(made, shape, chunk, fill)

    def cells(self, axes: Sequence[str], value: str = "value", filled: bool = False) -> DataFrame:
        """A row for each cell of the chunks there are, with the fill value only if asked for."""
        n, chunk, shape, fill = range(len(self.shape)), self.chunk, self.shape, self.fill

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(len(b)):
                    key = [b[f"c{k}"][r].as_py() for k in n]
                    sides = [min(chunk[k], shape[k] - key[k] * chunk[k]) for k in n]
                    data = np.frombuffer(b["data"][r].as_py(), "<f8")
                    there = np.ones(len(data), bool) if filled else ~np.isnan(data) if np.isnan(fill) else data != fill
                    places = np.unravel_index(np.flatnonzero(there), sides)
                    yield pa.RecordBatch.from_arrays([*[pa.array(p + key[k] * chunk[k]) for k, p in enumerate(places)], pa.array(data[there])], names=[*[f"i{k}" for k in n], "v"])

        out = self.table.mapInArrow(unpack, ", ".join(f"i{k} long" for k in n) + ", v double")
        return out.toDF(*axes, value)

    def section(self, ranges: Sequence[tuple[int, int]]) -> ArrayChunks:
        """The chunks that hold cells of a part, given as (first, end) along each axis; others aren't read."""
        fits = [F.col(f"c{k}").between(a // self.chunk[k], (b - 1) // self.chunk[k]) for k, (a, b) in enumerate(ranges)]
        return ArrayChunks(self.table.filter(reduce(lambda x, y: x & y, fits)), self.shape, self.chunk, self.fill)


def chunks_of_keys(
    data: DataFrame, keys: Sequence[str], value: str, chunk: Sequence[int], maps: Mapping[str, Sequence] | None = None, fill: float = float("nan")
) -> tuple[ArrayChunks, dict[str, DataFrame]]:
    """The array of a table over the values of its keys, in given lists or in order, and the place (key, position) of each value.

    to_array's result for arrays of any size: neither cells nor keys come to the driver, only how many keys there are.
    """
    spark = data.sparkSession
    given = lambda k: spark.createDataFrame([(v, i) for i, v in enumerate(maps[k])], [k, "position"]).select(F.col(k).cast(data.schema[k].dataType), F.col("position").cast("bigint"))
    places = {k: given(k) if maps and k in maps else positions(data, k).withColumn("position", F.col("position").cast("bigint")) for k in keys}
    shape = [max(1, p.count()) for p in places.values()]
    axes = [f"_i{n}" for n in range(len(keys))]
    own = data.select(*keys, value)
    for axis, (k, p) in zip(axes, places.items(), strict=True):
        own = own.join(p.withColumnRenamed("position", axis), k)
    return ArrayChunks.of(own.select(*axes, value), axes, value, shape, chunk, fill), places


def keys_of_chunks(chunks: ArrayChunks, places: Mapping[str, DataFrame], value: str = "value", filled: bool = False) -> DataFrame:
    """A row for each cell of an array's chunks, with the keys of its places."""
    axes = [f"_i{n}" for n in range(len(places))]
    out = chunks.cells(axes, value, filled)
    for axis, (k, p) in zip(axes, places.items(), strict=True):
        out = out.join(p.withColumnRenamed("position", axis), axis)
    return out.select(*places, value)
