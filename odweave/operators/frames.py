"""Projection, filtering, grouping and chunking of tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from odweave.operators.translate import total

#: Ranges that rows are numbered in at once.
RANGES = 200


def reindex_columns(df: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """These columns in this order; a missing one raises ValueError, or is null unless strict."""
    if strict and (lacking := [c for c in columns if c not in df.columns]):
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def reindex_matrix(matrix: DataFrame, rows: Sequence, columns: Sequence, fill=None, origin: str = "origin", destination: str = "destination", value: str = "value") -> DataFrame:
    """The cells of these rows and columns; new cells get fill, and cells that are there keep their nulls."""
    from odweave.operators.reshape import full_index

    spine = full_index(matrix.sparkSession, {origin: rows, destination: columns})
    spine = spine.select(*[F.col(c).cast(matrix.schema[c].dataType).alias(c) for c in (origin, destination)])
    joined = spine.join(matrix.select(origin, destination, value, F.lit(True).alias("_there")), [origin, destination], "left")
    new = F.lit(fill).cast(matrix.schema[value].dataType)
    return joined.select(origin, destination, F.when(F.col("_there"), F.col(value)).otherwise(new).alias(value))


def filter_mask(conditions: Mapping[str, object]) -> Column:
    """Whether each column has its value, or one of its values; a null (or None) among them matches nulls."""
    parts = []
    for c, wanted in conditions.items():
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        some = F.coalesce(F.col(c).isin([v for v in values if v is not None and v == v]), F.lit(False))
        parts.append(some | F.col(c).isNull() if any(v is None or v != v for v in values) else some)
    return reduce(and_, parts, F.lit(True))


def filter_rows(df: DataFrame, conditions: Mapping[str, object], strict: bool = False) -> DataFrame:
    """The rows of a mask; none raises ValueError if strict, which runs a job."""
    out = df.filter(filter_mask(conditions))
    if strict and out.isEmpty():
        raise ValueError(f"no row fits {dict(conditions)}")
    return out


def group_sum(df: DataFrame, columns: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums of values by the other columns; rows with a null key are left out."""
    if wrong := [v for v in values if v not in columns]:
        raise ValueError(f"values that aren't among the columns: {wrong}")
    if text := [v for v in values if not isinstance(df.schema[v].dataType, NumericType)]:
        raise TypeError(f"values that aren't numbers: {text}")
    keys = [c for c in columns if c not in values]
    return df.select(*columns).dropna(subset=keys).groupBy(*keys).agg(*[total(v).alias(v) for v in values])


def join_strings(columns: Sequence[str], separator: str = "_") -> Column:
    """Columns as strings, one after another; a null is written nan."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def numbered(df: DataFrame, key: str, ties: Sequence[str] = (), name: str = "row") -> DataFrame:
    """df with each row's place, from 0, in the order of a numeric key and then of ties; nulls come first.

    Rows are numbered range by range. Bounds of ranges come from the key's quantiles. A key value that is several
    quantiles has a range of its own, as nulls have, and such ranges are cut by the quantiles of the first of ties if
    that is a number; otherwise their rows share a task. The tables of bounds and counts, of at most RANGES squared
    entries, are broadcast.
    """
    k, shares = F.col(key), [i / RANGES for i in range(1, RANGES)]
    got = df.agg(F.percentile_approx(k, shares, 10_000), F.count_if(k.isNull())).first()
    found = got[0] or []
    heavy = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
    bounds = F.array(*[F.lit(b) for b in sorted(set(found))]) if found else F.array().cast("array<double>")
    at = F.when(k.isNull(), -1).otherwise(2 * F.size(F.filter(bounds, lambda b: b < k)) + F.coalesce(k.isin(heavy), F.lit(False)).cast("int"))
    ranged = df.withColumns({"_range": at, "_part": F.lit(0)})
    if (heavy or got[1]) and ties and isinstance(df.schema[ties[0]].dataType, NumericType):
        t = F.col(ties[0])
        cuts = ranged.filter("pmod(_range, 2) = 1").groupBy("_range").agg(F.percentile_approx(t, shares, 10_000).alias("_cuts"))
        part = F.when(F.col("_cuts").isNull(), 0).when(t.isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda b: b < t)))
        ranged = ranged.join(F.broadcast(cuts), "_range", "left").withColumn("_part", part)
    of = ["_range", "_part"]
    count = ranged.groupBy(*of).agg(F.count("*").alias("_n"))
    first = count.select(*of, (F.sum("_n").over(Window.orderBy(*of)) - F.col("_n")).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*of).orderBy(k.asc_nulls_first(), *ties)) - 1
    numbers = ranged.withColumn("_place", place).join(F.broadcast(first), of)
    return numbers.withColumn(name, F.col("_first") + F.col("_place")).select(*df.columns, name)


def chunked(df: DataFrame, size: int, key: str, ties: Sequence[str] = ()) -> DataFrame:
    """df with ``chunk_id``: which run of size rows, in order, a row is in."""
    if not isinstance(size, int) or isinstance(size, bool):
        raise TypeError("a chunk's size is an integer")
    if size <= 0:
        raise ValueError("a chunk's size is positive")
    return numbered(df, key, ties, "_row").withColumn("chunk_id", F.floor(F.col("_row") / size)).drop("_row")


def chunks(df: DataFrame, size: int, key: str, ties: Sequence[str] = ()) -> Iterator[DataFrame]:
    """The chunks one after another, each a lazy DataFrame; they are written once, and deleted after the last."""
    from odweave.sources.storage import Chunks

    with Chunks(df, size, key, ties) as all_:
        yield from all_
