"""Set operations on columns of values, and folds of maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("item"))


def compare_sets(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(side, item): distinct values that only one side has."""
    x, y = _one(a, column), _one(b, column)
    left, right = x.subtract(y), y.subtract(x)
    return left.select(F.lit("left").alias("side"), "item").unionByName(right.select(F.lit("right").alias("side"), "item"))


def equal_ignoring_order(a: DataFrame, b: DataFrame, column: str) -> bool:
    """Whether both sides have the same values equally often."""
    x = _one(a, column).groupBy("item").agg(F.count("*").alias("n"))
    y = _one(b, column).groupBy("item").agg(F.count("*").alias("m"))
    both = x.join(y, x["item"].eqNullSafe(y["item"]), "full")
    return both.filter(~F.col("n").eqNullSafe(F.col("m"))).isEmpty()


def repeated(df: DataFrame, column: str) -> DataFrame:
    """(item, n) of values that stand several times."""
    return _one(df, column).groupBy("item").agg(F.count("*").alias("n")).filter("n > 1")


def is_unique(df: DataFrame, column: str) -> bool:
    """Whether no value stands twice."""
    return repeated(df, column).isEmpty()


def require_unique(df: DataFrame, column: str) -> DataFrame:
    """df, unless a value stands twice: that raises ValueError."""
    if bad := repeated(df, column).limit(5).collect():
        raise ValueError(f"values that stand several times: {[r.item for r in bad]}")
    return df


def missing_items(a: DataFrame, b: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(values of a that b lacks, values of b that a lacks); both sides must be unique."""
    require_unique(a, column), require_unique(b, column)
    x, y = _one(a, column), _one(b, column)
    return x.join(y, "item", "left_anti"), y.join(x, "item", "left_anti")


def without_items(items: Column, gone: Sequence, strict: bool = False) -> Column:
    """An array without these items; strict raises where one of them isn't there."""
    out = items
    for x in gone:
        less = F.array_remove(out, x)
        lacks = F.raise_error(F.lit(f"{x!r} isn't in the array"))
        out = F.when(F.array_contains(items, x), less).otherwise(lacks) if strict else less
    return out


def combine_maps(df: DataFrame, column: str, order: str, operation: Callable[[float, float], float], by: str | None = None) -> DataFrame:
    """(key, value): maps of numbers folded key by key in an order; a key that a fold starts with counts from 0.

    The first map's values are taken as they are. operation is called with two floats. A table function folds a
    key's values in their order as they come, and holds one value; for sums use add_maps, which combines before the shuffle.
    """
    keys = [by] if by else []
    entries = df.select(*keys, F.col(order).alias("_o"), F.explode(column).alias("key", "_v"))
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    entries = entries.join(first, keys) if by else entries.join(first)
    rows = entries.select(*keys, "key", F.col("_v").cast("double").alias("_v"), "_o", (F.col("_o") == F.col("_first")).alias("_begins"))
    fields = ", ".join(f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in [*keys, "key"])
    return ordered_fold(operation, [*keys, "key"], fields)(rows.asTable().partitionBy(*keys, "key").orderBy("_o"))


def ordered_fold(operation: Callable[[float, float], float], keys: Sequence[str], fields: str):
    """A table function that folds ``_v`` of the rows of each partition, in order; it begins with the first value where
    ``_begins`` says so, and from 0 otherwise, and gives (keys, value)."""

    class Fold:
        def __init__(self):
            self.keys, self.value = None, None

        def eval(self, row):
            v = row["_v"]
            if self.keys is None:
                self.keys = tuple(row[k] for k in keys)
                self.value = v if row["_begins"] else operation(0.0, v) if v is not None else None
            else:
                self.value = None if v is None or self.value is None else operation(self.value, v)

        def terminate(self):
            if self.keys is not None:
                yield (*self.keys, self.value)

    return F.udtf(Fold, returnType=f"{fields}, value double", useArrow=True)


def add_maps(df: DataFrame, column: str) -> DataFrame:
    """(key, value): sums of maps key by key."""
    return df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("value"))
