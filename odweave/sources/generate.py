"""Synthetic tables: ids, choices, floats and integers, each drawn where its row is."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unique_ids(spark: SparkSession, name: str, length: int, start: int = 0) -> DataFrame:
    """Consecutive ids."""
    return spark.range(start, start + length).withColumnRenamed("id", name)


@dataclass(frozen=True)
class Choice:
    """One of some values; all_values makes each occur, in the first rows."""

    values: Sequence
    all_values: bool = False

    def column(self, row: Column, length: int, seed: int) -> Column:
        """A value for a row."""
        if len(self.values) >= length:
            raise ValueError("there must be fewer values than rows")
        array, n = F.array(*[F.lit(v) for v in self.values]), len(self.values)
        drawn = F.floor(F.rand(seed) * n).cast("int")
        at = F.when(row < n, row.cast("int")).otherwise(drawn) if self.all_values else drawn
        return F.get(array, at)


@dataclass(frozen=True)
class Float:
    """A float from lower up to, and without, upper."""

    lower: float = 0.0
    upper: float = 1.0

    def column(self, row: Column, length: int, seed: int) -> Column:
        """A value for a row."""
        return F.lit(float(self.lower)) + F.rand(seed) * float(self.upper - self.lower)


@dataclass(frozen=True)
class Int:
    """An integer from lower up to, and without, upper."""

    lower: int = 0
    upper: int = 100

    def column(self, row: Column, length: int, seed: int) -> Column:
        """A value for a row."""
        return F.floor(F.lit(self.lower) + F.rand(seed) * (self.upper - self.lower)).cast("bigint")


def table_of(spark: SparkSession, length: int, seed: int, columns: Mapping[str, Choice | Float | Int]) -> DataFrame:
    """A table of generated columns; column n is drawn with seed + n."""
    rows = spark.range(length)
    return rows.select(*[g.column(F.col("id"), length, seed + n).alias(c) for n, (c, g) in enumerate(columns.items())])
