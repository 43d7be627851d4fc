"""Sketches of distinct values: columns of bounded size that merge over time, segments or sectors."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.operators.correspondence import Correspondence
from odweave.operators.translate import common_type

#: Bits that number a sketch's registers: it has 2 ** BITS of them, whatever the data's size.
BITS = 14


def error_bound(bits: int = BITS, deviations: float = 3.0) -> float:
    """The relative error that an estimate stays under, but for one in some hundreds at three standard deviations."""
    return deviations * 1.04 / sqrt(1 << bits)


def distinct_sketches(df: DataFrame, keys: Sequence[str], item: str, bits: int = BITS) -> DataFrame:
    """(keys, sketch) of the distinct values of a column; made before the shuffle, so that hot keys send one row a task."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(item, bits).alias("sketch"))


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sketch): sketches of fewer keys, without the data."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def translated(sketches: DataFrame, lookup: Correspondence, zone: str, keys: Sequence[str] = ()) -> DataFrame:
    """(target zone, keys, sketch): what each target zone gets a share of, counted once."""
    kind, pairs = common_type(sketches, zone, lookup.table, lookup.source), lookup.pairs().filter("_factor <> 0").select("_from", "_to").distinct()
    moved = sketches.withColumn("_zone", F.col(zone).cast(kind)).join(pairs.withColumn("_from", F.col("_from").cast(kind)), F.col("_zone") == F.col("_from"))
    return merged(moved.select(F.col("_to").alias(lookup.target), *keys, "sketch"), [lookup.target, *keys])


def estimate(sketch: str = "sketch") -> Column:
    """The number of distinct values of a sketch."""
    return F.hll_sketch_estimate(sketch)
