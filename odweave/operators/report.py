"""Reports on matrices and comparisons of two."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.operators.correspondence import Correspondence
from odweave.operators.distribution import cost_distribution
from odweave.operators.quantiles import percentiles
from odweave.operators.translate import clean, total, translate_matrix, translate_vector

OD = ("origin", "destination")
QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
#: Longest name of a sheet, and of a prefix to one.
SHEET, PREFIX = 31, 19


def describe(matrix: DataFrame, value: str = "value", almost_zero: float | None = None, accuracy: int | None = None) -> DataFrame:
    """(statistic, value) of a long matrix.

    Missing cells count only as such, whether they have no row, or null or NaN. almost_zero is the value under which
    a cell is almost zero, by default one over the matrix's size; zeros and negatives are under it. Exact percentiles
    are found by counting passes over the matrix, which run at once; accuracy takes values of the matrix instead whose
    ranks are off by one in accuracy at most, from the one aggregate that gives all else.
    """
    v = clean(F.col(value).cast("double"))
    size = F.count_distinct("origin") * F.count_distinct("destination")
    # values under the threshold are summed up by the threshold's own aggregate, so the size comes first
    sized = matrix.select("origin", "destination", v.alias("_v"))
    if almost_zero is None:
        limit = sized.agg((F.lit(1.0) / F.greatest(size, F.lit(1))).alias("_limit"))
        sized = sized.join(limit)
    else:
        sized = sized.withColumn("_limit", F.lit(float(almost_zero)))
    shares = list(QUANTILES.values())
    if accuracy is None:
        exact = F.array(*[F.lit(p).cast("double") for p in percentiles(sized, "_v", shares)])
    row = sized.agg(
        F.count("_v").cast("double").alias("count"),
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"),
        (exact if accuracy is None else F.percentile_approx("_v", shares, accuracy)).alias("_p"),
        F.max("_v").alias("max"),
        F.count_distinct("destination").cast("double").alias("columns"),
        F.count_distinct("origin").cast("double").alias("rows"),
        F.coalesce(F.sum("_v"), F.lit(0.0)).alias("sum"),
        F.count_if(F.col("_v") == 0).cast("double").alias("zeros"),
        F.count_if(F.col("_v") < F.col("_limit")).cast("double").alias("almost_zeros"),
    )
    row = row.withColumns({n: F.col("_p")[i] for i, n in enumerate(QUANTILES)})
    row = row.withColumn("missing", F.col("columns") * F.col("rows") - F.col("count"))
    names = ["count", "mean", "std", "min", *QUANTILES, "max", "columns", "rows", "sum", "zeros", "almost_zeros", "missing"]
    return row.select(*names).unpivot([], names, "statistic", "value")


def margins(matrix: DataFrame, value: str = "value", label: str = "sum") -> DataFrame:
    """The matrix with a sum of each row and column, and of all; zone names become strings."""
    data = matrix.filter(F.col("origin").isNotNull() & F.col("destination").isNotNull())
    cube = data.cube("origin", "destination").agg(total(value).alias(value), F.grouping("origin").alias("_o"), F.grouping("destination").alias("_d"))
    named = lambda c, g: F.when(F.col(g) == 1, F.lit(label)).otherwise(F.col(c).cast("string")).alias(c)
    return cube.select(named("origin", "_o"), named("destination", "_d"), value)


def trip_ends(matrix: DataFrame, value: str = "value") -> DataFrame:
    """(zone, row_sum, column_sum) of each zone that occurs on both sides."""
    rows = matrix.groupBy(F.col("origin").alias("zone")).agg(total(value).alias("row_sum"))
    cols = matrix.groupBy(F.col("destination").alias("zone")).agg(total(value).alias("column_sum"))
    return rows.join(cols, "zone")


def with_costs(matrix: DataFrame, costs: DataFrame, cost: str = "cost") -> DataFrame:
    """The cells of a matrix that have a cost."""
    return matrix.join(costs.select(*OD, F.col(cost).alias("cost")), list(OD))


def vehicle_kms(matrix: DataFrame, costs: DataFrame, sectors: Correspondence | None = None, value: str = "value") -> DataFrame:
    """(vkms) of all cells, or (sector, vkms) by the sector of the origin."""
    product = with_costs(matrix, costs).withColumn("vkms", clean(value) * clean("cost"))
    if sectors is None:
        return product.agg(total("vkms").alias("vkms"))
    return translate_vector(product, sectors, "origin", ["vkms"])


def length_distribution(
    matrix: DataFrame, costs: DataFrame, edges: Sequence[float], sectors: DataFrame | None = None, value: str = "value", check: bool = False
) -> DataFrame:
    """Distribution of a matrix over cost, of all cells or for each sector of origins, given as (zone, sector).

    check raises KeyError unless every origin has exactly one sector.
    """
    cells = with_costs(matrix, costs)
    if sectors is None:
        return cost_distribution(cells, edges, value)
    if check:
        count = sectors.groupBy("zone").agg(F.count("*").alias("n"))
        wrong = matrix.select(F.col("origin").alias("zone")).distinct().join(count, "zone", "left").filter(F.coalesce("n", F.lit(0)) != 1)
        if bad := wrong.limit(5).collect():
            raise KeyError(f"zones without exactly one sector: {[r.zone for r in bad]}")
    own = cells.join(sectors.select(F.col("zone").alias("origin"), "sector"), "origin")
    return cost_distribution(own, edges, value, by=["sector"])


def paired(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """(origin, destination, a, b) of the cells of either matrix."""
    return a.select(*OD, clean(value).alias("a")).join(b.select(*OD, clean(value).alias("b")), list(OD), "full")


def abs_difference(a: DataFrame, b: DataFrame, lookup: Correspondence, value: str = "value") -> DataFrame:
    """Absolute differences of cells, translated and with margins: opposite differences don't cancel out.

    A cell that a matrix lacks, or that is null or NaN there, is 0.
    """
    x, y = (F.coalesce(c, F.lit(0)) for c in ("a", "b"))
    cells = paired(a, b, value).select(*OD, F.abs(x - y).alias(value))
    return margins(translate_matrix(cells, lookup, value=value), value)


def compare(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """Cell by cell: a, b, difference, ratio (a / b - 1), abs_difference and abs_ratio (over a).

    A ratio over 0 is null.
    """
    x, y = F.col("a").cast("double"), F.col("b").cast("double")
    return paired(a, b, value).select(
        *OD, "a", "b",
        (F.col("a") - F.col("b")).alias("difference"),
        (F.try_divide(x, y) - 1).alias("ratio"),
        F.abs(F.col("a") - F.col("b")).alias("abs_difference"),
        F.try_divide(F.abs(x - y), x).alias("abs_ratio"),
    )


@dataclass
class MatrixReport:
    """A matrix, its translation to sectors, and what can be said about both. Frames are lazy."""

    matrix: DataFrame
    lookup: Correspondence
    value: str = "value"
    #: Whether to warn of zones that the translation leaves out, and of a changed total, which runs jobs.
    check: bool = False
    #: One over the share by which ranks of percentiles may be off; exact ones take passes of their own.
    accuracy: int | None = None
    #: What vehicle_kms and length_distribution have been asked for last.
    vkms: DataFrame | None = field(default=None, init=False)
    distribution: DataFrame | None = field(default=None, init=False)

    def __post_init__(self):
        self.translated = translate_matrix(self.matrix, self.lookup, value=self.value, check=self.check)

    @classmethod
    def from_file(cls, spark: SparkSession, matrix: str, correspondence: str, accuracy: int | None = None, **columns) -> MatrixReport:
        """A report on a CSV matrix in long or square form, by a CSV correspondence."""
        from odweave.sources.ingest import read_correspondence, read_matrix

        return cls(read_matrix(spark, matrix), read_correspondence(spark, correspondence, **columns), accuracy=accuracy)

    @property
    def sector_matrix(self) -> DataFrame:
        """The translated matrix with margins."""
        return margins(self.translated, self.value)

    @property
    def trip_ends(self) -> DataFrame:
        """Row and column sums of the translated matrix."""
        return trip_ends(self.translated, self.value)

    def describe(self) -> DataFrame:
        """Statistics of the matrix and of the translated matrix, its margins included."""
        own = describe(self.matrix, self.value, accuracy=self.accuracy).withColumnRenamed("value", "matrix")
        other = describe(self.sector_matrix, self.value, accuracy=self.accuracy)
        return own.join(other.withColumnRenamed("value", "translated_matrix"), "statistic")

    def calc_vehicle_kms(self, costs: DataFrame, sectors: Correspondence | None = None) -> DataFrame:
        """Keep and return vehicle-kilometres."""
        self.vkms = vehicle_kms(self.matrix, costs, sectors, self.value)
        return self.vkms

    def calc_distribution(self, costs: DataFrame, edges: Sequence[float], sectors: DataFrame | None = None) -> DataFrame:
        """Keep and return the distribution over cost."""
        self.distribution = length_distribution(self.matrix, costs, edges, sectors, self.value)
        return self.distribution

    def frames(self) -> dict[str, DataFrame]:
        """All parts of the report by name."""
        out = {"Summary": self.describe(), "Trip_Ends": self.trip_ends, "Matrix": self.sector_matrix}
        if self.distribution is None:
            warnings.warn("the report has no distribution yet", stacklevel=2)
        else:
            out["Distribution"] = self.distribution
        return out

    def compare(self, other: MatrixReport, names: tuple[str, str] = ("a", "b")) -> dict[str, DataFrame]:
        """Comparisons of the sector matrices, statistics, trip ends, and what both have of the rest."""
        a, b = names
        stats = [describe(r.matrix, r.value, accuracy=r.accuracy).withColumnRenamed("value", n) for r, n in ((self, a), (other, b))]
        gap = abs_difference(self.matrix, other.matrix, self.lookup, self.value)
        over = self.sector_matrix.select(*OD, F.col(self.value).cast("double").alias("_over"))
        ends = self.trip_ends.join(other.trip_ends.withColumnsRenamed({"row_sum": "row_b", "column_sum": "column_b"}), "zone")
        out = {
            f"{a} matrix": self.sector_matrix,
            f"{b} matrix": other.sector_matrix,
            "cells": compare(self.sector_matrix, other.sector_matrix, self.value),
            "abs difference": gap,
            "abs percentage": gap.join(over, list(OD)).select(*OD, F.try_divide(F.col(self.value).cast("double"), "_over").alias(self.value)),
            "stats": stats[0].join(stats[1], "statistic"),
            "Trip Ends": ends.withColumns(
                {
                    "row_difference": F.col("row_sum") - F.col("row_b"),
                    "row_ratio": F.try_divide(F.col("row_sum").cast("double"), F.col("row_b").cast("double")) - 1,
                    "column_difference": F.col("column_sum") - F.col("column_b"),
                    "column_ratio": F.try_divide(F.col("column_sum").cast("double"), F.col("column_b").cast("double")) - 1,
                }
            ),
        }
        for name, x, y in (("Vkms", self.vkms, other.vkms), ("TLD comparison", self.distribution, other.distribution)):
            if x is not None and y is not None:
                keys = [c for c in x.columns if c in (self.lookup.target, "sector", "bin")]
                renamed = y.withColumnsRenamed({c: f"{c}_{b}" for c in y.columns if c not in keys})
                out[name] = x.join(renamed, keys) if keys else x.join(renamed)
        return out


def write_frames(frames: dict[str, DataFrame], folder: str, prefix: str = "") -> list[str]:
    """Write each frame as Parquet under its name; the folders' paths."""
    if len(prefix) >= PREFIX:
        raise ValueError(f"a prefix has fewer than {PREFIX} characters")
    out = []
    for name, df in frames.items():
        full = f"{prefix}_{name}" if prefix else name
        if len(full) > SHEET:
            warnings.warn(f"the name {full!r} is longer than {SHEET} characters", stacklevel=2)
        out.append(f"{folder.rstrip('/')}/{full.replace(' ', '_')}")
        df.write.mode("overwrite").parquet(out[-1])
    return out


def compare_and_write(a: MatrixReport, b: MatrixReport, folder: str, names: tuple[str, str] = ("a", "b"), prefix: str = "") -> dict[str, str]:
    """Compare two reports and write each comparison under its name; the folders' paths by name."""
    frames = a.compare(b, names)
    return dict(zip(frames, write_frames(frames, folder, prefix), strict=True))
