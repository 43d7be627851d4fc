"""Distributions of trips over cost: bins, averages, shares and their comparison.

Bins of trips hold their lower edge, the last one its upper edge too; bins of weighted averages hold their
upper edge. A bin is found by an expression over the edges, so that a distribution is one scan and one
aggregate. Rows whose cost is NaN, null or outside all bins are in none.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odweave.operators.translate import clean, total


def edges_of(edges: Sequence[float] | None = None, low: Sequence[float] | None = None, high: Sequence[float] | None = None) -> list[float]:
    """Bin edges, given as such or as the bounds of bins."""
    if edges is None:
        if low is None or high is None:
            raise ValueError("give edges, or lower and upper bounds")
        edges = [low[0], *high]
    edges = [float(e) for e in edges]
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("edges must increase, and there must be two at least")
    return edges


def bin_of(cost: Column, edges: Sequence[float], upper: bool = False) -> Column:
    """The number of the bin that a cost is in, from 0, or null; upper for bins that hold their upper edge."""
    n, c = len(edges) - 1, clean(cost.cast("double"))
    array = F.array(*[F.lit(float(e)) for e in edges])
    below = F.size(F.filter(array, (lambda e: e < c) if upper else (lambda e: e <= c))) - 1
    at = below if upper else F.when(c == edges[-1], n - 1).otherwise(below)
    return F.when((at >= 0) & (at < n) & (c <= edges[-1]), at)


def spine(spark: SparkSession, edges: Sequence[float]) -> DataFrame:
    """(bin, min, max) of each bin."""
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return spark.createDataFrame(rows, "bin int, min double, max double")


def cost_distribution(
    trips: DataFrame, edges: Sequence[float], value: str = "trips", cost: str = "cost", by: Sequence[str] = ()
) -> DataFrame:
    """(by, bin, min, max, avg, trips, weighted_avg): trips of each bin, and their average cost.

    The average of a bin without trips is its middle. With by, each group gets every bin.
    """
    edges = edges_of(edges)
    v, c = clean(F.col(value)), clean(F.col(cost))
    keys = trips.select(*by, v.alias("_v"), c.alias("_c"), bin_of(c, edges).alias("_low"), bin_of(c, edges, True).alias("_high"))
    # one scan: a row counts for its bin of trips and, perhaps another, its bin of averages
    both = keys.select(
        *by,
        "_v",
        "_c",
        F.explode(
            F.when(F.col("_low").eqNullSafe(F.col("_high")), F.array(F.struct(F.col("_low").alias("b"), F.lit(3).alias("k"))))
            .otherwise(F.array(F.struct(F.col("_low").alias("b"), F.lit(1).alias("k")), F.struct(F.col("_high").alias("b"), F.lit(2).alias("k"))))
        ).alias("_x"),
    ).select(*by, "_v", "_c", F.col("_x.b").cast("int").alias("bin"), F.col("_x.k").alias("_k"))
    counted, averaged = F.col("_k").bitwiseAND(1) > 0, F.col("_k").bitwiseAND(2) > 0
    sums = both.filter("bin IS NOT NULL").groupBy(*by, "bin").agg(
        F.sum(F.when(counted, F.col("_v"))).alias("trips"),
        F.sum(F.when(averaged, F.col("_v") * F.col("_c"))).alias("_vc"),
        F.sum(F.when(averaged, F.col("_v"))).alias("_w"),
    )
    bins = spine(trips.sparkSession, edges)
    if by:
        bins = trips.select(*by).distinct().crossJoin(bins)
    middle = (F.col("min") + F.col("max")) / 2
    return bins.join(sums, [*by, "bin"], "left").select(
        *by,
        "bin",
        "min",
        "max",
        middle.alias("avg"),
        F.coalesce("trips", F.lit(0)).cast("double").alias("trips"),
        F.coalesce(F.try_divide("_vc", "_w"), middle).alias("weighted_avg"),
    )


def with_shares(dist: DataFrame, name: str = "share", by: Sequence[str] = ()) -> DataFrame:
    """A distribution with each bin's share of all trips, 0 where there are none."""
    every = F.sum("trips").over(Window.partitionBy(*by))
    return dist.withColumn(name, F.coalesce(F.try_divide(F.col("trips"), every), F.lit(0.0)))


def log_edges(highest: float, power: float = 0.51, factor: float = 2.2, final: float = 1500) -> list[float]:
    """Edges that widen with cost: as many as highest ** power, up to highest, and then one at final."""
    if not 0 < power < 1:
        raise ValueError("power must be between 0 and 1")
    if factor <= 0 or highest < 1 or final <= highest:
        raise ValueError("factor must be positive, highest 1 at least, and final more than highest")
    n = int(highest**power)
    inner = [float(int((i / n) ** factor * highest)) for i in range(2, n + 1)]
    return [0.0, *sorted(set(inner) - {0.0}), float(final)]


def dynamic_distribution(trips: DataFrame, value: str = "trips", cost: str = "cost", **edges) -> DataFrame:
    """A distribution over edges made from the highest cost, which one aggregate finds first."""
    highest = trips.agg(F.max(clean(cost))).first()[0]
    return cost_distribution(trips, log_edges(highest, **edges), value, cost)


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two distributions bin by bin: trips and trips_b, shares and shares_b."""
    x, y = with_shares(a), with_shares(b)
    return x.join(y.select("bin", F.col("trips").alias("trips_b"), F.col("share").alias("share_b")), "bin")


def residuals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bin, trips_residual, share_residual) of two distributions with the same bins."""
    return joined(a, b).select(
        "bin",
        (F.col("trips") - F.col("trips_b")).alias("trips_residual"),
        (F.col("share") - F.col("share_b")).alias("share_residual"),
    )


def convergence(pairs: DataFrame, target: str, achieved: str) -> DataFrame:
    """(convergence): 1 less the squared error over the target's variance, 0 at least.

    One aggregate. A missing value on either side gives 0, and so does a constant target, unless it is met.
    """
    t, a = F.col(target).cast("double"), F.col(achieved).cast("double")
    row = pairs.agg(
        F.sum(F.pow(a - t, 2)).alias("error"),
        F.var_pop(t).alias("variance"),
        F.count("*").alias("n"),
        F.count_if(clean(t).isNull() | clean(a).isNull()).alias("missing"),
    )
    ratio = F.try_divide(F.col("error"), F.col("variance") * F.col("n"))
    fit = F.when(F.col("error") == 0, 1.0).otherwise(F.coalesce(F.greatest(F.lit(0.0), 1 - ratio), F.lit(0.0)))
    return row.select(F.when((F.col("missing") > 0) | (F.col("n") == 0), 0.0).otherwise(fit).alias("convergence"))


def share_convergence(target: DataFrame, achieved: DataFrame) -> DataFrame:
    """(convergence) of the shares of two distributions."""
    return convergence(joined(target, achieved), "share", "share_b")


def intrazonal_costs(
    costs: DataFrame, multiplier: float = 0.5, by: str = "origin", origin: str = "origin", destination: str = "destination", cost: str = "cost"
) -> DataFrame:
    """Costs whose diagonal is a multiple of the least other cost of its origin (or destination), 0 left out.

    A zone without any gets an infinite cost. Diagonal cells that lack a row get one. Minima are aggregated
    by zone and joined, which a skewed zone doesn't slow down.
    """
    key = origin if by == "origin" else destination
    off = costs.filter((F.col(origin) != F.col(destination)) & (clean(cost) != 0))
    least = off.groupBy(F.col(key).alias("_zone")).agg(F.min(clean(cost)).alias("_least"))
    zones = costs.select(F.col(origin).alias("_zone")).union(costs.select(F.col(destination))).distinct()
    value = (F.coalesce("_least", F.lit(float("inf"))) * multiplier).cast("double")
    diagonal = zones.join(least, "_zone", "left").select(
        F.col("_zone").alias(origin), F.col("_zone").alias(destination), value.alias(cost)
    )
    rest = costs.filter(F.col(origin) != F.col(destination)).select(origin, destination, F.col(cost).cast("double").alias(cost))
    return rest.unionByName(diagonal)


@dataclass(frozen=True)
class Distribution:
    """A distribution's bins: a table of (bin, min, max, avg, trips, weighted_avg), one row a bin."""

    table: DataFrame

    @classmethod
    def of(cls, trips: DataFrame, edges: Sequence[float], value: str = "trips", cost: str = "cost") -> Distribution:
        """From trips and costs."""
        return cls(cost_distribution(trips, edges, value, cost))

    @classmethod
    def dynamic(cls, trips: DataFrame, value: str = "trips", cost: str = "cost", **edges) -> Distribution:
        """From trips and costs, with edges made from the highest cost; edges are log_edges' power, factor and final."""
        return cls(dynamic_distribution(trips, value, cost, **edges))

    @classmethod
    def read(cls, spark: SparkSession, path: str, **columns: str) -> Distribution:
        """From a CSV file; columns maps min, max, avg, trips and weighted_avg to the file's names."""
        raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
        names = {k: columns.get(k, k) for k in ("min", "max", "avg", "trips", "weighted_avg")}
        order = Window.orderBy(F.col(names["min"]))
        return cls(raw.select((F.row_number().over(order) - 1).alias("bin"), *[F.col(v).cast("double").alias(k) for k, v in names.items()]))

    def checked(self) -> Distribution:
        """Itself, if its values are finite and not negative; odd bins warn."""
        rows = self.rows()
        for r in rows:
            numbers = (r.min, r.max, r.trips)
            if any(x is None or not 0 <= x < float("inf") for x in numbers):
                raise ValueError(f"bin {r.bin} holds a negative, missing or infinite value")
        if rows and rows[0].min != 0:
            warnings.warn("the first bin doesn't start at 0", stacklevel=2)
        if any(a.max != b.min for a, b in zip(rows, rows[1:], strict=False)) or any(r.min >= r.max for r in rows):
            warnings.warn("bins overlap, leave gaps or have no width", stacklevel=2)
        return self

    def rows(self) -> list:
        """The bins, of which there are hundreds at most, in order."""
        return self.table.orderBy("bin").collect()

    def values(self, name: str) -> list[float]:
        """One column of the bins, in order."""
        return [r[name] for r in self.rows()]

    @property
    def edges(self) -> list[float]:
        """All edges."""
        rows = self.rows()
        return [rows[0].min, *[r.max for r in rows]]

    @property
    def shares(self) -> list[float]:
        """Each bin's share of the trips."""
        return [r.share for r in with_shares(self.table).orderBy("bin").collect()]

    def with_trips(self, trips: Sequence[float]) -> Distribution:
        """A new distribution with the same bins and other trips."""
        rows = self.rows()
        if len(trips) != len(rows):
            raise ValueError(f"there are {len(rows)} bins and {len(trips)} values")
        new = [(r.bin, r.min, r.max, r.avg, float(t), r.weighted_avg) for r, t in zip(rows, trips, strict=True)]
        return Distribution(self.table.sparkSession.createDataFrame(new, "bin int, min double, max double, avg double, trips double, weighted_avg double"))

    def _same_bins(self, other: Distribution) -> None:
        a, b = self.edges, other.edges
        if len(a) != len(b) or any(abs(x - y) > 1e-8 + 1e-5 * abs(y) for x, y in zip(a, b, strict=True)):
            raise ValueError("the bins differ")

    def residuals(self, other: Distribution) -> DataFrame:
        """Differences of trips and shares by bin."""
        self._same_bins(other)
        return residuals(self.table, other.table)

    def convergence(self, other: Distribution) -> float:
        """How well other's shares meet this one's."""
        self._same_bins(other)
        return share_convergence(self.table, other.table).first()[0]

    def __len__(self) -> int:
        return self.table.count()
