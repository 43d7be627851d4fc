"""Weighted many-to-many lookups from one zoning system to another."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Decimals to which the factors of a zone are summed up before they are held against 1.
DECIMALS = 6


@dataclass(frozen=True)
class Correspondence:
    """A table of (source zone, target zone, factor). Repeated pairs add up; factors of 0 keep their target."""

    table: DataFrame
    source: str = "from"
    target: str = "to"
    factor: str = "factors"

    def __post_init__(self):
        lacking = [c for c in (self.source, self.target, self.factor) if c not in self.table.columns]
        if lacking:
            raise ValueError(f"the correspondence lacks columns: {', '.join(lacking)}")
        kind = self.table.schema[self.factor].dataType
        if not isinstance(kind, NumericType):
            raise ValueError(f"factors must be numbers, not {kind.simpleString()}")

    @classmethod
    def accepted(cls, given: Correspondence | DataFrame | str, spark: SparkSession | None = None) -> Correspondence:
        """A correspondence as it is; a table with its first three columns, or the path of a CSV file, with a DeprecationWarning."""
        if isinstance(given, cls):
            return given
        warnings.warn("give a Correspondence, not a table or a path", DeprecationWarning, stacklevel=3)
        if isinstance(given, DataFrame):
            names = ("from", "to", "factors") if {"from", "to", "factors"} <= set(given.columns) else tuple(given.columns[:3])
            return cls(given, *names)
        from odweave.sources.ingest import read_correspondence

        return read_correspondence(spark, str(given))

    def checked(self) -> Correspondence:
        """Itself, after one aggregate over the table: null or negative factors raise, sums over 1 warn."""
        f = F.col(self.factor)
        sums = self.table.groupBy(self.source).agg(
            F.sum(f).alias("total"),
            F.count_if(f.isNull() | F.isnan(f.cast("double"))).alias("missing"),
            F.count_if(f < 0).alias("negative"),
        )
        row = sums.agg(
            F.sum("missing").alias("missing"),
            F.sum("negative").alias("negative"),
            F.count_if(F.round("total", DECIMALS) > 1).alias("over"),
        ).first()
        if row.missing:
            raise ValueError(f"{row.missing} factors are missing")
        if row.negative:
            raise ValueError(f"{row.negative} factors are negative")
        if row.over:
            warnings.warn(f"the factors of {row.over} zones sum to more than 1", stacklevel=2)
        return self

    def pairs(self, source: str = "_from", target: str = "_to", factor: str = "_factor") -> DataFrame:
        """The three columns under fixed names; rows without a target lead nowhere and are left out."""
        return self.table.select(
            F.col(self.source).alias(source), F.col(self.target).alias(target), F.col(self.factor).alias(factor)
        ).filter(F.col(target).isNotNull())

    def factor_sums(self) -> DataFrame:
        """(source, total) of each source zone."""
        return self.table.groupBy(self.source).agg(F.sum(self.factor).alias("total"))

    def targets(self, name: str | None = None) -> DataFrame:
        """The distinct target zones."""
        return self.pairs().select(F.col("_to").alias(name or self.target)).distinct()

    def only(self, zones: Iterable, side: str = "from") -> Correspondence:
        """The rows of some zones; a zone that doesn't occur raises KeyError."""
        if side not in ("from", "to"):
            raise ValueError(f"side must be 'from' or 'to', not {side!r}")
        zones, col = list(zones), self.source if side == "from" else self.target
        known = {r[0] for r in self.table.filter(F.col(col).isin(zones)).select(col).distinct().collect()}
        if unknown := [z for z in zones if z not in known]:
            raise KeyError(f"zones that don't occur: {unknown}")
        return replace(self, table=self.table.filter(F.col(col).isin(zones)))

    def renamed(self, source: str | None = None, target: str | None = None, factor: str | None = None) -> Correspondence:
        """The same rows under other column names."""
        new = {self.source: source or self.source, self.target: target or self.target, self.factor: factor or self.factor}
        return Correspondence(self.table.withColumnsRenamed(new), *new.values())

    def reversed_factors(self, factor) -> Correspondence:
        """The same zones with another factor, given as a Column."""
        return replace(self, table=self.table.withColumn(self.factor, factor))
