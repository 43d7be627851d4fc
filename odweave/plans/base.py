"""The tables that the catalogue's queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.operators.correspondence import Correspondence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(origin, destination, *more, value): quantities between the nations of supplier and customer.

    Lines are summed up by order and supplier's nation before they meet customers.
    """
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    by_order = lines.groupBy("l_orderkey", F.col("s_nationkey").alias("origin"), *[m for m in more if m.startswith("l_")]).agg(F.sum("l_quantity").alias("value"))
    joined = by_order.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("origin", F.col("c_nationkey").alias("destination"), *more).agg(F.sum("value").alias("value"))


def to_regions(spark: SparkSession, sf_dir: str, own: float = 0.75, step: int = 1) -> Correspondence:
    """Nations to regions: a share for the nation's own region, and the rest for another."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("from"), F.col("n_regionkey").alias("r"))
    rows = F.array(
        F.struct(F.col("r").alias("to"), F.lit(own).alias("factors")),
        F.struct(F.pmod(F.col("r") + step, F.lit(5)).cast("int").alias("to"), F.lit(1 - own).alias("factors")),
    )
    return Correspondence(n.select("from", F.explode(rows).alias("x")).select("from", "x.to", "x.factors"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, sector): nations and their regions."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone"), F.col("n_regionkey").alias("sector"))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, destination, cost) between all nations: whole numbers under 40."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    o, d = n.withColumnRenamed("n_nationkey", "origin"), n.withColumnRenamed("n_nationkey", "destination")
    # 25 nations
    return o.crossJoin(d).withColumn("cost", ((F.col("origin") * 7 + F.col("destination") * 13) % 40).cast("double"))


TRIPS = """SELECT s_nationkey AS origin, c_nationkey AS destination{more}, sum(l_quantity) AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY ALL"""
REGIONS = """SELECT n_nationkey AS "from", n_regionkey AS "to", CAST({own} AS DOUBLE) AS factors FROM nation
UNION ALL SELECT n_nationkey, CAST((n_regionkey + {step}) % 5 AS INTEGER), CAST(1 - {own} AS DOUBLE) FROM nation"""
COSTS = """SELECT a.n_nationkey AS origin, b.n_nationkey AS destination, CAST((a.n_nationkey * 7 + b.n_nationkey * 13) % 40 AS DOUBLE) AS cost
FROM nation a, nation b"""


def with_tables(select: str) -> str:
    """A query over trips, regions, regions2, costs, cells (trips with costs) and sector_trips."""
    return f"""WITH trips AS ({TRIPS.format(more="")}),
seg_trips AS ({TRIPS.format(more=", l_returnflag, c_mktsegment")}),
regions AS ({REGIONS.format(own=0.75, step=1)}),
regions2 AS ({REGIONS.format(own=0.5, step=2)}),
costs AS ({COSTS}),
cells AS (SELECT t.*, c.cost FROM trips t JOIN costs c USING (origin, destination)),
spine AS (SELECT a."to" AS origin, b."to" AS destination FROM (SELECT DISTINCT "to" FROM regions) a, (SELECT DISTINCT "to" FROM regions) b),
moved AS (SELECT a."to" AS origin, b."to" AS destination, sum(value * a.factors * b.factors) AS value
          FROM trips JOIN regions a ON origin = a."from" JOIN regions b ON destination = b."from" GROUP BY ALL),
sector_trips AS (SELECT s.origin, s.destination, coalesce(m.value, 0) AS value FROM spine s LEFT JOIN moved m USING (origin, destination))
{select}"""
