"""One query for each operator, over whole tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.functions import collections as sets
from odweave.functions import scalars
from odweave.operators import blocks, distribution, frames, masks, quantiles, report, reshape, sketches, temporal, translate
from odweave.operators.correspondence import Correspondence
from odweave.plans.base import costs, sectors, table, to_regions, trips, with_tables
from odweave.sources import archives, generate, storage
from odweave.sources.shared import shared_folder
from odweave.streaming.sessions import append_files, stream_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EDGES = [0, 2, 5, 10, 15, 20, 30, 39]
ARRAY = "[" + ", ".join(f"{e}.0" for e in EDGES) + "]"
INTERNAL, EXTERNAL = list(range(12)), list(range(10, 24))


def query(sql: str | None = None, tables: bool = True):
    """Register a function as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_tables(sql) if tables else sql
        return f

    return add


# Translation


@query('SELECT r."to" AS zone, coalesce(sum(t.value * r.factors), 0) AS value FROM regions r LEFT JOIN (SELECT origin, sum(value) AS value FROM trips GROUP BY 1) t ON t.origin = r."from" GROUP BY 1')
def translate_vector(spark, d):
    """Trip origins by region."""
    vector = trips(spark, d).groupBy("origin").agg(F.sum("value").alias("value"))
    return translate.translate_vector(vector, to_regions(spark, d), "origin", ["value"]).withColumnRenamed("to", "zone")


@query('SELECT r."to" AS zone, sum(t.a * r.factors) AS a, sum(t.b * r.factors) AS b FROM regions r JOIN (SELECT origin, sum(value) AS a, CAST(count(*) AS DOUBLE) AS b FROM trips GROUP BY 1) t ON t.origin = r."from" GROUP BY 1')
def translate_vector_columns(spark, d):
    """Several columns at once."""
    vector = trips(spark, d).groupBy("origin").agg(F.sum("value").alias("a"), F.count("*").cast("double").alias("b"))
    return translate.translate_vector(vector, to_regions(spark, d), "origin", ["a", "b"]).withColumnRenamed("to", "zone")


@query('SELECT r."to" AS zone, l_returnflag, c_mktsegment, sum(value * factors) AS value FROM seg_trips JOIN regions r ON origin = r."from" GROUP BY ALL')
def translate_vector_segmented(spark, d):
    """Trip origins by region and segments."""
    segments = ["l_returnflag", "c_mktsegment"]
    out = translate.translate_vector(trips(spark, d, *segments), to_regions(spark, d), "origin", ["value"], segments)
    return out.withColumnRenamed("to", "zone")


@query("SELECT origin, destination, value FROM sector_trips")
def translate_matrix(spark, d):
    """Trips between regions."""
    return translate.translate_matrix(trips(spark, d), to_regions(spark, d))


@query('SELECT a."to" AS origin, b."to" AS destination, sum(value * a.factors * b.factors) AS value FROM trips JOIN regions a ON origin = a."from" JOIN regions2 b ON destination = b."from" GROUP BY ALL')
def translate_matrix_two_lookups(spark, d):
    """Rows and columns by lookups of their own; no pair of regions is empty in this data."""
    return translate.translate_matrix(trips(spark, d), to_regions(spark, d), to_regions(spark, d, 0.5, 2), dense=False)


@query('SELECT a."to" AS origin, b."to" AS destination, CAST(sum(t.value * a.factors * b.factors) AS BIGINT) AS value FROM (SELECT origin, destination, CAST(trunc(sum(value) * 0.37) AS BIGINT) AS value FROM trips GROUP BY 1, 2) t JOIN (SELECT "from", "to", CAST(trunc(factors * 4) AS BIGINT) AS factors FROM regions) a ON origin = a."from" JOIN (SELECT "from", "to", CAST(trunc(factors * 4) AS BIGINT) AS factors FROM regions) b ON destination = b."from" GROUP BY 1, 2')
def translate_matrix_dtype(spark, d):
    """Values and factors cut to whole numbers before they are multiplied."""
    four = Correspondence(to_regions(spark, d).table.withColumn("factors", F.col("factors") * 4 + 0.5))
    return translate.translate_matrix(trips(spark, d).withColumn("value", F.col("value").cast("double") * 0.37), four, dtype="bigint")


@query('SELECT origin, destination, CAST(sum(CAST(value * 16 AS BIGINT)) AS BIGINT) AS value FROM sector_trips GROUP BY 1, 2')
def translate_matrix_typed(spark, d):
    """The same sums as whole numbers of sixteenths."""
    lookup = to_regions(spark, d)
    out = translate.translate_matrix(trips(spark, d), lookup)
    return out.withColumn("value", (F.col("value") * 16).cast("bigint"))


@query('SELECT count(DISTINCT origin) AS zones, coalesce(sum(value), 0) AS value, CAST(0 AS BIGINT) AS missing_cells FROM trips WHERE origin NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)')
def missing_zones(spark, d):
    """What a lookup of three regions leaves out."""
    own = Correspondence(to_regions(spark, d, 1.0).table.filter("factors > 0 AND to < 3"))
    return translate.dropped_zones(trips(spark, d), own, "origin", "value")


@query('SELECT (SELECT sum(value) FROM trips) AS before, (SELECT sum(value) FROM sector_trips) AS after, true AS equal')
def translation_totals(spark, d):
    """Totals before and after translation."""
    m = trips(spark, d)
    return translate.totals(m, translate.translate_matrix(m, to_regions(spark, d)), "value")


@query('SELECT "from", sum(factors) AS total FROM regions GROUP BY 1')
def corr_factor_sums(spark, d):
    """Sums of factors by nation."""
    return to_regions(spark, d).factor_sums()


@query('SELECT * FROM regions WHERE "to" IN (1, 3)')
def corr_subset(spark, d):
    """The lookup of two regions."""
    return to_regions(spark, d).only([1, 3], "to").table


# Distributions

BINS = f"""SELECT i - 1 AS bin, {ARRAY}[i] AS lo, {ARRAY}[i + 1] AS hi FROM generate_series(1, {len(EDGES) - 1}) g(i)"""
DIST = f"""SELECT CAST(bin AS INTEGER) AS bin, CAST(lo AS DOUBLE) AS min, CAST(hi AS DOUBLE) AS max, CAST((lo + hi) / 2 AS DOUBLE) AS avg,
coalesce(sum(value) FILTER (cost >= lo AND (cost < hi OR (hi = {EDGES[-1]} AND cost = hi))), 0) AS trips,
coalesce(sum(value * cost) FILTER (cost > lo AND cost <= hi) / nullif(sum(value) FILTER (cost > lo AND cost <= hi), 0), CAST((lo + hi) / 2 AS DOUBLE)) AS weighted_avg
FROM ({BINS}) b, cells GROUP BY bin, lo, hi"""


def _cells(spark, d):
    return report.with_costs(trips(spark, d), costs(spark, d))


def _rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"SELECT bin, min, max, avg, trips FROM ({DIST})")
def cost_distribution(spark, d):
    """Trips by bin of cost."""
    return distribution.cost_distribution(_cells(spark, d), EDGES, "value").drop("weighted_avg")


@query(f"SELECT bin, round(weighted_avg, 9) AS weighted_avg FROM ({DIST})")
def weighted_avg_bins(spark, d):
    """Average costs by bin."""
    return _rounded(distribution.cost_distribution(_cells(spark, d), EDGES, "value"), "weighted_avg").select("bin", "weighted_avg")


@query(f"SELECT bin, round(trips / sum(trips) OVER (), 9) AS share FROM ({DIST})")
def band_share(spark, d):
    """Shares of trips by bin."""
    dist = distribution.cost_distribution(_cells(spark, d), EDGES, "value")
    return _rounded(distribution.with_shares(dist), "share").select("bin", "share")


@query(f"SELECT bin, trips, round(trips / sum(trips) OVER (), 9) AS normalised FROM ({DIST})")
def norm_distribution(spark, d):
    """Trips, and the same summing to 1."""
    dist = distribution.cost_distribution(_cells(spark, d), EDGES, "value")
    return _rounded(distribution.with_shares(dist, "normalised"), "normalised").select("bin", "trips", "normalised")


@query("""SELECT CAST(e.bin AS INTEGER) AS bin, e.lo AS min, e.hi AS max, coalesce(sum(value) FILTER (cost >= lo AND (cost < hi OR (hi = 100 AND cost = hi))), 0) AS trips
FROM (SELECT row_number() OVER (ORDER BY lo) - 1 AS bin, lo, coalesce(lead(lo) OVER (ORDER BY lo), 100) AS hi FROM (
  SELECT DISTINCT CAST(floor(power(i / n, 2.2) * m) AS DOUBLE) AS lo FROM (SELECT max(cost) AS m, floor(power(max(cost), 0.51)) AS n FROM cells), generate_series(2, 20) g(i) WHERE i <= n
  UNION SELECT CAST(0 AS DOUBLE))) e, cells GROUP BY ALL""")
def dynamic_distribution(spark, d):
    """Trips by bins made from the highest cost."""
    return distribution.dynamic_distribution(_cells(spark, d), "value", final=100).select("bin", "min", "max", "trips")


@query(f"""SELECT CAST(n_regionkey AS INTEGER) AS sector, CAST(bin AS INTEGER) AS bin,
coalesce(sum(value) FILTER (cost >= lo AND (cost < hi OR (hi = {EDGES[-1]} AND cost = hi))), 0) AS trips
FROM ({BINS}) b, cells JOIN nation ON origin = n_nationkey GROUP BY ALL""")
def tld_by_sector(spark, d):
    """Trips by bin of cost and region of origin."""
    out = report.length_distribution(trips(spark, d), costs(spark, d), EDGES, sectors(spark, d))
    return out.select("sector", "bin", "trips")


RESIDUAL = DIST.replace("cells GROUP", "(SELECT * REPLACE (CASE WHEN origin < 12 THEN value ELSE 0 END AS value) FROM cells) cells GROUP")


def _two(spark, d):
    cells = _cells(spark, d)
    some = cells.withColumn("value", F.when(F.col("origin") < 12, F.col("value")).otherwise(0.0))
    return (distribution.cost_distribution(x, EDGES, "value") for x in (cells, some))


@query(f"""SELECT a.bin, a.trips - b.trips AS trips_residual, round(a.trips / sum(a.trips) OVER () - b.trips / sum(b.trips) OVER (), 9) AS share_residual
FROM ({DIST}) a JOIN ({RESIDUAL}) b USING (bin)""")
def dist_residuals(spark, d):
    """Differences of two distributions."""
    return _rounded(distribution.residuals(*_two(spark, d)), "share_residual")


@query(f"""SELECT round(greatest(0, 1 - sum(power(s - t, 2)) / sum(power(t - m, 2))), 9) AS convergence FROM (SELECT *, avg(t) OVER () AS m FROM
(SELECT a.trips / sum(a.trips) OVER () AS t, b.trips / sum(b.trips) OVER () AS s FROM ({DIST}) a JOIN ({RESIDUAL}) b USING (bin)))""")
def share_convergence(spark, d):
    """How well the shares of one distribution meet another's."""
    return _rounded(distribution.share_convergence(*_two(spark, d)), "convergence")


@query("""SELECT origin, destination, CASE WHEN origin = destination THEN 0.5 * min(CASE WHEN origin <> destination AND cost <> 0 THEN cost END) OVER (PARTITION BY origin) ELSE cost END AS cost FROM costs""")
def intrazonal_infill(spark, d):
    """Costs inside zones from the least cost of their origin."""
    return distribution.intrazonal_costs(costs(spark, d))


# Reports

DESCRIBE = """SELECT unnest(['count', 'mean', 'std', 'min', 'p5', 'p25', 'p50', 'p75', 'p95', 'max', 'columns', 'rows', 'sum', 'zeros', 'almost_zeros', 'missing']) AS statistic,
round(unnest([CAST(count(value) AS DOUBLE), avg(value), stddev_samp(value), min(value), quantile_cont(value, 0.05), quantile_cont(value, 0.25), quantile_cont(value, 0.5),
quantile_cont(value, 0.75), quantile_cont(value, 0.95), max(value), count(DISTINCT destination), count(DISTINCT origin), sum(value), count(*) FILTER (value = 0),
count(*) FILTER (value < 1 / CAST((SELECT count(DISTINCT origin) * count(DISTINCT destination) FROM {0}) AS DOUBLE)), count(DISTINCT origin) * count(DISTINCT destination) - count(value)]), 6) AS value FROM {0}"""
MARGINS = """SELECT CASE WHEN grouping(origin) = 1 THEN 'sum' ELSE CAST(origin AS VARCHAR) END AS origin,
CASE WHEN grouping(destination) = 1 THEN 'sum' ELSE CAST(destination AS VARCHAR) END AS destination, sum(value) AS value FROM {0} GROUP BY CUBE (origin, destination)"""


@query(DESCRIBE.format("trips"))
def matrix_describe(spark, d):
    """Statistics of the matrix of trips."""
    return report.describe(trips(spark, d)).withColumn("value", F.round("value", 6))


@query(f"SELECT * FROM ({DESCRIBE.format(f'({MARGINS.format("sector_trips")})')})")
def sector_describe(spark, d):
    """Statistics of the translated matrix with its margins."""
    own = report.MatrixReport(trips(spark, d), to_regions(spark, d)).describe()
    return own.select("statistic", F.round("translated_matrix", 6).alias("value"))


@query("SELECT zone, row_sum, column_sum FROM (SELECT origin AS zone, sum(value) AS row_sum FROM sector_trips GROUP BY 1) JOIN (SELECT destination AS zone, sum(value) AS column_sum FROM sector_trips GROUP BY 1) USING (zone)")
def trip_ends(spark, d):
    """Row and column sums of the translated matrix."""
    return report.MatrixReport(trips(spark, d), to_regions(spark, d)).trip_ends


@query(MARGINS.format("sector_trips"))
def matrix_sums(spark, d):
    """The translated matrix with margins."""
    return report.MatrixReport(trips(spark, d), to_regions(spark, d)).sector_matrix


@query("SELECT sum(value * cost) AS vkms FROM cells")
def vkm_total(spark, d):
    """Vehicle-kilometres."""
    return report.vehicle_kms(trips(spark, d), costs(spark, d))


@query('SELECT r."to" AS sector, sum(value * cost * factors) AS vkms FROM cells JOIN regions r ON origin = r."from" GROUP BY 1')
def vkm_by_sector(spark, d):
    """Vehicle-kilometres by region of origin."""
    return report.vehicle_kms(trips(spark, d), costs(spark, d), to_regions(spark, d)).withColumnRenamed("to", "sector")


def _by_flag(spark, d, flag):
    return trips(spark, d, "l_returnflag").filter(F.col("l_returnflag") == flag).drop("l_returnflag")


BY_FLAG = "(SELECT origin, destination, sum(value) AS value FROM seg_trips WHERE l_returnflag = '{0}' GROUP BY 1, 2)"
PAIRED = f"(SELECT origin, destination, a.value AS a, b.value AS b FROM {BY_FLAG.format('A')} a FULL JOIN {BY_FLAG.format('R')} b USING (origin, destination))"


@query(f"SELECT origin, destination, a, b, a - b AS difference, round(a / nullif(b, 0) - 1, 9) AS ratio, abs(a - b) AS abs_difference, round(abs(a - b) / nullif(a, 0), 9) AS abs_ratio FROM {PAIRED}")
def matrix_compare(spark, d):
    """Two matrices cell by cell."""
    return _rounded(report.compare(_by_flag(spark, d, "A"), _by_flag(spark, d, "R")), "ratio", "abs_ratio")


@query(MARGINS.format(f"""(SELECT s.origin, s.destination, coalesce(sum(abs(a - b) * x.factors * y.factors), 0) AS value FROM spine s LEFT JOIN ({PAIRED} p
JOIN regions x ON p.origin = x."from" JOIN regions y ON p.destination = y."from") ON s.origin = x."to" AND s.destination = y."to" GROUP BY 1, 2)"""))
def abs_difference(spark, d):
    """Absolute differences of two matrices, translated."""
    return report.abs_difference(_by_flag(spark, d, "A"), _by_flag(spark, d, "R"), to_regions(spark, d))


@query(MARGINS.format("""(SELECT s.origin, s.destination, coalesce(sum(abs(coalesce(a, 0) - coalesce(b, 0)) * x.factors * y.factors), 0) AS value FROM spine s LEFT JOIN
(SELECT origin, destination, a.value AS a, b.value AS b FROM (SELECT * FROM trips WHERE (origin + destination) % 3 > 0) a FULL JOIN (SELECT * FROM trips WHERE (origin * destination) % 2 = 0) b USING (origin, destination)) p
JOIN regions x ON p.origin = x."from" JOIN regions y ON p.destination = y."from" ON s.origin = x."to" AND s.destination = y."to" GROUP BY 1, 2)"""))
def abs_difference_sparse(spark, d):
    """Absolute differences of two matrices that lack different cells, each of which is 0 there."""
    all_ = trips(spark, d)
    a, b = all_.filter("(origin + destination) % 3 > 0"), all_.filter("(origin * destination) % 2 = 0")
    return report.abs_difference(a, b, to_regions(spark, d))


def _compared(spark, d):
    a, b = (report.MatrixReport(_by_flag(spark, d, f), to_regions(spark, d)) for f in "AR")
    return a.compare(b)


@query(f"SELECT statistic, x.value AS a, y.value AS b FROM ({DESCRIBE.format(BY_FLAG.format('A'))}) x JOIN ({DESCRIBE.format(BY_FLAG.format('R'))}) y USING (statistic)")
def report_stats(spark, d):
    """Statistics of two matrices side by side."""
    return _rounded(_compared(spark, d)["stats"], "a", "b", digits=6)


SECTORS_OF = """(SELECT s.origin, s.destination, coalesce(sum({1} * x.factors * y.factors), 0) AS value FROM spine s LEFT JOIN ({0} p
JOIN regions x ON p.origin = x."from" JOIN regions y ON p.destination = y."from") ON s.origin = x."to" AND s.destination = y."to" GROUP BY 1, 2)"""


@query(f"SELECT origin, destination, round(d.value / nullif(m.value, 0), 9) AS value FROM ({MARGINS.format(SECTORS_OF.format(PAIRED, 'abs(a - b)'))}) d JOIN ({MARGINS.format(SECTORS_OF.format(BY_FLAG.format('A'), 'value'))}) m USING (origin, destination)")
def abs_percentage(spark, d):
    """Absolute differences of cells, by sectors, over the first matrix by sectors."""
    return _rounded(_compared(spark, d)["abs percentage"], "value")


# Reshaping

BRANDS = "(SELECT p_brand, p_size, sum(CAST(p_partkey % 7 AS DOUBLE)) AS value FROM part GROUP BY 1, 2)"


def _brands(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.sum((F.col("p_partkey") % 7).cast("double")).alias("value"))


@query(f"SELECT a.p_brand, b.p_size, coalesce(value, -1) AS value FROM (SELECT DISTINCT p_brand FROM {BRANDS}) a CROSS JOIN (SELECT DISTINCT p_size FROM {BRANDS}) b LEFT JOIN {BRANDS} c ON c.p_brand = a.p_brand AND c.p_size = b.p_size", False)
def product_infill(spark, d):
    """Every brand with every size."""
    return reshape.product_infill(_brands(spark, d), ["p_brand", "p_size"], -1)


SIZES = list(range(1, 51))
WIDE = ", ".join(f'coalesce(sum(value) FILTER (p_size = {s}), 0) AS "{s}"' for s in SIZES)
NAMES, CELLS = (", ".join(f"{q}{s}{q}" for s in SIZES) for q in ("'", '"'))


@query(f"SELECT p_brand, {WIDE} FROM {BRANDS} GROUP BY 1", False)
def long_to_wide(spark, d):
    """Sizes as columns."""
    return reshape.long_to_wide(_brands(spark, d), "p_brand", "p_size", "value", SIZES)


@query(f"SELECT p_brand, unnest([{NAMES}]) AS p_size, unnest([{CELLS}]) AS value FROM (SELECT p_brand, {WIDE} FROM {BRANDS} GROUP BY 1)", False)
def wide_to_long(spark, d):
    """Columns as rows."""
    return reshape.wide_to_long(long_to_wide(spark, d), "p_brand", "p_size", "value")


@query(f"SELECT CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS i0, CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS INTEGER) AS i1, value FROM {BRANDS}", False)
def nd_coordinates(spark, d):
    """Cells by position."""
    return reshape.to_coordinates(_brands(spark, d), ["p_brand", "p_size"], "value")


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, embedding[i] AS value FROM embeddings, generate_series(1, 512) g(i) WHERE i <= len(embedding) AND embedding[i] <> 0", False)
def array_to_rows(spark, d):
    """Vectors as coordinates, zeros left out."""
    return reshape.explode_array(table(spark, d, "embeddings"), ["vec_id"], "embedding", ["i"], drop_zeros=True)


@query(f"SELECT n_rows, cells, n_rows / cells AS utilisation, n_rows / cells < 1.0 / 3 AS feasible FROM (SELECT count(*) AS n_rows, CAST(count(DISTINCT p_brand) AS DOUBLE) * count(DISTINCT p_size) AS cells FROM {BRANDS})", False)
def sparse_feasible(spark, d):
    """Whether the cells are few."""
    return reshape.sparse_feasible(_brands(spark, d), ["p_brand", "p_size"])


@query("SELECT destination AS origin, origin AS destination, value FROM trips")
def transpose(spark, d):
    """The matrix with its sides exchanged."""
    return reshape.transpose(trips(spark, d))


# Masks

INSIDE = f"({', '.join(map(str, INTERNAL))})"
OUTSIDE = f"({', '.join(map(str, EXTERNAL))})"


@query(f"SELECT origin, destination, CASE WHEN origin IN {INSIDE} AND destination IN {INSIDE} THEN value ELSE 0 END AS value FROM trips")
def mask_internal(spark, d):
    """Trips with both ends inside."""
    return masks.masked(trips(spark, d), masks.internal_mask(INTERNAL))


@query(f"SELECT origin, destination, CASE WHEN origin IN {OUTSIDE} OR destination IN {OUTSIDE} THEN value ELSE 0 END AS value FROM trips")
def mask_external(spark, d):
    """Trips with either end outside."""
    return masks.masked(trips(spark, d), masks.external_mask(EXTERNAL))


@query(f"SELECT origin, destination, value, CASE WHEN origin IN {INSIDE} THEN 'I' ELSE 'E' END || CASE WHEN destination IN {INSIDE} THEN 'I' ELSE 'E' END AS zone_class FROM trips WHERE origin IN {INSIDE} OR destination IN {INSIDE}")
def mark_int_ext(spark, d):
    """Trips with their class, those between external zones left out."""
    return masks.mark_internal_external(trips(spark, d), INTERNAL, keep_external=False)


@query(f"""SELECT origin_class, coalesce(sum(value) FILTER (destination IN {INSIDE}), 0) AS internal, coalesce(sum(value) FILTER (destination IN {OUTSIDE}), 0) AS external,
coalesce(sum(value) FILTER (destination IN {INSIDE}), 0) + coalesce(sum(value) FILTER (destination IN {OUTSIDE}), 0) AS total
FROM (SELECT *, 'internal' AS origin_class FROM trips WHERE origin IN {INSIDE} UNION ALL SELECT *, 'external' FROM trips WHERE origin IN {OUTSIDE}
UNION ALL SELECT *, 'total' FROM trips WHERE origin IN {INSIDE} UNION ALL SELECT *, 'total' FROM trips WHERE origin IN {OUTSIDE}) GROUP BY 1""")
def int_ext_report(spark, d):
    """Nine sums of internal and external zones; three zones are both."""
    return masks.internal_external_report(trips(spark, d), INTERNAL, EXTERNAL)


# Frames


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view', 'purchase') AND user_id IN (1, 2, 3, 5, 8, 13)", False)
def filter_df(spark, d):
    """Events of some types and users."""
    wanted = {"event_type": ["click", "view", "purchase"], "user_id": [1, 2, 3, 5, 8, 13]}
    return frames.filter_rows(table(spark, d, "events"), wanted).select("event_id", "event_type", "value")


@query("SELECT n_name, n_nationkey, CAST(NULL AS DOUBLE) AS extra FROM nation", False)
def reindex_cols(spark, d):
    """Columns in another order, and one that isn't there."""
    return frames.reindex_columns(table(spark, d, "nation"), ["n_name", "n_nationkey", "extra"], strict=False)


@query("SELECT o.i AS origin, d.i AS destination, CASE WHEN t.origin IS NULL THEN -1 ELSE value END AS value FROM (SELECT unnest([3, 4, 30]) AS i) o CROSS JOIN (SELECT unnest([1, 2, 40]) AS i) d LEFT JOIN trips t ON t.origin = o.i AND t.destination = d.i")
def reindex_matrix(spark, d):
    """Some cells, and new ones."""
    return frames.reindex_matrix(trips(spark, d), [3, 4, 30], [1, 2, 40], -1)


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY 1, 2", False)
def groupby_sum(spark, d):
    """Sums by flag and status."""
    columns = ["l_returnflag", "l_linestatus", "l_quantity", "l_linenumber"]
    return frames.group_sum(table(spark, d, "lineitem"), columns, columns[2:])


@query("SELECT c_custkey, concat_ws('_', CAST(c_nationkey AS VARCHAR), c_mktsegment, coalesce(CAST(nullif(c_custkey % 3, 0) AS VARCHAR), 'nan')) AS key FROM customer", False)
def str_join(spark, d):
    """Columns as one string."""
    c = table(spark, d, "customer").withColumn("third", F.nullif(F.col("c_custkey") % 3, F.lit(0)))
    return c.select("c_custkey", frames.join_strings(["c_nationkey", "c_mktsegment", "third"]).alias("key"))


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) / 1000) AS BIGINT) AS chunk_id FROM orders", False)
def chunk(spark, d):
    """Orders in runs of a thousand."""
    return frames.chunked(table(spark, d, "orders"), 1000, "o_custkey", ["o_orderkey"]).select("o_orderkey", "chunk_id")


# Scalars and sets


def _pairs(spark, d):
    e = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("t"), F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).otherwise(0)).alias("a"))
    return e


PAIRS = "(SELECT l_suppkey, sum(l_quantity) AS t, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS a FROM lineitem GROUP BY 1)"


@query(f"SELECT round(sqrt(avg(power(t - a, 2))), 6) AS rmse FROM {PAIRS}", False)
def rmse(spark, d):
    """Root mean square error of two sums by supplier."""
    return scalars.rmse(_pairs(spark, d), "t", "a").select(F.round("rmse", 6).alias("rmse"))


@query(f"SELECT round(greatest(0, 1 - sum(power(1.2 * a + t * 0.4 - t, 2)) / (var_pop(t) * count(*))), 9) AS convergence FROM {PAIRS}", False)
def curve_convergence(spark, d):
    """How well one column meets another."""
    pairs = _pairs(spark, d).withColumn("a", F.col("a") * 1.2 + F.col("t") * 0.4)
    return _rounded(distribution.convergence(pairs, "t", "a"), "convergence")


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 AND s_acctbal < 500 THEN 500 ELSE s_acctbal END AS clipped FROM supplier", False)
def clip_small(spark, d):
    """Small positive balances raised."""
    return table(spark, d, "supplier").select("s_suppkey", scalars.clip_small(F.col("s_acctbal"), 500).alias("clipped"))


@query("SELECT p_partkey, abs(p_retailprice - round(p_retailprice, -1)) <= 0.001 * greatest(abs(p_retailprice), abs(round(p_retailprice, -1))) AS close FROM part", False)
def almost_equal(spark, d):
    """Whether prices are nearly round."""
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", scalars.is_close(p, F.round(p, -1), 1e-3).alias("close"))


@query("SELECT conv_id, list_max(l) - list_min(l) <= 0.5 * list_max(l) AND abs(list_max(l) - l[1]) <= 0.5 * list_max(l) AND abs(list_min(l) - l[1]) <= 0.5 * l[1] AS close FROM (SELECT conv_id, list(CAST(turn AS DOUBLE) + 10 ORDER BY turn) AS l FROM conversations GROUP BY 1)", False)
def list_almost_equal(spark, d):
    """Whether all turns' numbers are near the first's."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.col("turn").cast("double") + 10)).alias("l"))
    return turns.select("conv_id", scalars.all_close(F.col("l"), 0.5).alias("close"))


@query("SELECT event_id, CASE WHEN value < 20 THEN NULL ELSE value END AS out, user_id FROM events WHERE value < 20 OR value IS NULL", False)
def nan_report(spark, d):
    """Events whose derived value is missing, with what it came from."""
    e = table(spark, d, "events").withColumn("out", F.when(F.col("value") < 20, float("nan")).otherwise(F.col("value")))
    return scalars.nan_report(e, ["event_id"], "out", ["user_id"]).withColumn("out", translate.clean("out"))


@query("SELECT CASE WHEN c IS NULL THEN 'right' ELSE 'left' END AS side, coalesce(c, s) AS item FROM (SELECT DISTINCT c_nationkey + 5 AS c FROM customer) FULL JOIN (SELECT DISTINCT s_nationkey AS s FROM supplier) ON c = s WHERE c IS NULL OR s IS NULL", False)
def set_compare(spark, d):
    """Nations that only customers, or only suppliers, have."""
    c = table(spark, d, "customer").select((F.col("c_nationkey") + 5).alias("k"))
    return sets.compare_sets(c, table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT o_custkey AS item, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1", False)
def repeated_items(spark, d):
    """Customers with several orders."""
    return sets.repeated(table(spark, d, "orders"), "o_custkey")


@query("SELECT l_returnflag || l_linestatus AS key, sum(l_quantity) AS value FROM lineitem GROUP BY 1", False)
def add_maps(spark, d):
    """Maps of quantities by flag and status, summed up."""
    key = F.concat("l_returnflag", "l_linestatus")
    return sets.add_maps(table(spark, d, "lineitem").select(F.create_map(key, F.col("l_quantity")).alias("m")), "m")


@query("""SELECT s_nationkey AS nation, CAST(s_suppkey % 2 AS VARCHAR) AS key,
2 * coalesce(sum(s_suppkey) FILTER (s_suppkey = f), 0) - sum(CAST(s_suppkey AS DOUBLE)) AS value
FROM supplier JOIN (SELECT s_nationkey, min(s_suppkey) AS f FROM supplier GROUP BY 1) USING (s_nationkey) GROUP BY 1, 2""", False)
def combine_maps(spark, d):
    """Maps subtracted one from another, in the order of suppliers."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.create_map((F.col("s_suppkey") % 2).cast("string"), F.col("s_suppkey").cast("double")).alias("m"))
    return sets.combine_maps(s, "m", "s_suppkey", lambda a, b: a - b, "nation")


@query("SELECT doc_id, source IS NULL OR lower(trim(source)) = 'none' AS none_like, regexp_matches(source, '^(src1)') AS begins FROM documents", False)
def none_like(spark, d):
    """Documents without a source."""
    return table(spark, d, "documents").select(
        "doc_id", scalars.is_none_like(F.col("source")).alias("none_like"), scalars.starts_with(F.col("source"), "src1").alias("begins")
    )


@query('SELECT p_partkey, p_retailprice AS "price_£", p_size AS "size<=50_&_>0", p_retailprice * 0.2 AS "tax_20%_(v1.2)-net" FROM part', False)
def plain_names(spark, d):
    """Parts under plain forms of unruly names."""
    p = table(spark, d, "part")
    return scalars.plain_names(p.select("p_partkey", F.col("p_retailprice").alias("  Price  £ "), F.col("p_size").alias("Size<=50 & >0"), (F.col("p_retailprice") * 0.2).alias("Tax 20% (v1.2)  -  NET")))


SHARES = [0.0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]


@query(f"SELECT unnest(CAST({SHARES} AS DOUBLE[])) AS share, round(unnest(quantile_cont(l_extendedprice, {SHARES})), 6) AS price FROM lineitem", False)
def exact_percentiles(spark, d):
    """Percentiles of prices by counting passes, with few values left for the last one."""
    found = quantiles.percentiles(table(spark, d, "lineitem"), "l_extendedprice", SHARES, limit=50, bins=64)
    return spark.createDataFrame([(s, round(p, 6)) for s, p in zip(SHARES, found, strict=True)], "share double, price double")


@query("SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS number FROM part", False)
def to_numeric(spark, d):
    """Numbers of brands, null where there is none."""
    p = table(spark, d, "part").select("p_partkey", F.substring("p_brand", 7, 20).alias("number"))
    return scalars.to_numeric(p, "number", "coerce")


@query("SELECT CAST(i + 100 AS BIGINT) AS id FROM generate_series(0, 999) g(i)", False)
def generated_ids(spark, d):
    """Consecutive ids."""
    return generate.unique_ids(spark, "id", 1000, 100)


@query()
def generated_values(spark, d):
    """Random values; tests check their properties."""
    n = 1000
    return generate.table_of(spark, n, 7, {"choice": generate.Choice(["a", "b", "c"], all_values=True), "x": generate.Float(0, 5), "k": generate.Int(3, 9)})


# Time


@query("""SELECT c.event_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""", False)
def asof_views(spark, d):
    """The last view of each click's user."""
    e = table(spark, d, "events")
    views = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return temporal.asof_join(e.filter("event_type = 'click'"), views, "ts", "view_ts", ["user_id"], ["view_id", "view_value"], ["view_id"]).select("event_id", "view_id", "view_value")


@query("""SELECT o_orderkey, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
FROM (SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey * 7919 % 43200) AS a, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey * 7919 % 43200 + (o_custkey % 97) * (o_custkey % 97)) AS b FROM orders) o
JOIN (SELECT event_id, user_id, ts AS x, ts + to_minutes(event_id % 50) AS y FROM events) e ON user_id = o_custkey AND a <= y AND x <= b GROUP BY 1""", False)
def order_windows(spark, d):
    """Events whose span meets the time that an order of the same customer is open, from minutes to a week."""
    start = "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, {})"
    o = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey AS user_id", f"{start.format('o_orderkey * 7919 % 43200')} AS a", f"{start.format('o_orderkey * 7919 % 43200 + (o_custkey % 97) * (o_custkey % 97)')} AS b")
    e = table(spark, d, "events").selectExpr("event_id", "user_id", "ts AS x", "ts + make_dt_interval(0, 0, event_id % 50) AS y")
    met = temporal.interval_join(o, e, ("a", "b"), ("x", "y"), ["user_id"])
    return met.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


SESSIONS = """SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2"""


@query(SESSIONS, False)
def event_sessions(spark, d):
    """Sessions of users, each after six hours without an event."""
    own = temporal.sessions(table(spark, d, "events"), ["user_id"], "ts", 6 * 3600 * 10**6)
    return own.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"SELECT user_id, n, first_ts, last_ts FROM ({SESSIONS}) WHERE last_ts + INTERVAL 6 HOURS < (SELECT max(ts) FROM events) - INTERVAL 1 DAY", False)
def streamed_sessions(spark, d):
    """Those sessions that a stream of events has closed, with rows allowed to be a day late."""
    path, folder = f"{d}/events.parquet", shared_folder(spark, "sessions")
    # a pattern, as a stream takes no single file otherwise
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = stream_sessions(e, ["user_id"], "ts", "6 hours", "1 day", {"n": F.count("*")})
    append_files(closed, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.schema(closed.schema).parquet(f"{folder}/out")
    return out.select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("first_ts"), F.col("end").cast("timestamp_ntz").alias("last_ts"))


# Storage, blocks and sketches


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem WHERE l_partkey BETWEEN 500 AND 520", False)
def sorted_range(spark, d):
    """Lines of some parts, from files in the order of parts."""
    lines, folder = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"), shared_folder(spark, "sorted")
    storage.write_sorted(lines, folder, ["l_partkey", "l_orderkey"])
    return spark.read.schema(lines.schema).parquet(folder).filter("l_partkey BETWEEN 500 AND 520").drop("l_partkey")


@query("SELECT origin, destination, value FROM sector_trips WHERE value <> 0")
def blocked_translation(spark, d):
    """Trips between regions as a product of sparse blocks, the last of which are narrower."""
    m = blocks.Blocks.of(trips(spark, d), (25, 25), "origin", "destination", side=8)
    r = blocks.Blocks.of(to_regions(spark, d).table, (25, 5), "from", "to", "factors", side=8)
    return blocks.translate_blocks(m, r).cells().toDF("origin", "destination", "value")


@query("SELECT origin, destination, sum(value) AS value FROM (SELECT a.origin, b.destination, a.value * b.value AS value FROM trips a JOIN trips b ON a.destination = b.origin) GROUP BY 1, 2")
def blocked_product(spark, d):
    """Trips of two steps: the matrix by itself."""
    m = blocks.Blocks.of(trips(spark, d), (25, 25), "origin", "destination", side=7)
    return (m @ m).cells().toDF("origin", "destination", "value")


@query("SELECT vec_id, CAST(d - 1 AS BIGINT) AS place, CAST(embedding[d] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS d FROM embeddings) WHERE vec_id >= 100 AND d > 20", False)
def array_chunks(spark, d):
    """A part of the array of all vectors, from the chunks that hold it."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.max("vec_id")).first()[0] + 1
    cells = e.select("vec_id", F.posexplode("embedding").alias("place", "x"))
    made = blocks.ArrayChunks.of(cells, ["vec_id", "place"], "x", (n, 64), (300, 24))
    return made.section([(100, n), (20, 64)]).cells(["vec_id", "place"], "x").filter("vec_id >= 100 AND place >= 20")


@query("""SELECT c_nationkey, count(*) AS n, CAST(sum(c_custkey) FILTER (c_custkey % 70 <> 0) AS BIGINT) AS keys,
count(*) FILTER (c_custkey % 50 = 0) AS bad_balance, count(*) FILTER (c_custkey % 70 = 0) AS bad_key FROM customer GROUP BY 1""", False)
def archive_rejects(spark, d):
    """Customers in an archive for each nation, some with cells that are no numbers, read with what is rejected."""
    c, folder = table(spark, d, "customer"), shared_folder(spark, "archives")
    key = F.when(F.col("c_custkey") % 70 == 0, F.concat(F.lit("no. "), "c_custkey")).otherwise(F.col("c_custkey").cast("string"))
    balance = F.when(F.col("c_custkey") % 50 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    own = c.select("c_nationkey", key.alias("key"), balance.alias("balance"), F.concat("c_name", F.lit(', "the customer"')).alias("name"))
    for k, suffix in enumerate((".zip", ".tar.xz", ".tar")):
        archives.write_members(own.filter(F.col("c_nationkey") % 3 == k), folder, "c_nationkey", suffix, 40).count()
    got = archives.typed(archives.read_members(spark, folder), {"c_nationkey": "bigint", "key": "bigint", "balance": "double"})
    bad = lambda x: F.count_if(F.exists("rejected", lambda r: r["column"] == x)).alias(f"bad_{x}")
    return got.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("key").alias("keys"), bad("balance"), bad("key"))


@query("""SELECT r."to" AS zone, count(DISTINCT o_custkey) AS customers, true AS within_bound FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN orders ON l_orderkey = o_orderkey JOIN regions r ON r."from" = s_nationkey GROUP BY 1""")
def zone_sketches(spark, d):
    """Customers of each region's suppliers: exact, and whether sketches by nation and year, merged, come near enough."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lookup, own = to_regions(spark, d), lines.select(F.col("s_nationkey").alias("nation"), F.year("o_orderdate").alias("year"), "o_custkey")
    by_year = sketches.distinct_sketches(own, ["nation", "year"], "o_custkey")
    near = sketches.translated(sketches.merged(by_year, ["nation"]), lookup, "nation").select("to", sketches.estimate().alias("near"))
    exact = own.join(lookup.pairs(), F.col("nation") == F.col("_from")).groupBy(F.col("_to").alias("to")).agg(F.count_distinct("o_custkey").alias("customers"))
    within = F.abs(F.col("near") - F.col("customers")) <= F.col("customers") * sketches.error_bound()
    return exact.join(near, "to").select(F.col("to").alias("zone"), "customers", within.alias("within_bound"))


from odweave.plans import files as _files  # noqa: E402, F401  registers its queries
