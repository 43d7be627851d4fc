"""Queries of operators over files that Spark makes from the tables, and of those that compare or check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from odweave.functions import collections as sets
from odweave.functions import scalars
from odweave.operators import distribution, frames, masks, report, reshape, translate
from odweave.operators.correspondence import Correspondence
from odweave.plans.base import costs, sectors, table, to_regions, trips
from odweave.plans.catalogue import DIST, EDGES, EXTERNAL, INSIDE, INTERNAL, MARGINS, OUTSIDE, query
from odweave.sources import ingest
from odweave.sources.shared import shared_folder


def _csv(df: DataFrame, name: str) -> str:
    """The folder of a table written as CSV."""
    folder = shared_folder(df.sparkSession, name)
    ingest.write_csv(df, folder)
    return folder


@query("SELECT p_partkey AS part, p_size AS size, p_retailprice AS price FROM part", False)
def csv_columns(spark, d):
    """Columns of a file by name and by place, in given types."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    out = ingest.read_csv(spark, _csv(p, "parts"), [0, "p_size", 3], {"p_partkey": "bigint", "p_size": "int", "p_retailprice": "double"})
    return out.toDF("part", "size", "price")


@query('SELECT s_suppkey AS "supp-key", s_acctbal AS "balance_£_(a.b)", s_nationkey AS nation FROM supplier', False)
def csv_plain_names(spark, d):
    """Columns of a file with unruly headers, asked for by their plain names."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias(" Nation"), F.col("s_suppkey").alias("Supp - KEY "), F.col("s_acctbal").alias("Balance £  (a.b)"))
    return ingest.read_csv(spark, _csv(s, "suppliers"), ["supp-key", "balance_£_(a.b)", "nation"], {"supp-key": "bigint", "balance_£_(a.b)": "double", "nation": "int"}, normalise=True)


@query("SELECT 'c_acctbal' AS \"column\", count(*) AS n FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'c_custkey', count(*) FROM customer WHERE c_custkey % 4 = 1", False)
def bad_values(spark, d):
    """How many values of each column of a file aren't of its type."""
    c = table(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("#"), "c_custkey")).otherwise(F.col("c_custkey").cast("string")).alias("c_custkey"),
        "c_name",
        F.when(F.col("c_custkey") % 9 == 0, "none").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
    )
    return ingest.bad_values(spark, _csv(c, "customers"), {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double"})


@query("SELECT origin, destination, CAST(value AS DOUBLE) AS value FROM trips")
def matrix_long_file(spark, d):
    """A long matrix from a file."""
    return ingest.read_matrix(spark, _csv(trips(spark, d), "long"))


@query("SELECT origin, destination, CAST(value AS DOUBLE) AS value FROM trips")
def matrix_square_file(spark, d):
    """A square matrix from a file."""
    return ingest.read_matrix(spark, _csv(reshape.long_to_wide(trips(spark, d), "origin", "destination", "value"), "square"))


@query('SELECT "from" AS nation, "to" AS region, factors AS share FROM regions')
def correspondence_file(spark, d):
    """A correspondence from a file, checked."""
    t = to_regions(spark, d).table.select(F.col("factors").alias("share"), F.col("to").alias("region"), F.col("from").alias("nation"))
    own = ingest.read_correspondence(spark, _csv(t, "regions"), "nation", "region", "share", check=True).checked()
    return own.table.withColumnRenamed("factors", "share").select("nation", "region", "share")


@query('SELECT r."to" AS region, sum(t.a * r.factors) AS a, sum(t.b * r.factors) AS b FROM regions r JOIN (SELECT origin, sum(value) AS a, CAST(count(*) AS DOUBLE) AS b FROM trips GROUP BY 1) t ON t.origin = r."from" GROUP BY 1')
def vector_file(spark, d):
    """A file of a vector's numbers and a text, translated into another file."""
    v = trips(spark, d).groupBy("origin").agg(F.sum("value").alias("a"), F.count("*").cast("double").alias("b")).withColumn("note", F.lit("text"))
    out = shared_folder(spark, "translated")
    ingest.translate_vector_file(spark, _csv(v, "vector"), _csv(to_regions(spark, d).table, "regions"), out, "origin")
    return ingest.read_csv(spark, out, types={"to": "int", "a": "double", "b": "double"}).withColumnRenamed("to", "region")


@query("SELECT origin, destination, value FROM sector_trips")
def matrix_file(spark, d):
    """A file of a matrix, translated into another file."""
    out = shared_folder(spark, "translated")
    ingest.translate_matrix_file(spark, _csv(trips(spark, d), "matrix"), _csv(to_regions(spark, d).table, "regions"), out)
    return ingest.read_csv(spark, out, types={"origin": "int", "destination": "int", "value": "double"})


@query('SELECT r."to" AS zone, coalesce(sum(t.value * r.factors), 0) AS value FROM regions r LEFT JOIN (SELECT origin, sum(value) AS value FROM trips GROUP BY 1) t ON t.origin = r."from" GROUP BY 1')
def translate_text_zones(spark, d):
    """Zones as text on one side and as numbers on the other."""
    vector = trips(spark, d).groupBy(F.col("origin").cast("string").alias("origin")).agg(F.sum("value").alias("value"))
    return translate.translate_vector(vector, to_regions(spark, d), "origin", ["value"]).withColumnRenamed("to", "zone")


@query("SELECT 2.0 AS zones, sum(value) FILTER (origin > 22) AS lost, sum(value) AS before, sum(value) FILTER (origin <= 22) AS after FROM trips")
def observed_losses(spark, d):
    """What one run of a translation has seen of itself."""
    lookup = Correspondence(table(spark, d, "nation").select(F.col("n_nationkey").alias("from"), F.col("n_regionkey").alias("to"), F.lit(1.0).alias("factors")).filter("from <= 22"))
    losses = translate.Losses()
    translate.translate_vector(trips(spark, d), lookup, "origin", ["value"], check=losses).write.format("noop").mode("overwrite").save()
    zones, sums = losses.lost("origin")
    before, after = losses.totals("value")
    return spark.createDataFrame([(float(zones), sums["value"], before, after)], "zones double, lost double, before double, after double")


@query(f"SELECT CAST(bin AS INTEGER) AS bin, min, max, avg, trips FROM ({DIST})")
def distribution_file(spark, d):
    """A cost distribution from a file."""
    own = distribution.Distribution.of(trips(spark, d).join(costs(spark, d), ["origin", "destination"]).withColumnRenamed("value", "trips"), EDGES)
    path = _csv(own.table.orderBy(F.desc("bin")).drop("bin").withColumnRenamed("min", "low"), "distribution")
    return distribution.Distribution.read(spark, path, min="low").checked().table.drop("weighted_avg")


@query(MARGINS.format("sector_trips"))
def report_files(spark, d):
    """The sector matrix of a report on files, written and read again."""
    own = report.MatrixReport.from_file(spark, _csv(trips(spark, d), "matrix"), _csv(to_regions(spark, d).table, "regions"))
    paths = report.write_frames({"Matrix": own.sector_matrix}, shared_folder(spark, "report"), "all")
    return spark.read.parquet(paths[0])


ENDS = """(SELECT zone, row_sum, column_sum FROM (SELECT origin AS zone, sum({v}) AS row_sum FROM sector_trips GROUP BY 1)
JOIN (SELECT destination AS zone, sum({v}) AS column_sum FROM sector_trips GROUP BY 1) USING (zone))"""


@query(f"SELECT zone, a.row_sum, b.row_sum AS row_b, a.row_sum - b.row_sum AS row_difference, round(a.row_sum / b.row_sum - 1, 9) AS row_ratio FROM {ENDS.format(v='value')} a JOIN {ENDS.format(v='2 * value')} b USING (zone)")
def report_trip_ends(spark, d):
    """Trip ends of two reports beside each other."""
    m, lookup = trips(spark, d), to_regions(spark, d)
    a, b = report.MatrixReport(m, lookup, accuracy=100), report.MatrixReport(m.withColumn("value", 2 * F.col("value")), lookup, accuracy=100)
    ends = a.compare(b)["Trip Ends"]
    return ends.select("zone", "row_sum", "row_b", "row_difference", F.round("row_ratio", 9).alias("row_ratio"))


@query(f"""SELECT a.bin, a.trips, b.trips AS trips_two FROM ({DIST}) a JOIN ({DIST}) b USING (bin)""")
def report_distributions(spark, d):
    """Distributions that two reports keep, beside each other."""
    m, lookup = trips(spark, d), to_regions(spark, d)
    a, b = report.MatrixReport(m, lookup, accuracy=100), report.MatrixReport(m, lookup, accuracy=100)
    for r in (a, b):
        r.calc_distribution(costs(spark, d), EDGES)
    return a.compare(b, ("one", "two"))["TLD comparison"].select("bin", "trips", "trips_two")


@query("SELECT 'left' AS side, o_custkey AS item FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT 'right', user_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT o_custkey FROM orders)", False)
def missing_items(spark, d):
    """Customers with orders that have no events, and users without orders."""
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    left, right = sets.missing_items(c, table(spark, d, "events").select(F.col("user_id").alias("k")).distinct(), "k")
    return left.select(F.lit("left").alias("side"), "item").unionByName(right.select(F.lit("right").alias("side"), "item"))


@query("SELECT true AS same, false AS other", False)
def same_items(spark, d):
    """Whether parts are the same in another order, and the same as suppliers' parts."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    return spark.createDataFrame([(sets.equal_ignoring_order(p, p.orderBy(F.desc("k")), "k"), sets.equal_ignoring_order(p, lines, "k"))], "same boolean, other boolean")


@query("SELECT conv_id, list_filter(list(role ORDER BY turn), lambda r: r <> 'user' AND r <> 'none') AS roles FROM conversations GROUP BY 1", False)
def items_removed(spark, d):
    """Roles of conversations without some."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]).alias("roles"))
    return turns.select("conv_id", sets.without_items(F.col("roles"), ["user", "none"]).alias("roles"))


MS = "CAST(event_id * event_id * 40 AS BIGINT)"


@query(f"""SELECT event_id, CASE WHEN h > 0 THEN printf('%dhrs %dm %.2fs', h, m, s) WHEN m > 0 THEN printf('%dm %.2fs', m, s) ELSE printf('%.2fs', s) END AS took
FROM (SELECT event_id, CAST(floor({MS} / 1000.0 / 3600) AS BIGINT) AS h, CAST(floor(({MS} / 1000.0) % 3600 / 60) AS BIGINT) AS m, ({MS} / 1000.0) % 60 AS s FROM events)""", False)
def durations(spark, d):
    """Milliseconds as text, from none to hundreds of hours."""
    return table(spark, d, "events").select("event_id", scalars.duration(F.expr("event_id * event_id * 40")).alias("took"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, epoch_us(ts) // 1000 AS ms FROM events", False)
def clocks(spark, d):
    """Times as text and as milliseconds."""
    t = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", scalars.clock(at=t).alias("at"), scalars.milliseconds(t).alias("ms"))


@query("SELECT origin, destination, value FROM sector_trips WHERE value <> 0")
def dense_array(spark, d):
    """A small matrix as an array and back."""
    array, zones = reshape.to_array(translate.translate_matrix(trips(spark, d), to_regions(spark, d)), ["origin", "destination"], "value", fill=0.0)
    return reshape.from_array(spark, array, zones, drop_zeros=True)


@query("SELECT a.i AS origin, b.i AS destination, t.value FROM (SELECT unnest([1, 2, 3, 21]) AS i) a CROSS JOIN (SELECT unnest([1, 2, 3, 21]) AS i) b LEFT JOIN trips t ON t.origin = a.i AND t.destination = b.i AND a.i < 4 AND b.i > 1")
def square_zones(spark, d):
    """A matrix over the zones of both sides, each of which lacks some."""
    return reshape.square_zones(trips(spark, d).filter("origin IN (1, 2, 3) AND destination IN (2, 3, 21)"))


@query(f"SELECT origin, destination, value FROM trips WHERE (origin IN {INSIDE}) <> (destination IN {OUTSIDE})")
def mask_either(spark, d):
    """Cells whose origin is inside or whose destination is outside, but not both."""
    return trips(spark, d).filter(masks.mask(INTERNAL, EXTERNAL, lambda a, b: a != b))


@query("SELECT c_custkey, n FROM (SELECT c_custkey, count(*) OVER (PARTITION BY floor((c_custkey - (SELECT min(c_custkey) FROM customer)) / 400)) AS n FROM customer)", False)
def chunks_counted(spark, d):
    """Each customer with the size of its chunk, chunk by chunk."""
    from odweave.sources.storage import Chunks

    def counted(chunk):
        import pyarrow as pa

        return chunk.append_column("n", pa.array([len(chunk)] * len(chunk), pa.int64()))

    c, folder = table(spark, d, "customer").select("c_custkey"), shared_folder(spark, "counted")
    schema = StructType([*c.schema.fields, StructField("n", LongType())])
    with Chunks(c, 400, "c_custkey") as parts:
        parts.each(counted, schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


@query("SELECT n_regionkey AS sector, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1", False)
def grouped_rows(spark, d):
    """Sectors with numbers of zones, summed up in one frame."""
    s = sectors(spark, d).select("sector", F.lit(1).cast("bigint").alias("n"))
    return frames.group_sum(s, ["sector", "n"], ["n"])
