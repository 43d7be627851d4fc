"""Operators on small tables, by known values and odd rows."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from odweave.functions import collections as sets
from odweave.functions import scalars
from odweave.operators import distribution, frames, masks, quantiles, report, reshape, translate
from odweave.operators.correspondence import Correspondence
from odweave.sources import generate, ingest
from odweave.streaming.translation import stream_translation


FACTORS = {(1, 7): 0.25, (1, 8): 0.75, (2, 7): 1.0, (3, 8): 0.5, (3, 9): 0.125, (3, 7): 0.375, (4, 9): 1.0}


@pytest.fixture
def lookup(spark):
    return Correspondence(spark.createDataFrame([(a, b, f) for (a, b), f in FACTORS.items()], "from int, to int, factors double"))


def moved(cells):
    """Cells {(row, column): value} by the target zones of FACTORS on both sides, in plain Python."""
    out = {(a, b): 0.0 for a in (7, 8, 9) for b in (7, 8, 9)}
    for (i, j), v in cells.items():
        for (p, a), f in FACTORS.items():
            for (q, b), g in FACTORS.items():
                if (p, q) == (i, j):
                    out[a, b] += v * f * g
    return out


def test_vector(spark, lookup):
    values = {1: 16.0, 2: 3.0, 3: 24.0, 4: 0.5}
    v = spark.createDataFrame([*values.items(), (9, 7.0), (None, 3.0), (1, float("nan"))], "zone int, v double")
    want = {z: sum(values[a] * f for (a, b), f in FACTORS.items() if b == z) for z in (7, 8, 9)}
    out = {r.to: r.v for r in translate.translate_vector(v, lookup, "zone", ["v"]).collect()}
    assert out == want
    lost = translate.dropped_zones(v.filter("zone IS NOT NULL"), lookup, "zone", "v").first()
    assert (lost.zones, lost.value) == (1, 7.0)
    with pytest.raises(ValueError, match="total"):
        translate.require_totals(v, translate.translate_vector(v, lookup, "zone", ["v"]), "v")
    text = v.withColumn("zone", F.col("zone").cast("string"))
    assert {r.to: r.v for r in translate.translate_vector(text, lookup, "zone", ["v"]).collect()} == out


def test_empty_targets(spark):
    c = Correspondence(spark.createDataFrame([(1, "A", 1.0), (2, "A", 0.5), (2, "B", 0.5), (5, "C", 1.0)], "from int, to string, factors double"))
    v = spark.createDataFrame([(1, "x", 10.0), (2, "x", 20.0), (9, "x", 30.0)], "zone int, seg string, v double")
    assert {r.to: r.v for r in translate.translate_vector(v, c, "zone", ["v"]).collect()} == {"A": 20, "B": 10, "C": 0}
    assert {(r.to, r.seg): r.v for r in translate.translate_vector(v, c, "zone", ["v"], ["seg"]).collect()} == {("A", "x"): 20, ("B", "x"): 10}


def test_matrix(spark, lookup):
    cells = {(i, j): float(8 * i - 3 * j * (i != j)) for i in range(1, 5) for j in range(1, 5)}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "origin int, destination int, value double")
    out = translate.translate_matrix(df, lookup).collect()
    assert {(r.origin, r.destination): r.value for r in out} == moved(cells)
    array, zones = reshape.to_array(translate.translate_matrix(df, lookup), ["origin", "destination"], "value")
    assert zones == {"origin": [7, 8, 9], "destination": [7, 8, 9]} and array.sum() == sum(cells.values())


def test_correspondence_checks(spark, lookup):
    with pytest.raises(ValueError, match="lacks"):
        Correspondence(lookup.table.drop("to"))
    with pytest.raises(ValueError, match="negative"):
        Correspondence(lookup.table.withColumn("factors", -F.col("factors"))).checked()
    with pytest.warns(UserWarning, match="more than 1"):
        Correspondence(lookup.table.withColumn("factors", 2 * F.col("factors"))).checked()
    with pytest.raises(KeyError):
        lookup.only([1, 77])


def test_distribution(spark):
    cells = [(float(3 * k % 11), float(k * k % 60)) for k in range(40)]
    edges = [0, 5, 10, 20, 45, 60]
    d = distribution.Distribution.of(spark.createDataFrame(cells, "trips double, cost double"), edges).checked()
    bins = list(zip(edges, edges[1:], strict=False))
    assert d.values("trips") == [sum(t for t, c in cells if a <= c < b) for a, b in bins] and len(d) == 5
    for got, (a, b) in zip(d.values("weighted_avg"), bins, strict=True):
        own = [(t, c) for t, c in cells if a < c <= b and t]
        assert got == pytest.approx(sum(t * c for t, c in own) / sum(t for t, _ in own))
    assert d.convergence(d) == 1 and d.residuals(d).agg(F.sum("trips_residual")).first()[0] == 0
    edge = spark.createDataFrame([(1.0, float(c)) for c in range(6)] + [(1.0, float("nan")), (1.0, None)], "trips double, cost double")
    e = distribution.cost_distribution(edge, [0, 2, 4]).orderBy("bin").collect()
    assert [r.trips for r in e] == [2, 3] and [r.weighted_avg for r in e] == [1.5, 3.5]
    assert distribution.log_edges(10, final=25) == [0, 4, 10, 25]
    assert distribution.log_edges(100, final=300) == [0, 2, 7, 13, 21, 32, 45, 61, 79, 100, 300]


def test_masks_and_report(spark):
    m = reshape.from_array(spark, np.arange(25.0).reshape(5, 5), {"origin": range(5), "destination": range(5)})
    rows = lambda i, e: [(r.internal, r.external, r.total) for r in masks.internal_external_report(m, i, e).collect()]
    assert rows([0, 1, 2], [3, 4]) == [(54, 51, 105), (111, 84, 195), (165, 135, 300)]
    assert rows([0, 1, 2], [2, 3, 4]) == [(54, 72, 126), (144, 162, 306), (198, 234, 432)]
    with pytest.raises(ValueError, match="no internal"):
        masks.mark_internal_external(m, [99], check=True)
    stats = {r.statistic: r.value for r in report.describe(m).collect()}
    assert stats["p25"] == 6 and stats["std"] == pytest.approx(np.arange(25).std(ddof=1)) and stats["almost_zeros"] == 1
    assert {(r.origin, r.destination): r.value for r in report.margins(m).collect()}["sum", "sum"] == 300


@pytest.mark.parametrize(("limit", "bins"), [(20_000, 1024), (3, 8), (1, 2)])
def test_exact_percentiles(spark, limit, bins):
    r = np.random.default_rng(4)
    shares = [0, 0.01, 0.05, 0.25, 1 / 3, 0.5, 0.95, 0.999, 1]
    wild = [-1e300, -3.0, -1e-300, 0.0, 5e-324, 1e-12, 1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1e16, 1e16 + 2, 1.7e308]
    for values in (r.normal(size=3000).tolist(), r.integers(0, 5, 500).astype(float).tolist(), wild, [4.0], [2.0] * 50):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(3)
        n, found = quantiles.rank_values(df, "v", range(0, len(values), max(1, len(values) // 40)), limit, bins)
        assert n == len(values) and found == {k: sorted(values)[k] for k in found} and len(found) >= min(len(values), 40)
        if values is not wild:
            assert quantiles.percentiles(df, "v", shares, limit, bins) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-13)
    assert quantiles.percentiles(df.limit(0), "v", [0.5]) == [None]


def test_percentiles_of_more_values_than_a_task_takes(spark, monkeypatch):
    """No stage of the search holds more rows of a value each than LIMIT or BINS."""
    df = spark.range(100_000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("value"), F.col("id").alias("origin"), F.lit(1).alias("destination"))
    values = np.sort(df.toPandas().value.to_numpy())
    monkeypatch.setattr(quantiles, "LIMIT", 100)
    seen, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    n, found = quantiles.rank_values(df, "value", [49_999], limit=100, bins=64)
    assert n == 100_000 and found == {49_999: values[49_999]} and max(map(len, seen)) <= 100
    stats = {r.statistic: r.value for r in report.describe(df).collect()}
    assert [stats["p95"], stats["p50"]] == pytest.approx(np.quantile(values, [0.95, 0.5]).tolist(), rel=1e-13)


def test_reshape(spark):
    long = spark.createDataFrame([(1, 3, "b"), (2, 4, "b")], "a int, b int, c string")
    out = {(r.a, r.b): r.c for r in reshape.product_infill(long, ["a", "b"], "z").collect()}
    assert out == {(1, 3): "b", (2, 4): "b", (1, 4): "z", (2, 3): "z"}
    with pytest.raises(ValueError, match="none of"):
        reshape.product_infill(long.drop("b"), ["a"], "z", {"a": [8, 9]}, check=True)
    cells = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 2, 7.0)], "o int, d int, v double")
    assert sorted(map(tuple, reshape.long_to_wide(cells, "o", "d", "v").collect())) == [(1, 5.0, None), (2, 0.0, 7.0)]
    assert reshape.sparse_feasible(cells, ["o", "d"]).first().feasible is False


def test_frames(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, None, 4), (2, 1, 3), (1, 2, 2)], "a int, b int, c int")
    assert sorted(r.c for r in frames.filter_rows(df, {"a": 1, "b": 2}).collect()) == [2, 3]
    assert frames.filter_rows(df, {"b": [None]}).count() == 1
    with pytest.raises(ValueError):
        frames.filter_rows(df, {"a": 5}, strict=True)
    assert {tuple(r) for r in frames.group_sum(df, ["a", "b", "c"], ["c"]).collect()} == {(1, 2, 5), (2, 1, 3)}
    nums = spark.range(1050).withColumn("k", F.col("id") % 10)
    got = frames.chunked(nums, 100, "k", ["id"]).groupBy("chunk_id").count().orderBy("chunk_id").collect()
    assert [r["count"] for r in got] == [100] * 10 + [50]
    assert [c.count() for c in frames.chunks(nums.limit(3), 2, "id")] == [2, 1]
    with pytest.raises(ValueError):
        frames.chunked(nums, 0, "id")


def test_scalars_and_sets(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), (" None ",)], "s string")
    assert [r.s for r in scalars.to_numeric(df, "s", "coerce").collect()] == [1.5, None, None, None]
    assert scalars.to_numeric(df, "s", "ignore").schema["s"].dataType.typeName() == "string"
    assert [r[0] for r in df.select(scalars.is_none_like(F.col("s"))).collect()] == [False, False, True, True]
    assert spark.range(1).select(scalars.duration(F.lit(3_723_000))).first()[0] == "1hrs 2m 3.00s"
    assert all(scalars.normalised_name(f"A {c}B") == f"a_{c}b" for c in "!#$%£&.<=>+^_~()") and scalars.normalised_name("a*b/c:d;e@f'g?[h]ü") == "abcdefgh"
    assert [scalars.normalised_name(c) for c in ("Share %", "v1.2 (km)", "Cost £", " A -  b ")] == ["share_%", "v1.2_(km)", "cost_£", "a-b"]
    assert scalars.normalised_name(" integer - NUMBER   ") == "integer-number" and scalars.normalised_name("Float    NUM (km)") == "float_num_(km)"
    maps = spark.createDataFrame([(i, m) for i, m in enumerate([{"a": 1, "b": 2, "c": 3}, {"a": 4, "b": 5, "c": 6}, {"a": 7, "b": 8, "c": 9}])], "i int, m map<string,int>")
    fold = lambda op: {r.key: r.value for r in sets.combine_maps(maps, "m", "i", op).collect()}
    assert fold(lambda a, b: a - b) == {"a": -10, "b": -11, "c": -12} and fold(lambda a, b: a * b) == {"a": 28, "b": 80, "c": 162}
    a, b = spark.range(5), spark.range(2, 7)
    assert not sets.equal_ignoring_order(a, b, "id") and sets.is_unique(a, "id")
    with pytest.raises(ValueError):
        sets.require_unique(a.union(a), "id")


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("zone_id,1,2,3\n1,0,1,2\n2,3,4,5\n3,6,7,8\n")
    (tmp_path / "c.csv").write_text("from,to,factors\n1,1,1\n2,1,1\n3,2,1\n")
    (tmp_path / "odd.csv").write_text("String WORDS,string_words\na,b\n")
    m = ingest.read_matrix(spark, str(tmp_path / "m.csv"))
    assert m.count() == 9 and m.agg(F.sum("value")).first()[0] == 36
    ingest.translate_matrix_file(spark, str(tmp_path / "m.csv"), str(tmp_path / "c.csv"), str(tmp_path / "out"))
    out = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert {(r.origin, r.destination): float(r.value) for r in out.collect()} == {("1", "1"): 8, ("1", "2"): 7, ("2", "1"): 13, ("2", "2"): 8}
    with pytest.raises(ingest.MissingColumnsError, match="x and y"):
        ingest.read_csv(spark, str(tmp_path / "c.csv"), ["x", "y"])
    with pytest.raises(ValueError, match="same plain name"):
        ingest.read_csv(spark, str(tmp_path / "odd.csv"), normalise=True)
    assert {r.column for r in ingest.bad_values(spark, str(tmp_path / "odd.csv"), {"String WORDS": "int"}).collect()} == {"String WORDS"}
    assert ingest.find_similar(tmp_path / "m.txt").name == "m.csv"
    with pytest.raises(FileNotFoundError):
        ingest.find_similar(tmp_path / "none.csv")


def test_stream(spark, tmp_path, lookup):
    cells = spark.createDataFrame([(o, d, float(o * d)) for o in range(1, 6) for d in range(1, 6)], "origin int, destination int, value double")
    cells.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_translation(stream, lookup).writeStream.outputMode("complete").format("memory").queryName("moved").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.origin, r.destination): r.value for r in translate.translate_matrix(cells, lookup).collect()}
    assert {(r.origin, r.destination): r.value for r in spark.table("moved").collect()} == want


def test_generators(spark):
    rows = generate.table_of(spark, 50, 1, {"c": generate.Choice([1, 2, 3], True), "x": generate.Float(2, 3)}).collect()
    assert {r.c for r in rows} == {1, 2, 3} and all(2 <= r.x < 3 for r in rows)
    with pytest.raises(ValueError):
        generate.table_of(spark, 2, 1, {"c": generate.Choice([1, 2, 3])})
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert generate.unique_ids(spark, "id", 3, 5).agg(F.min("id"), F.max("id")).first() == (5, 7)


def test_report_from_files_and_comparison(spark, tmp_path):
    cells = {("1", "1"): 4, ("1", "2"): 6, ("2", "1"): 1, ("3", "3"): 9}
    (tmp_path / "m.csv").write_text("origin,destination,value\n" + "\n".join(f"{o},{d},{v}" for (o, d), v in cells.items()))
    (tmp_path / "other.csv").write_text("origin,destination,value\n1,1,1\n2,2,5\n3,3,9\n")
    (tmp_path / "c.csv").write_text("from,to,factors\n1,10,1\n2,10,1\n3,20,1\n")
    a, b = (report.MatrixReport.from_file(spark, str(tmp_path / n), str(tmp_path / "c.csv")) for n in ("m.csv", "other.csv"))
    out = a.compare(b)
    stats = {r.statistic: (r.a, r.b) for r in out["stats"].collect()}
    assert stats["sum"] == (20, 15) and stats["max"] == (9, 9)
    gap = {(r.origin, r.destination): r.value for r in out["abs difference"].collect()}
    assert (gap["10", "10"], gap["20", "20"], gap["sum", "sum"]) == (3 + 6 + 1 + 5, 0, 15)
    share = {(r.origin, r.destination): r.value for r in out["abs percentage"].collect()}
    assert share["10", "10"] == 15 / 11 and share["10", "20"] is None and share["sum", "sum"] == 15 / 20
    paths = report.write_frames(a.frames(), str(tmp_path / "report"), "one")
    assert {r.origin for r in spark.read.parquet(paths[-1]).collect()} == {"10", "20", "sum"}


def test_chunks_numbers_and_items(spark):
    df = spark.range(25).withColumn("x", F.col("id") % 7)
    got = [sorted(r.id for r in c.collect()) for c in frames.chunks(df, 10, "x", ["id"])]
    want = sorted(range(25), key=lambda i: (i % 7, i))
    assert got == [sorted(want[:10]), sorted(want[10:20]), sorted(want[20:])]
    scalars.require_numbers(df, ["id", "x"])
    with pytest.raises(ValueError, match="name"):
        scalars.require_numbers(df.withColumn("name", F.lit("a")), ["id", "name"])
    one = spark.createDataFrame([([1, 2, 3, 2],)], "items array<int>")
    assert one.select(sets.without_items(F.col("items"), [2, 9])).first()[0] == [1, 3]
    with pytest.raises(Exception, match="isn't in the array"):
        one.select(sets.without_items(F.col("items"), [9], strict=True)).collect()
    cube = np.arange(8).reshape(2, 2, 2)
    rows = reshape.from_array(spark, cube, {"a": ["x", "y"], "b": [1, 2], "c": [5, 6]}, drop_zeros=True).collect()
    assert {(r.a, r.b, r.c): r.value for r in rows} == {("xy"[i], j + 1, k + 5): 4 * i + 2 * j + k for i in range(2) for j in range(2) for k in range(2) if i + j + k}
    nested = spark.createDataFrame([(1, [[0, 3], [4]])], "id int, m array<array<int>>")
    assert sorted(map(tuple, reshape.explode_array(nested, ["id"], "m", ["i", "j"], drop_zeros=True).collect())) == [(1, 0, 1, 3), (1, 1, 0, 4)]


def test_numbers_of_hot_keys(spark):
    rows = [(None if i % 10 == 0 else 7 if i % 3 else i, i * 37 % 1009) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, t int").withColumn("id", F.monotonically_increasing_id())
    got = frames.numbered(df, "k", ["t", "id"]).collect()
    want = sorted(got, key=lambda r: (r.k is not None, r.k or 0, r.t, r.id))
    assert [r.row for r in want] == list(range(3000))
    text = frames.numbered(df.withColumn("t", F.col("t").cast("string")), "k", ["t", "id"]).collect()
    assert sorted(r.row for r in text) == list(range(3000))


def test_warnings_of_losses(spark, lookup):
    m = spark.createDataFrame([(1, 2, 5.0), (9, 1, 2.0), (1, 8, 1.0)], "origin int, destination int, value double")
    with pytest.warns(UserWarning) as seen:
        translate.translate_matrix(m, lookup, check=True)
    text = " ".join(str(w.message) for w in seen)
    assert "of origin lead nowhere; 2.0" in text and "of destination lead nowhere; 1.0" in text and "was 8.0 and is 5.0" in text
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        report.MatrixReport(m.limit(0).union(spark.createDataFrame([(1, 2, 5.0)], m.schema)), lookup, check=True)


def test_infill_of_given_cells(spark):
    cells = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 2, 7.0)], "o int, d int, v double")
    wide = reshape.long_to_wide(cells, "o", "d", "v", [1, 2], rows=[1, 3])
    assert sorted(map(tuple, wide.collect())) == [(1, 5, 0), (3, 0, 0)]
    with pytest.warns(UserWarning, match="was 12.0 and is 5.0"):
        reshape.long_to_wide(cells, "o", "d", "v", [1, 2], rows=[1, 3], check_total=True)
    long = reshape.wide_to_long(wide, "o", "d", "v", rows=[1, 4], columns=[1, 2], infill=-1)
    assert {(r.o, r.d): r.v for r in long.collect()} == {(1, "1"): 5, (1, "2"): 0, (4, "1"): -1, (4, "2"): -1}
    assert reshape.array_or_coordinates(cells, ["o", "d"], "v", "feasible")[0].shape == (2, 2)
    assert reshape.array_or_coordinates(cells, ["o", "d"], "v", "force").count() == 3
    with pytest.raises(ValueError, match="no o or d"):
        reshape.array_or_coordinates(cells.union(spark.createDataFrame([(None, 1, 1.0)], cells.schema)), ["o", "d"], "v", "force")
    near = {r.statistic: r.value for r in report.describe(spark.range(1, 10_001).select(F.lit(1).alias("origin"), F.col("id").alias("destination"), F.col("id").alias("value")), accuracy=1000).collect()}
    assert abs(near["p25"] - 2500) <= 10 and near["count"] == 10_000


def test_files_without_header_and_checks(spark, tmp_path):
    (tmp_path / "bare.csv").write_text("1,1,4\n1,2,6\n2,1,1\n2,2,3\n")
    assert ingest.read_matrix(spark, str(tmp_path / "bare.txt"), similar=True).agg(F.sum("value")).first()[0] == 14
    (tmp_path / "named.csv").write_text("O,D,trips\n1,1,4\n1,2,6\n2,1,1\n2,2,3\n")
    assert ingest.read_matrix(spark, str(tmp_path / "named.csv")).agg(F.sum("value")).first()[0] == 14
    (tmp_path / "c.csv").write_text("from,to,factors\n1,10,1.5\n2,10,-1\n")
    with pytest.warns(UserWarning) as seen:
        ingest.read_correspondence(spark, str(tmp_path / "c.csv"), check=True)
    said = [str(w.message) for w in seen if w.category is UserWarning]
    assert len(said) == 2 and "over 1" in said[0] and "under 0" in said[1]
    with pytest.raises(ValueError, match="plain form"):
        ingest.read_csv(spark, str(tmp_path / "named.csv"), ["Trips"], normalise=True)
    with pytest.raises(FileNotFoundError):
        ingest.require_file(tmp_path / "none.csv")
    with pytest.raises(Exception, match="not negative"):
        spark.range(1).select(scalars.duration(F.lit(-5))).collect()
    assert spark.range(1).select(scalars.clock("yyyy", F.lit("2024-05-06").cast("timestamp")), scalars.milliseconds(F.lit("1970-01-02").cast("timestamp"))).first() == ("2024", 86_400_000)


def test_given_tables_and_extra_columns(spark, lookup, tmp_path):
    v = spark.createDataFrame([(1, 4.0), (2, 2.0)], "zone int, v double")
    want = sorted(map(tuple, translate.translate_vector(v, lookup, "zone", ["v"]).collect()))
    with pytest.warns(DeprecationWarning):
        assert sorted(map(tuple, translate.translate_vector(v, lookup.table, "zone", ["v"]).collect())) == want
    with pytest.warns(DeprecationWarning):
        assert Correspondence.accepted(lookup.table.toDF("a", "b", "c")).target == "b"
    (tmp_path / "c.csv").write_text("a,b,c\n" + "".join(f"{i},{j},{f}\n" for (i, j), f in FACTORS.items()))
    with pytest.warns(DeprecationWarning):
        assert sorted(map(tuple, translate.translate_vector(v, str(tmp_path / "c.csv"), "zone", ["v"]).collect())) == want
    m = spark.createDataFrame([(1, 2, 4.0, "x", 1)], "origin int, destination int, value double, note string, n int")
    with pytest.warns(UserWarning, match="left out: note, n"):
        assert translate.translate_matrix(m, lookup).columns == ["origin", "destination", "value"]


def test_files_by_name_and_distributions(spark, tmp_path):
    for n in ("m.csv.gz", "m.csv", "m.txt", "other.csv"):
        (tmp_path / n).write_text("")
    with pytest.warns(UserWarning, match="3 files are called m"):
        assert ingest.find_named(tmp_path, "m", [".zip", ".csv", ".csv.gz"]).name == "m.csv"
    assert ingest.find_named(tmp_path, "other", [".csv"]).name == "other.csv"
    with pytest.raises(FileNotFoundError):
        ingest.find_named(tmp_path, "none", [".csv"])
    (tmp_path / "d.csv").write_text("lo,max,avg,trips,weighted_avg\n5,10,7.5,3,8\n0,5,2.5,1,2\n")
    d = distribution.Distribution.read(spark, str(tmp_path / "d.csv"), min="lo")
    assert d.edges == [0, 5, 10] and d.values("trips") == [1, 3] and d.shares == [0.25, 0.75]
    other = d.with_trips([2, 2])
    assert other.values("trips") == [2, 2] and other.values("weighted_avg") == [2, 8] and d.values("trips") == [1, 3]
    assert [r.trips_residual for r in d.residuals(other).orderBy("bin").collect()] in ([-1, 1], [1, -1])
    with pytest.raises(ValueError, match="2 bins and 1"):
        d.with_trips([1])
    cells = spark.createDataFrame([(float(i % 3), float(i)) for i in range(100)], "trips double, cost double")
    own = distribution.Distribution.dynamic(cells, final=300)
    assert own.edges == distribution.log_edges(99, final=300) and sum(own.values("trips")) == 99


def test_items_that_one_side_lacks(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 2, 3], [3, 4]))
    left, right = sets.missing_items(a, b, "k")
    assert sorted(r.item for r in left.collect()) == [1, 2] and [r.item for r in right.collect()] == [4]
    with pytest.raises(ValueError, match="several times"):
        sets.missing_items(a.union(a), b, "k")


def test_comparison_written_at_once(spark, lookup, tmp_path):
    a, b = (report.MatrixReport(spark.createDataFrame([(i, j, float(i * j + k)) for i in range(1, 5) for j in range(1, 5)], "origin int, destination int, value double"), lookup) for k in (0, 1))
    paths = report.compare_and_write(a, b, str(tmp_path), ("one", "two"))
    assert {"one matrix", "two matrix", "cells", "stats", "Trip Ends"} <= set(paths)
    assert spark.read.parquet(paths["cells"]).filter("difference <> 0").count() > 0
