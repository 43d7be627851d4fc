"""Sorted and bucketed tables, chunks, blocks and chunked arrays, archives, and observed checks."""

import bz2
import gzip
import io
import lzma
import tarfile
import warnings
import zipfile

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from odweave.functions.collections import combine_maps
from odweave.operators import blocks, sketches, translate
from odweave.operators.correspondence import Correspondence
from odweave.plans import catalogue
from odweave.sources import archives, ingest, shared, storage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that the scans of a collected query gave out."""
    top = df._jdf.queryExecution().executedPlan()
    leaves = (top.executedPlan() if top.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else top).collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def executions(spark):
    spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_sorted_files_are_read_by_their_footers(spark, tmp_path):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("k"), F.lit("x" * 20).alias("text"))
    path = str(tmp_path / "sorted")
    storage.write_sorted(df, path, ["k"], files=4, row_group=1 << 16)
    some = spark.read.parquet(path).filter("k BETWEEN 5000 AND 5010")
    assert sorted(r.k for r in some.collect()) == list(range(5000, 5011)) and scanned(some) < 60_000
    keys = [r.k for r in storage.ordered_rows(spark, path, df.schema)]
    assert keys == list(range(200_000))


def test_sorted_csv(spark, tmp_path):
    rows = [(3, 1, 2.0), (1, 2, 1.5), (1, 1, 0.5), (2, 9, 4.0)]
    ingest.write_csv(spark.createDataFrame(rows, "origin int, destination int, value double"), str(tmp_path / "m"), order=["origin", "destination"])
    text = "".join(p.read_text().partition("\n")[2] for p in sorted((tmp_path / "m").glob("part-*")))
    assert text.split() == ["1,1,0.5", "1,2,1.5", "2,9,4.0", "3,1,2.0"]


def test_bucketed_tables_join_without_an_exchange(spark):
    a, b = spark.range(1000).withColumn("x", F.col("id") % 7), spark.range(0, 1000, 3).withColumn("y", F.col("id") * 2)
    try:
        left, right = storage.write_bucketed(a, "bucketed_a", ["id"], 4), storage.write_bucketed(b, "bucketed_b", ["id"], 4)
        joined = left.hint("merge").join(right, "id")
        assert joined.count() == 334 and "Exchange" not in plan(joined).replace("BroadcastExchange", "Exchange")
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_a")
        spark.sql("DROP TABLE IF EXISTS bucketed_b")


def test_chunks_read_the_table_once(spark, tmp_path):
    spark.range(1050).select(F.col("id").alias("k"), F.lit("é").alias("t")).write.parquet(str(tmp_path / "t"))
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    df = spark.read.parquet(str(tmp_path / "t")).mapInArrow(seen, "k long, t string")
    with storage.Chunks(df, 100, "k") as all_:
        once = calls.value  # numbering takes a few passes; reading chunks takes none
        assert len(all_) == 11 and [c.count() for c in all_] == [100] * 10 + [50]
        assert sorted(r.k for r in all_[3].collect()) == list(range(300, 400)) and all_[0].columns == ["k", "t"]
        assert calls.value == once and "PartitionFilters: [isnotnull(chunk_id" in plan(all_[3])
        with pytest.raises(IndexError):
            all_[11]
    with storage.Chunks(df.limit(0), 5, "k") as none:
        assert list(none) == []


def jobs(spark, group, run):
    """The result of run, and how many jobs it started."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_chunks_take_no_job_or_folder_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "FOLDER_ROWS", 1000)
    df = spark.range(4005).select((F.col("id") * 7919 % 4005).alias("k"))
    with storage.Chunks(df, 10, "k") as all_:
        files = spark.read.parquet(all_.folder).inputFiles()
        assert len(all_) == 401 and len(files) == 5
        assert [sorted(r.k for r in all_[i].collect()) for i in (0, 99, 100, 400)] == [list(range(a, min(a + 10, 4005))) for a in (0, 990, 1000, 4000)]
        assert len(all_[250].inputFiles()) == 1
        ends = all_.each(lambda t: t.slice(0, 1).append_column("n", [[len(t)]]), "k long, n long").collect()
        assert len(ends) == 401 and sorted({(r.k // 10, r.n) for r in ends}) == [(i, 10) for i in range(400)] + [(400, 5)]
    with storage.Chunks(df, 3000, "k") as all_:
        assert all_.shared == 1 and [c.count() for c in all_] == [3000, 1005]
    seen = []
    for name, n in (("few", 1200), ("many", 12_000), ("none", 0)):
        spark.range(n).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / name / "customer.parquet"))
        got, made = jobs(spark, f"chunks-{name}", lambda name=name: catalogue.QUERIES["chunks_counted"](spark, str(tmp_path / name)).collect())
        assert sorted(tuple(r) for r in got) == [(i, 400) for i in range(n)]
        seen.append(made)
    assert seen[1] <= seen[0] + 2  # a few more for more ranges, but none for each chunk


@pytest.mark.parametrize(("n", "m", "side"), [(25, 25, 8), (10, 3, 256), (7, 20, 5)])
def test_blocks(spark, n, m, side):
    r = np.random.default_rng(n)
    x, y = r.integers(-3, 4, (n, m)) * (r.random((n, m)) < 0.4), r.integers(0, 4, (m, n)).astype(float)
    cells = lambda a: spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i int, j int, value double")

    def dense(b):
        out = np.zeros(b.shape)
        for c in b.cells().collect():
            out[c.i, c.j] = c.value
        return out

    a, b = blocks.Blocks.of(cells(x), (n, m), side=side), blocks.Blocks.of(cells(y), (m, n), side=side)
    assert (dense(a) == x).all() and (dense(a.T) == x.T).all()
    assert (dense(a @ b) == x @ y).all() and (a @ b).shape == (n, n)
    assert (dense(blocks.translate_blocks(a @ b, a)) == x.T @ (x @ y) @ x).all()
    assert (dense(blocks.translate_vector_blocks(blocks.Blocks.of(cells(x[:, :1]), (n, 1), side=side), a)) == x[:, :1].T @ x).all()


def test_blocks_check_shapes(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (4, 4, None), (1, 1, float("nan"))], "i int, j int, value double")
    a = blocks.Blocks.of(df, (5, 5), side=2)
    assert [tuple(r) for r in a.cells().collect()] == [(0, 1, 5.0)]
    with pytest.raises(Exception, match="column 1 is outside of 0 to 0"):
        blocks.Blocks.of(df.limit(1), (5, 1)).cells().collect()
    flat = blocks.Blocks.of(df, (5, 6), side=2)
    for wrong in (lambda: flat @ flat, lambda: blocks.translate_blocks(flat, a), lambda: blocks.translate_blocks(a, flat.T), lambda: blocks.translate_vector_blocks(a, a), lambda: a @ blocks.Blocks.of(df, (5, 5), side=4)):
        with pytest.raises(ValueError):
            wrong()


@pytest.mark.parametrize("fill", [0.0, float("nan")])
def test_chunked_arrays(spark, fill):
    r = np.random.default_rng(2)
    array = np.where(r.random((7, 10, 4)) < 0.5, r.random((7, 10, 4)), fill)
    there = ~np.isnan(array) if np.isnan(fill) else array != fill
    rows = [(*map(int, p), float(array[p])) for p in zip(*np.nonzero(there), strict=True)]
    df = spark.createDataFrame(rows, "a int, b int, c int, v double")
    chunks = blocks.ArrayChunks.of(df, ["a", "b", "c"], "v", array.shape, (3, 4, 9), fill)
    assert sorted(map(tuple, chunks.cells(["a", "b", "c"], "v").collect())) == sorted(rows)
    assert {(x.c0, x.c1): len(x.data) // 8 for x in chunks.table.collect()} == {(i, j): min(3, 7 - 3 * i) * min(4, 10 - 4 * j) * 4 for i in range(3) for j in range(3)}
    part = {(x.a, x.b, x.c): x.v for x in chunks.section([(6, 7), (0, 3), (0, 4)]).cells(["a", "b", "c"], "v", filled=True).collect()}
    assert len(part) == 16 and all(np.array_equal(v, array[p], equal_nan=True) for p, v in part.items())
    with pytest.raises(Exception, match="several rows"):
        blocks.ArrayChunks.of(df.union(df.limit(1)), ["a", "b", "c"], "v", array.shape, (3, 4, 9)).table.collect()
    with pytest.raises(Exception, match="a 6 is outside"):
        blocks.ArrayChunks.of(df, ["a", "b", "c"], "v", (6, 10, 4), (3, 4, 9)).table.collect()


def test_arrays_over_keys_of_any_size(spark, monkeypatch):
    from odweave.operators import reshape

    monkeypatch.setattr(reshape, "DENSE_CELLS", 10)
    rows = [("b", 30, 1.5), ("a", 10, 2.0), ("c", 20, 3.0), ("c", 30, 0.0), (None, 10, 9.0)]
    df = spark.createDataFrame(rows, "k string, n int, v double")
    with pytest.raises(ValueError, match="chunks_of_keys"):
        reshape.to_array(df.union(spark.createDataFrame([("d", 40, 1.0)], df.schema)), ["k", "n"], "v")
    chunks, places = blocks.chunks_of_keys(df, ["k", "n"], "v", (2, 2))
    assert chunks.shape == (3, 3) and sorted(map(tuple, blocks.keys_of_chunks(chunks, places, "v").collect())) == sorted(rows[:4])
    chunks, places = blocks.chunks_of_keys(df, ["k", "n"], "v", (5, 5), {"k": ["c", "x"]}, fill=0.0)
    assert chunks.shape == (2, 3) and [tuple(r) for r in blocks.keys_of_chunks(chunks, places, "v").collect()] == [("c", 20, 3.0)]


CSV = 'id,name,x\n1,"a, b",0.5\n2,"two\nlines",n/a\nbad line\n,,\n3,é,7\n'


def written(folder):
    """The same file in every form."""
    data = CSV.encode()
    for suffix, pack in ((".gz", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress), (".zst", zstandard.compress), (".csv", bytes)):
        (folder / f"one{suffix}").write_bytes(pack(data))
    with zipfile.ZipFile(folder / "two.zip", "w") as z:
        z.writestr("d/a.csv", data)
        z.writestr("b.csv", "x,id,more\n8,9,1\n")
        z.writestr("empty.csv", "")
    for mode in ("", "gz", "xz", "bz2"):
        with tarfile.open(folder / f"three.tar{mode and '.' + mode}", f"w:{mode}") as t:
            info = tarfile.TarInfo("m.csv")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_members_of_all_forms(spark, tmp_path):
    written(tmp_path)
    for p in sorted(tmp_path.glob("*")):
        got = archives.typed(archives.read_members(spark, str(p)), {"id": "bigint", "x": "double"})
        rows = sorted(((r.id, r.name, r.x, [tuple(c) for c in r.rejected], r.rejected_line) for r in got.collect()), key=str)
        want = [(1, "a, b", 0.5, [], None), (2, "two\nlines", None, [("x", "n/a")], None), (3, "é", 7.0, [], None), (None, None, None, [], None), (None, None, None, [], "bad line")]
        assert rows == sorted(want + ([(9, None, 8.0, [], None)] if p.suffix == ".zip" else []), key=str), p
        assert sorted(map(tuple, archives.rejects(got).collect()), key=str) == [("x", 1), (None, 1)] or p.suffix == ".zip"
        with pytest.raises(ValueError, match=r"1 in a line's length, 1 in x"):
            archives.require_types(got, p.name)
    raw = archives.read_members(spark, str(tmp_path / "two.zip"))
    assert raw.rdd.getNumPartitions() == 3 and {r.member for r in raw.collect()} == {"two.zip/d/a.csv", "two.zip/b.csv"}


def test_small_members_share_tasks(spark, tmp_path, monkeypatch):
    members = [(f"{'long' * 40 if i % 50 == 0 else 'd'}/{i}.csv", f"id,x\n{i},{i}.5\n{'odd' if i % 100 == 7 else f'{i},'}\n") for i in range(600)]
    members[3:5] = [("d/3.csv", ""), ("d/4.csv", "id,x\n")]
    members[5] = ("d/5.csv", "id,x\n" + "5,5.5\n" * 168 + "5,5.25\n5,5\n")  # two blocks of a tar
    members[6] = ("d/7.csv", members[6][1])  # a name that stands twice
    assert len(members[5][1]) == 1024
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.mkdir("d")
        for name, text in members:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                z.writestr(name, text)
    for suffix in (".tar", ".tar.xz", ".tar.gz"):
        with tarfile.open(tmp_path / f"m{suffix}", f"w:{suffix[5:]}") as t:
            folder = tarfile.TarInfo("d")
            folder.type = tarfile.DIRTYPE
            t.addfile(folder)
            for name, text in members:
                info = tarfile.TarInfo(name)
                info.size = len(text)
                t.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "called.tar").write_bytes((tmp_path / "m.tar.gz").read_bytes())
    for name, tasks in (("m.zip", 9), ("m.tar", 128), ("m.tar.xz", 1), ("m.tar.gz", 1), ("called.tar", 1)):
        want = []
        for member, text in members:
            for line in text.splitlines()[1:]:
                cells = [c or None for c in line.split(",")]
                want.append((*cells, f"{name}/{member}", None) if len(cells) == 2 else (None, None, f"{name}/{member}", line))
        got = archives.read_members(spark, str(tmp_path / name))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 1300
        assert got.rdd.getNumPartitions() <= tasks < 600, name
    monkeypatch.setattr(archives, "PART", 1)
    assert archives.read_members(spark, str(tmp_path / "m.tar")).rdd.getNumPartitions() == 600


def test_read_csv_names_the_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,x\n1,0.5\n2,n/a\n")
    with pytest.raises(Exception, match=r"column 'x' of trips has a value that is no double: n/a"):
        ingest.read_csv(spark, str(tmp_path / "t.csv"), types={"x": "double"}, name="trips").collect()
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("m.csv", "o,d,v\n1,1,2.5\n1,2,3\n2,1,0\n2,2,1\n")
    assert [f.dataType.simpleString() for f in ingest.read_csv(spark, str(tmp_path / "m.zip")).schema] == ["bigint", "bigint", "double"]
    assert {(r.origin, r.destination): r.value for r in ingest.read_matrix(spark, str(tmp_path / "m.csv"), similar=True).collect()} == {(1, 1): 2.5, (1, 2): 3, (2, 1): 0, (2, 2): 1}
    (tmp_path / "x.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="zip"):
        ingest.read_csv(spark, str(tmp_path / "x.zip"))


def test_observed_losses(spark):
    lookup = Correspondence(spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.5), (2, 7, 1.0), (4, 9, 0.25)], "from int, to int, factors double"))
    m = spark.createDataFrame([(i, j, float(i + j)) for i in range(1, 5) for j in range(1, 5)], "origin int, destination int, value double")
    before = executions(spark)
    with pytest.warns(UserWarning) as told:
        translate.translate_matrix(m, lookup, check=True)
    assert executions(spark) - before == 1
    said = [str(w.message) for w in told]
    assert said[0] == "1 values of origin lead nowhere; 22.0 of value is left out" and "1 values of destination lead nowhere" in said[1]
    assert said[2].startswith("the total of value was 80.0 and is")
    losses = translate.Losses()
    before = executions(spark)
    rows = translate.translate_vector(m, lookup, "origin", ["value"], check=losses).collect()
    assert executions(spark) - before == 1 and len(rows) == 3
    with pytest.warns(UserWarning, match="1 values of origin lead nowhere; 22.0 of value"):
        losses.warn()
    assert executions(spark) - before == 1
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        translate.translate_vector(m.filter("origin < 3"), lookup, "origin", ["value"], check=True)


def test_sketches_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 5).alias("zone"), (F.col("id") % 3).alias("year"), (F.col("id") % 20_000).alias("item"))
    by_year = sketches.distinct_sketches(df, ["zone", "year"], "item")
    for r in sketches.merged(by_year, ["zone"]).select("zone", sketches.estimate().alias("n")).collect():
        assert abs(r.n - 4000) <= 4000 * sketches.error_bound()
    lookup = Correspondence(spark.createDataFrame([(0, 1, 1.0), (1, 1, 0.5), (1, 2, 0.5), (2, 2, 0.0)], "from int, to int, factors double"))
    got = {r.to: r.n for r in sketches.translated(by_year, lookup, "zone").select("to", sketches.estimate().alias("n")).collect()}
    assert set(got) == {1, 2} and abs(got[1] - 8000) <= 8000 * sketches.error_bound() and abs(got[2] - 4000) <= 4000 * sketches.error_bound()
    assert 0 < sketches.error_bound() < 0.03


def test_folds_hold_one_value(spark):
    """A hot key with all rows is folded in order, and no list of its values is made."""
    df = spark.range(50_000).select("id", F.create_map(F.lit("k"), F.col("id").cast("double")).alias("m"))
    folded = combine_maps(df, "m", "id", lambda a, b: 0.5 * a + b)
    want = 0.0
    for i in range(1, 50_000):
        want = 0.5 * want + i
    assert [tuple(r) for r in folded.collect()] == [("k", want)] and "collect_list" not in plan(folded)
    odd = spark.createDataFrame([(1, {"a": 2.0}), (2, {"a": 3.0, "b": 4.0}), (3, {}), (4, None), (5, {"b": None})], "o int, m map<string, double>")
    assert {r.key: r.value for r in combine_maps(odd, "m", "o", lambda a, b: a - b).collect()} == {"a": -1.0, "b": None}
    assert combine_maps(odd.limit(0), "m", "o", lambda a, b: a - b).count() == 0


def test_shared_folder(spark):
    folder = shared.shared_folder(spark, "x")
    spark.range(3).write.parquet(folder)
    assert ":" in folder and spark.read.parquet(folder).count() == 3
    shared.remove_folder(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
