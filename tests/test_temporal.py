"""As-of joins, interval joins and sessions against plain Python, with hot keys, ties, nulls and empty sides."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from odweave.operators import temporal
from odweave.streaming.sessions import append_files, stream_sessions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [1, 7, 128])
def test_asof_join(spark, ranges):
    r = random.Random(3)
    key = lambda: r.choice(["hot"] * 5 + ["a", "b", None])
    left = [(i, key(), r.choice([None, *range(60)] * 3 + [30] * 40)) for i in range(200)]
    right = [(100 + i, key(), r.choice([None, *range(0, 60, 3)])) for i in range(90)] + [(900, "late", 80)]
    a, b = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "rid int, k string, rt int")
    for tolerance in (None, 4):
        got = {x.id: (x.rid, x.rt) for x in temporal.asof_join(a, b, "t", "rt", ["k"], ties=["rid"], tolerance=tolerance, ranges=ranges).collect()}
        for i, k, t in left:
            fits = [(rt, rid) for rid, rk, rt in right if None not in (k, t, rt) and rk == k and rt <= t]
            best = max(fits, default=(None, None))
            if tolerance is not None and best[0] is not None and t - best[0] > tolerance:
                best = (None, None)
            assert got[i] == (best[1], best[0]), (i, k, t)
        assert len(got) == len(left)
    assert temporal.asof_join(a.limit(0), b, "t", "rt", ["k"]).count() == 0
    assert {x.rid for x in temporal.asof_join(a, b.limit(0), "t", "rt", ["k"]).collect()} == {None}
    with pytest.raises(ValueError, match="both sides"):
        temporal.asof_join(a, b.withColumnRenamed("rid", "id"), "t", "rt", ["k"])


def test_asof_without_keys_and_with_dates(spark):
    a = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-05'), (2, DATE'2023-01-01') AS t(id, d)")
    b = spark.sql("SELECT * FROM VALUES ('x', DATE'2024-01-01'), ('y', DATE'2024-01-04') AS t(name, rd)")
    assert {r.id: r.name for r in temporal.asof_join(a, b, "d", "rd").collect()} == {1: "y", 2: None}


@pytest.mark.parametrize("seed", range(3))
def test_interval_join(spark, seed):
    r = random.Random(seed)

    def some(n, first):
        out = [(first + i, r.choice(["hot", "hot", "x", None]), s := r.randrange(-500, 500), s + r.choice([0, 1, 2, 3, 7, 8, 60, 900])) for i in range(n)]
        return [*out, (first + n, "hot", 5, 4), (first + n + 1, "hot", None, 4), (first + n + 2, "hot", -(10**12), 10**12), (first + n + 3, "hot", 7, 7), (first + n + 3, "hot", 7, 7)]

    x, y = some(60, 0), some(50, 1000)
    a, b = spark.createDataFrame(x, "a int, k string, s long, e long"), spark.createDataFrame(y, "b int, k string, p long, q long")
    joined = temporal.interval_join(a, b, ("s", "e"), ("p", "q"), ["k"])
    want = [(i, j) for i, k, s, e in x for j, m, p, q in y if k is not None and k == m and None not in (s, p) and s <= e and p <= q and s <= q and p <= e]
    assert sorted((r.a, r.b) for r in joined.collect()) == sorted(want)
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)
    whole = temporal.interval_join(a.drop("k"), b.drop("k"), ("s", "e"), ("p", "q"))
    want = [(i, j) for i, _, s, e in x for j, _, p, q in y if None not in (s, p) and s <= e and p <= q and s <= q and p <= e]
    assert sorted((r.a, r.b) for r in whole.collect()) == sorted(want)
    assert temporal.interval_join(a.limit(0), b, ("s", "e"), ("p", "q"), ["k"]).count() == 0


def split(rows, gap):
    """{id: session} by walking each key's rows in order."""
    out, last = {}, {}
    for i, k, t in sorted((r for r in rows if None not in r[1:]), key=lambda r: r[2]):
        n, at = last.get(k, (0, None))
        if at is None or t - at > gap:
            n += 1
        last[k] = (n, t)
        out[i] = n
    return out


@pytest.mark.parametrize("ranges", [1, 16, 128])
def test_sessions(spark, ranges):
    r = random.Random(ranges)
    rows = [(i, r.choice(["hot"] * 6 + ["a", None]), r.choice([None, *range(0, 3000)])) for i in range(400)] + [(1000 + i, "tied", 50) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, k string, t int")
    got = {x.id: x.session for x in temporal.sessions(df, ["k"], "t", 10, ranges).collect()}
    assert got == split(rows, 10)
    assert temporal.sessions(df.limit(0), ["k"], "t", 10).count() == 0


START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_stream_restarts_and_leaves_late_rows_out(spark, tmp_path):
    """The sink has what the watermark has closed, before and after a restart; an hour late is late."""
    schema = "user long, ts timestamp, v int"
    files = [
        [(1, at(0), 1), (1, at(20), 2), (2, at(5), 4), (None, at(3), 9)],
        [(1, at(35), 8), (2, at(100), 16), (1, at(170), 32), (3, None, 9)],
        [(2, at(10), 64), (1, at(400), 128)],  # the first comes too late
    ]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    seen = []
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = stream_sessions(spark.readStream.schema(schema).parquet(source), ["user"], "ts", "30 minutes", "1 hour", {"total": F.sum("v")})
        append_files(stream, out, checkpoint).awaitTermination()
        got = spark.read.schema(stream.schema).parquet(out).collect()
        seen.append(sorted((r.user, (r.start - START).seconds // 60, (r.end - START).seconds // 60, r.total) for r in got))
    assert seen == [[], [(1, 0, 35, 11), (2, 5, 5, 4)], [(1, 0, 35, 11), (1, 170, 170, 32), (2, 5, 5, 4), (2, 100, 100, 16)]]
    batch = stream_sessions(spark.createDataFrame(files[0] + files[1], schema), ["user"], "ts", "30 minutes", "1 hour", {"total": F.sum("v")})
    own = temporal.sessions(spark.createDataFrame(files[0] + files[1], schema), ["user"], "ts", 30 * 60 * 10**6).groupBy("user", "session").agg(F.sum("v").alias("total"))
    assert sorted(r.total for r in batch.collect()) == sorted(r.total for r in own.collect()) == [4, 11, 16, 32]
