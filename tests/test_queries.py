"""Each query against its SQL, as the driver compares them."""

import duckdb
import pytest

import __spark_entry__ as entry
from odweave.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([tuple(r[i] for i in order) for r in data]), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b) and len(a) > 0
    for x, y in zip(a, b, strict=True):
        assert [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in x] == [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in y]


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_generated(spark):
    rows_ = catalogue.QUERIES["generated_values"](spark, SF).collect()
    assert len(rows_) == 1000 and {r.choice for r in rows_} == {"a", "b", "c"}
    assert all(0 <= r.x < 5 and 3 <= r.k < 9 for r in rows_)
