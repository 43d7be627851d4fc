"""The queries that SQL can express against their SQL, and every query's columns."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from odweave.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr)
    b = sorted(want.project(", ".join(order)).fetchall(), key=repr)
    assert len(a) > 0 and a == b


def test_tokens_of_registered_queries(spark):
    """Pieces of op6 and counts of op8 by the tokenizer itself."""
    d = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op8_token_counts(spark, d).collect()} == {i: len(x) for i, x in ids.items()}
    fill, seen = {}, {i: [] for i in ids}
    for p in sorted(queries.op6_packing(spark, d).collect(), key=lambda p: (p.sequence_id, p.offset)):
        whole = [*ids[p.doc_id], 2]
        assert p.offset == fill.get(p.sequence_id, 0) and p.doc_tokens == len(whole)
        assert p.ids_crc32 == zlib.crc32(np.array(whole[p.start : p.start + p.length], "<u4").tobytes())
        fill[p.sequence_id] = p.offset + p.length
        seen[p.doc_id] += range(p.start, p.start + p.length)
    assert all(sorted(x) == list(range(len(ids[i]) + 1)) for i, x in seen.items()) and max(fill.values()) <= 4096
