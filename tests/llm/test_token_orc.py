"""Token ids in ORC files against the tokenizers library, and what their indexes let a reader skip."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from odweave.llm import queries, token_orc
from odweave.llm.bpe import LevelBpe, level_bpe, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_ids_are_the_library_s():
    bpe = level_bpe(vocabulary(PATH))
    assert bpe.fast
    odd = ["", " ", "  a  b ", "a\n\nb \n c\t\r\n", "it's we'll 'S", "x<|endoftext|>y", "日本語 テスト", "été Ωmega жук", "\x1c\x1f a\x85b\xa0c d", "😀 á", "١٢٣ ½ ²", "a" * 5000]
    assert [x.tolist() for x in bpe.encode(odd)] == [ids(t) for t in odd]


def test_plain_characters_are_split_alike():
    """Every character of PLAIN, between letters, digits, signs and spaces."""
    import regex

    plain = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and regex.match(f"[{LevelBpe.PLAIN}]", c)]
    assert len(plain) > 30_000
    text = [" ".join(f"a{c}b 1{c}2 .{c}. {c}{c}" for c in plain[i : i + 500]) for i in range(0, len(plain), 500)]
    for t, got in zip(text, level_bpe(vocabulary(PATH)).encode(text), strict=True):
        assert got.tolist() == ids(t)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdéЖ日1.,—"), st.characters(exclude_categories=["Cs"]))))
def test_any_text(text):
    assert level_bpe(vocabulary(PATH)).encode([text])[0].tolist() == ids(text)


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_joined_crc(a, b):
    assert token_orc.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("rows", [400, 3])
def test_round_trip(spark, rows, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    monkeypatch.setattr(token_orc, "PIECE", 7)
    texts = ["a few plain words", "", None, "x <|endoftext|> y", "long text " * 40_000, "größe 日本 x", "a few plain words"]
    made = [*((10 - i, t) for i, t in enumerate(texts)), (None, "no id"), (None, None), (3, "again"), *((50, f"same id {i % 3}") for i in range(40))]
    docs = spark.createDataFrame([(i, t, 1, 2, [3], "x") for i, t in made], "doc_id long, text string, row int, piece int, ids array<int>, _tie string")
    got = [tuple(r) for r in token_orc.round_trip(docs.repartition(3), vocabulary(PATH)).collect()]
    want = [(i, [*ids(t), 0]) for i, t in made]
    assert sorted((i, n, c) for i, _, n, c in got if i is not None) == sorted((i, len(x), crc(x)) for i, x in want if i is not None)
    at = 0
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    in_order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert in_order[:2] == [None, None] and in_order[2:] == sorted(in_order[2:]) and at == sum(len(x) for _, x in want)
    assert token_orc.round_trip(docs.limit(0), vocabulary(PATH)).collect() == []


def metric(df, name):
    """The sum of a metric of the scan that ran."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().apply(name).value() for i in range(leaves.size()))


def test_readers_skip_by_id(spark, documents, tmp_path):
    docs = documents([(i, f"text {i} of many " * 20) for i in range(0, 6000, 2)])
    token_orc.write_tokens(docs.coalesce(1), vocabulary(PATH), f"file://{tmp_path}/orc", **{"orc.stripe.size": "65536"})
    some = token_orc.read_tokens(spark, f"file://{tmp_path}/orc").filter("doc_id = 4002")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4002)]" in some._jdf.queryExecution().executedPlan().toString()
    assert [r.ids for r in some.collect()] == [[*ids("text 4002 of many " * 20), 0]]
    assert metric(some, "numOutputRows") < 3000
    none = token_orc.read_tokens(spark, f"file://{tmp_path}/orc").filter("doc_id = 4001")
    assert none.collect() == [] and metric(none, "numOutputRows") == 0  # only the Bloom filters tell that


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    want, at = [], 0
    for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        own = [*ids(r.text), 0]
        want.append((r.doc_id, at, len(own), crc(own)))
        at += len(own)
    assert sorted(map(tuple, queries.op12_token_orc(spark, d).collect())) == want
