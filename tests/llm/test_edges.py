"""Columns that clash with those of an operator, and very long texts, for operators whose own tests have none."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odweave.llm import byte_bpe, embedding_dedup, jaccard, packing, token_counts, warc
from odweave.llm.bpe import byte_bpe as ranks_bpe
from odweave.llm.bpe import vocabulary

RANKS, PATTERN = vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN
WORDS = vocabulary(public_tokenizers.path("word_bpe_49k.json"))
LONG = " ".join(f"w{i * i}" for i in range(45_000))  # over 400,000 bytes
TEXTS = ["some words that stand here twice", "some words that stand here twice", "", None, "é 日本 " * 50, LONG]


def encoded(docs):
    return byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)


OPERATORS = {
    "op4": (encoded, ["n_tokens", "ids", "decoded", "block", "bucket", "id"]),
    "op6": (lambda docs: packing.pack_documents(docs, WORDS), ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]),
    "op8": (lambda docs: token_counts.documents_counted(docs, WORDS), ["n_tokens", "file", "size", "ids", "ordinal"]),
    "op9": (jaccard.link, ["n_shingles", "component_id", "set_key", "n", "id", "block"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(documents, name):
    operator, clash = OPERATORS[name]
    docs = documents(list(enumerate(TEXTS))).repartition(2)
    with_clash = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    a, b = operator(docs), operator(with_clash)
    assert a.columns == b.columns and len(set(b.columns)) == len(b.columns)
    keep = [c for c in a.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(str, a.select(keep).collect())) == sorted(map(str, b.select(keep).collect()))


def test_decoding_replaces_a_column_of_its_name(documents):
    once = encoded(documents([(1, "again")]))
    twice = byte_bpe.decode(once.withColumn("decoded", F.lit("old")), RANKS, PATTERN)
    assert twice.columns == once.columns and bytes(twice.first().decoded) == b"again"


def test_clashing_columns_of_vectors_and_pages(spark):
    rows = [(i, [1.0, 0.01 * i], 5) for i in range(4)] + [(9, [-1.0, 3.0], 5), (10, None, 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    clash = vectors.select("*", *[F.lit(7).alias(c) for c in ("n_links", "component_id", "kept", "key", "rep", "n", "id", "vector")])
    assert sorted(map(str, embedding_dedup.near_duplicates(vectors).collect())) == sorted(map(str, embedding_dedup.near_duplicates(clash).collect()))
    pages = spark.createDataFrame([(1, "http://a", LONG), (2, "http://b", LONG), (3, None, None), (4, "http://c", "")], "page_id long, url string, html string")
    clash = pages.select("*", *[F.lit(7).alias(c) for c in ("payload_bytes", "payload_digest", "record_type", "refers_to", "file", "start", "offset", "digest", "_main")])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = [sorted(map(str, warc.archive_round_trip(p).select(columns).collect())) for p in (pages, clash)]
    assert got[0] == got[1] and any(f"payload_bytes={len(LONG)}" in r for r in got[0])


def test_long_texts(documents):
    docs = documents([(1, LONG), (2, "word " * 100_000), (3, "x" * 300_000)])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts.documents_counted(docs, WORDS).collect()} == {i: len(x) for i, x in ids.items()}
    pieces = packing.pack_documents(docs, WORDS).collect()
    for p in pieces:
        part = [*ids[p.doc_id], 2][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in ids.values())
    own = ranks_bpe(RANKS, PATTERN).library
    for r in encoded(docs).collect():
        want = np.array(own.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert hashlib.sha256(r.ids).digest() == hashlib.sha256(want).digest() and bytes(r.decoded).decode() == texts[r.doc_id]
    assert {r.doc_id: r.n_shingles for r in jaccard.link(docs).collect()} == {1: 44_996, 2: 1, 3: 1}
