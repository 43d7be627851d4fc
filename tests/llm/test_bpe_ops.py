"""Byte-level BPE and packing against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from odweave.llm import byte_bpe, packing
from odweave.llm.bpe import ByteBpe, WordBpe, vocabulary
from odweave.llm.common import written

RANKS = vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
WORDS = vocabulary(public_tokenizers.path("word_bpe_49k.json"))
PATTERN = public_tokenizers.PATTERN

ODD = [
    (1, None),
    (2, ""),
    (3, "the the the\n\n  cat's 1234 été 日本語 \x1c\x1d x\u0085y  z"),
    (3, "the the the\n\n  cat's 1234 été 日本語 \x1c\x1d x\u0085y  z"),
    (4, "a" * 5000 + " " * 300 + "\t\n" * 50),
    (5, "İ Σς ﬁ <|endoftext|> 😀 ́e"),
    (None, "no id"),
    (6, " ".join(f"word{i}" for i in range(6000))),
]


def test_byte_bpe_matches_the_library(spark, documents, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK", 3000)
    own = ByteBpe(RANKS, PATTERN).library
    docs = written(documents(ODD).repartition(3), "docs")
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    want = sorted((str(i), np.array(own.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in ODD)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in out) == want
    assert {(r.doc_id, bytes(r.decoded)) for r in out} == {(i, (t or "").encode()) for i, t in ODD}
    assert all(r.n_tokens == len(r.ids) // 4 for r in out)


def test_byte_bpe_of_nothing(spark, documents):
    assert byte_bpe.encode(documents([]), RANKS, PATTERN).count() == 0
    assert byte_bpe.encode(documents([(1, None)]), RANKS, PATTERN).collect()[0].n_tokens == 0


@given(st.lists(st.binary(max_size=20)))
def test_lists_round_trip(values):
    assert byte_bpe._unlist(byte_bpe._list(values)) == values


def test_word_ids_match_the_library():
    library = Tokenizer.from_str(WORDS.decode())
    texts = [*(t or "" for _, t in ODD), "a b <|endoftext|> c d", "x<|startoftext|>Y<|endoftext|>", "<|EndOfText|> <| endoftext |>"]
    for specials in ("ids", "text"):
        library.encode_special_tokens = specials == "text"
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert WordBpe(WORDS, specials).encode(texts) == want


def test_groups_follow_the_input(documents, monkeypatch):
    rows = [(None if i % 3 else i, f"words {i} and more " * (i % 40)) for i in range(600)]
    groups = []
    for most, enough in ((1_000_000, 5_000), (40, 5_000), (1_000_000, 300)):
        monkeypatch.setattr(packing, "PIECES_PER_GROUP", most)
        monkeypatch.setattr(packing, "ENOUGH", enough)
        got = packing.pack_documents(documents(rows), WORDS, window=256).collect()
        groups.append(len({r.sequence_id // packing.PER_GROUP for r in got}))
        assert len({r.doc_id for r in got}) == 201 and sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
        fill = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == fill.get(r.sequence_id, 0)
            fill[r.sequence_id] = r.offset + r.length
    assert groups[0] == 1 and groups[1] > 10 and 1 < groups[2] <= 4


def test_packing_takes_special_tokens_as_the_untouched_library(documents):
    texts = ["a b <|endoftext|> c d", "<|startoftext|>", "plain", "", None]
    library = Tokenizer.from_str(WORDS.decode())
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert 49407 in want[0] and 49406 in want[1]
    got = packing.pack_documents(documents(list(enumerate(texts))), WORDS, keep_ids=True).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == want


def test_packing_covers_every_token_once(spark, documents):
    rows = [*ODD, *((100 + i, "words and more words " * (i % 90)) for i in range(300))]
    out = packing.pack_documents(documents(rows), WORDS, keep_ids=True).toPandas()
    own = WordBpe(WORDS, "ids")
    by_doc = {}
    for i, t in rows:
        by_doc.setdefault(i, []).append(own.encode([t or ""])[0] + np.array([2], "<u4").tobytes())
    for i, datas in by_doc.items():
        mine = out[out.doc_id.isna() if i is None else out.doc_id == i]
        whole = sorted(datas)[0]
        assert set(mine.doc_tokens) == {len(whole) // 4}
        assert mine.length.sum() == sum(len(d) for d in datas) // 4
        for r in mine.itertuples():
            part = whole[4 * r.start : 4 * (r.start + r.length)]
            assert part == r.ids and zlib.crc32(part) == r.ids_crc32
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]]
        assert seq.length.sum() <= packing.WINDOW
    assert out.length.sum() > 0.9 * 4096 * (out.sequence_id.nunique() - spark.sparkContext.defaultParallelism)


@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_takes_the_tightest_window(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    sequence, offset = packing.pack(lengths, 40)
    left: list[int] = []
    for k, s, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        fits = [x for x in left if x >= k]
        if fits:
            assert left[s] == min(fits) and o == 40 - left[s]
        else:
            assert s == len(left) and o == 0
            left.append(40)
        left[s] -= k


def test_packing_of_nothing(spark, documents):
    assert packing.pack_documents(documents([]), WORDS).count() == 0
    one = packing.pack_documents(documents([(7, None)]), WORDS).collect()[0]
    assert (one.doc_tokens, one.length, one.offset) == (1, 1, 0)


def test_queries_have_the_contract_columns(spark):
    from odweave.llm import queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    own = ByteBpe(RANKS, PATTERN).library
    for r in queries.op4_byte_bpe(spark, d).collect():
        ids = np.array(own.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_byte_bpe_ids_of_32_bits(documents):
    ranks = b"\n".join(base64.b64encode(bytes([b])) + b" " + str(b * 300).encode() for b in range(256))
    docs = written(documents([(1, "abc é"), (2, None)]), "docs")
    out = byte_bpe.decode(byte_bpe.encode(docs, ranks, PATTERN), ranks, PATTERN).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in out} == {1: [b * 300 for b in "abc é".encode()], 2: []}
    assert {r.doc_id: bytes(r.decoded) for r in out} == {1: "abc é".encode(), 2: b""}


def test_new_words_are_encoded_together():
    texts = [f"New{i}a's Öl{i} ZZ''s {'zZ' * (i % 5)} x-{i} 日{i} \x00{i}" for i in range(300)]
    own, calls = WordBpe(WORDS, "ids"), []
    native = own.words
    own.words = lambda *a, **b: calls.append(a) or native(*a, **b)
    library = Tokenizer.from_str(WORDS.decode())
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    assert len(calls) == 1
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want and len(calls) == 1
