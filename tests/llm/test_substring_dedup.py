"""Suffix arrays against sorted suffixes; removal of repeats against counting every window."""

import base64
import hashlib
import time
from collections import Counter

import numpy as np
import pytest

from odweave.llm import queries, substring_dedup
from odweave.llm.substring_dedup import ENTRY, _by_bucket, remove_repeats, unpack
from odweave.llm.suffix_array import common_prefixes, suffix_array


def brute(texts, length):
    """(kept, removed, spans) of each text, by counting all windows."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone, prepend=False) & gone).sum())
        out.append((bytes(np.frombuffer(d, np.uint8)[~gone]), int(gone.sum()), spans))
    return out


def brute_passages(texts, length, words):
    """As brute, but of the spans only those that touch more than so many words or have 400 bytes."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
        spans = [(a, z) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if len(d[a:z].split()) > words or z - a >= 400]
        kept, at = [], 0
        for a, z in spans:
            kept.append(d[at:a])
            at = z
        kept = b"".join([*kept, d[at:]])
        out.append((kept, len(d) - len(kept), len(spans)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_and_prefixes(seed):
    r = np.random.default_rng(seed)
    data = bytes(r.integers(0, r.integers(1, 6), r.integers(0, 120)).astype(np.uint8) * 51)
    array = suffix_array(data)
    assert array.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    prefixes, before = common_prefixes(data, array)
    for a, b in zip(array[1:].tolist(), array[:-1].tolist(), strict=True):
        n = 0
        while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        assert (before[a], prefixes[a]) == (b, n)


def corpus(seed):
    r = np.random.default_rng(seed)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(300)] + ["größe", "日本"]
    text = lambda n: " ".join(r.choice(words, n))
    shared, common = text(60), text(40)
    rows = [text(int(n)) for n in r.integers(1, 200, 30)]
    rows += [f"{text(20)} {shared} {text(30)}" for _ in range(25)]
    rows += [rows[3], rows[3], rows[40], f"{common} {text(5)} {common}", "", None, "a" * 900, "ab" * 700, "short"]
    near = text(150).split()
    for i in range(12):
        w = list(near)
        w[int(r.integers(0, 150))] = f"edit{i}"
        rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize(("seed", "length", "hot"), [(1, 400, 2000), (2, 100, 2000), (3, 100, 3), (4, 40, 2)])
def test_matches_brute_force(documents, seed, length, hot):
    texts = corpus(seed)
    docs = documents(list(enumerate(texts))).repartition(3)
    got = {r.doc_id: r for r in remove_repeats(docs, length=length, hot=hot).collect()}
    assert len(got) == len(texts)
    for i, (kept, removed, spans) in enumerate(brute(texts, length)):
        assert (bytes(got[i].kept), got[i].n_removed, got[i].n_spans) == (kept, removed, spans), i
        assert got[i].text == texts[i] and sum(got[i].span_ends) - sum(got[i].span_starts) == removed


@pytest.mark.parametrize("hot", [2000, 2])
def test_passages_beside_longer_strings(documents, hot):
    texts = corpus(5)
    got = {r.doc_id: r for r in remove_repeats(documents(list(enumerate(texts))).repartition(3), hot=hot, passage=200).collect()}
    plain, short = brute(texts, 400), brute_passages(texts, 200, 50)
    assert len(got) == len(texts) and any(a[1] != b[1] for a, b in zip(plain, short, strict=True))
    for i, t in enumerate(texts):
        assert (bytes(got[i].kept), got[i].n_removed, got[i].n_spans) == plain[i], i
        assert (got[i].passage_bytes, got[i].n_passages) == short[i][1:], i
        assert got[i].without_passages == (None if t is None else short[i][0].decode("utf-8", "ignore"))


JAPANESE = "".join(chr(0x3041 + k * k % 83) for k in range(2000))
BASE64 = base64.b64encode(hashlib.sha512(b"x").digest() * 20).decode()
CODE = "".join(f"f{k}=call(x+{k})*{k * k};" for k in range(60))


@pytest.mark.parametrize("passage", [JAPANESE, BASE64, CODE, "https://example.org/" + "a1b2/" * 90])
def test_passages_without_spaces(documents, passage):
    r = np.random.default_rng(1)
    own = lambda: " ".join("".join(chr(97 + c) for c in r.integers(0, 26, 7)) for _ in range(60))
    texts = [f"{own()} | {passage} | {own()}", f"{own()}、{passage}", own(), "".join(chr(0x4E00 + c) for c in r.integers(0, 9000, 500))]
    assert len(passage.split()) == 1
    got = {x.doc_id: x for x in remove_repeats(documents(list(enumerate(texts))), length=200, words=50, rewrite=True).collect()}
    want = brute_passages(texts, 200, 50)
    assert [got[i].text for i in range(4)] == [w[0].decode("utf-8", "ignore") for w in want]
    assert passage[100:-100] not in got[0].text + got[1].text and [got[i].n_removed for i in (2, 3)] == [0, 0]


def test_buckets_cost_what_occurs():
    """The entries of a block among a million buckets, whose number alone took seconds before."""
    r = np.random.default_rng(3)
    key = r.integers(0, 1 << 60, 2000).astype(np.uint64)
    one = np.ones(2000, np.int64)
    began = time.perf_counter()
    rows = _by_bucket(7, 100_000_000, key, key, one, one, np.arange(2000))
    assert time.perf_counter() - began < 1 and len(rows) == len({int(k) % 100_000_000 for k in key})
    kept = [unpack(d, *ENTRY) for _, _, d in rows]
    assert sorted(int(x) for g in kept for x in g[0]) == sorted(key.tolist()) and [k for _, k, _ in rows] == sorted(k for _, k, _ in rows)


def test_the_query_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op3_suffix_array_dedup(spark, d).collect()}
    plain, short = (f([r.text for r in rows], *a) for f, a in ((brute, [400]), (brute_passages, [200, 50])))
    for r, (kept, removed, spans), (left, _, passages) in zip(rows, plain, short, strict=True):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans) == (len((r.text or "").encode()), removed, spans)
        assert (g.kept_sha256, g.n_passages) == (hashlib.sha256(kept).hexdigest(), passages)
        assert g.text == (None if r.text is None else left.decode("utf-8", "ignore"))


def test_edges(spark, documents):
    same = "x y z " * 100
    docs = documents([(None, same), (7, same), (7, same), (8, None), (9, "")])
    clash = docs.withColumnRenamed("lang", "kept")
    out = remove_repeats(clash)
    assert out.columns.count("kept") == 1
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in out.collect()) == [(0, 600, 600), (7, 600, 600), (7, 600, 600), (8, 0, 0), (9, 0, 0)]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_unique_windows_are_not_sorted(monkeypatch):
    rng, sorted_bytes = np.random.default_rng(3), []
    text = lambda n: rng.integers(97, 123, n, np.uint8).tobytes()
    shared, own = text(60), [text(300) for _ in range(40)]
    contents = [*own, own[0][:100] + shared + text(80), text(90) + shared, b"ab" * 40, text(30)]
    several = np.array([False] * (len(contents) - 1) + [True])
    make = substring_dedup.suffix_array
    monkeypatch.setattr(substring_dedup, "suffix_array", lambda data: sorted_bytes.append(len(data)) or make(data))
    windows = Counter(c[i : i + 20] for c in contents for i in range(len(c) - 19))
    for c, twice, (start, size) in zip(contents, several, substring_dedup.repeats(contents, several, 20), strict=True):
        got = {i for x, n in zip(start.tolist(), size.tolist(), strict=True) for i in range(x, x + n)}
        assert got == {i for i in range(len(c) - 19) if twice or windows[c[i : i + 20]] > 1}
    assert sum(sorted_bytes) < sum(map(len, contents)) / 10
    assert [len(x) for x, _ in substring_dedup.repeats(own, np.zeros(40, bool), 20)] == [0] * 40
