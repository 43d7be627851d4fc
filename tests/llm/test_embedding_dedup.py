"""Embedding near-dedup against all pairs, and components against union-find."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from odweave.llm import embedding_dedup
from odweave.llm.components import components, forest


def union(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    edges += [(2000, 2000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    own = [e for e in edges if e[0] != e[1]]
    want = union({x for e in own for x in e}, own)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19))))
def test_forest(edges):
    a, b = (np.array(x, np.int64) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 2
    assert dict(enumerate(forest(20, a, b).tolist())) == union(range(20), edges)


def brute(ids, vectors):
    unit = embedding_dedup.unit(np.array(vectors))
    cos = unit @ unit.T
    np.fill_diagonal(cos, 0)
    return {(ids[i], ids[j]) for i, j in zip(*np.nonzero(cos >= 0.9), strict=True) if i < j}


@pytest.mark.parametrize("chunk", [16, 1024])
def test_recall_and_odd_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(7)
    vectors = list(rng.normal(size=(150, 32)))
    for c in range(20):  # pairs and triples around the threshold
        vectors += [vectors[c] + rng.normal(size=32) * s for s in (0.05, 0.2, 0.3, 0.4)]
    vectors += [vectors[0] + rng.normal(size=32) * 0.02 for _ in range(60)] + [vectors[1]] * 30 + [vectors[1] * 3]
    ids = list(range(len(vectors)))
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [None, *[1.0] * 31], [1.0] * 8, [float("inf")] * 32]
    rows = [(i, v.tolist(), 1) for i, v in zip(ids, vectors, strict=True)] + [(900 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(None, vectors[1].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(out) == len(rows)
    links = brute(ids, vectors)
    found = sum(r.n_links for r in out.values()) // 2
    assert 0.9 * len(links) <= found <= len(links)
    if found == len(links):
        for i, c in union(ids, links).items():
            assert out[i].component_id == c and out[i].kept == (i == c)
    for i in range(900, 907):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert out[None].n_links == 0 and out[None].component_id is None and not out[None].kept
    full = union(ids, links)
    assert all(full[i] == full[out[i].component_id] for i in ids)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    from odweave.llm import queries

    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    links = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    out = queries.op5_embedding_dedup(spark, d).collect()
    found = sum(r.n_links for r in out) // 2
    assert 0.9 * len(links) <= found <= len(links)


def test_recall_just_over_the_threshold(spark):
    rng = np.random.default_rng(11)
    a = embedding_dedup.unit(rng.normal(size=(1000, 64)))
    b = rng.normal(size=a.shape)
    b = embedding_dedup.unit(b - (a * b).sum(1, keepdims=True) * a)
    cos = rng.uniform(0.9, 0.91, (1000, 1))
    vectors = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * b])
    ids = list(range(len(vectors)))
    links = brute(ids, vectors)
    assert len(links) > 900
    rows = list(zip(ids, vectors.tolist(), strict=True))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in embedding_dedup.near_duplicates(df).collect()) // 2
    assert 0.94 * len(links) <= found <= len(links)
