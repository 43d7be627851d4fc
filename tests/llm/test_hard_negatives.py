"""Hard negatives against scoring all rows in plain Python."""

import math

import numpy as np
import pytest

from odweave.llm import hard_negatives
from odweave.llm.hard_negatives import Blocks, Space, first_scores, products

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, block int, key double"


def plain(rows, positives=5, negatives=3):
    good = []
    for i, v, label in rows:
        if None in (i, label) or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (i, own, v) in enumerate(good):
        if i % 50:
            continue
        scored = [(sum(p * q for p, q in zip(v, w, strict=True)), j, label, b) for b, (j, label, w) in enumerate(good) if b != a and len(w) == len(v)]
        scored.sort(key=lambda r: (-r[0], r[1], r[3]))
        for s, j, _, _ in [r for r in scored if r[2] == own][:positives]:
            fits = [r for r in scored if r[2] != own and 50 * s <= 100 * r[0] <= 95 * s][:negatives]
            out += [(i, j, k, r[1], s, r[0]) for k, r in enumerate(fits, 1)]
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(i, v, label, "x", 1, 2.0) for i, v, label in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in hard_negatives.hard_negatives(docs).collect()]


def table(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    return [(int(i), (centres[i % 8] + spread * r.normal(size=dim)).tolist(), int(r.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("block", [2048, 10])
def test_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    r = np.random.default_rng(5)
    odd = [
        (None, [1.0] * 6, 1), (50, None, 1), (100, [1.0] * 6, None), (150, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (200, [math.nan] * 6, 2), (250, [math.inf] * 6, 2),
        (300, [0.0] * 6, 1), (350, [], 1), (351, [], 2), (352, [], 1), (400, [0.5, 0.5], 1), (401, [0.5, 0.4], 1), (402, [0.4, 0.4], 2), (450, [-1.0] * 6, 9),
    ]
    copies = [(int(i), [0.25] * 6, int(i % 3)) for i in range(500, 700)]  # ties by id, and a third of all rows
    rows = [*table(1, 400, 6, 0.3), *odd, *copies, (100, [0.3] * 6, 3), (100, [0.3] * 6, 3)]
    r.shuffle(copies)
    assert sorted(run(spark, rows)) == sorted(plain(rows))


def test_none_and_one(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0], 1)]) == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_components(spark):
    rows = [(i, [1e5 * i, 3e5 + i, 1.0 + i], i % 3) for i in range(60)]
    assert sorted(run(spark, rows)) == sorted(plain(rows))
    with pytest.raises(Exception, match="int too big|too large|out of bounds|Overflow"):
        run(spark, [(0, [1e200], 1), (1, [1e200], 1), (2, [1.0], 1)])


def test_blocks_far_from_all_bands_are_left_out():
    """On clusters most blocks are certified by their distance alone, and none that holds a result is."""
    rows = np.floor(256 * np.array([v for _, v, _ in table(2, 4000, 8, 0.02)]))
    space = Space(float((rows * rows).sum(1).max()), [(8, x.tobytes()) for x in rows[:500]])
    far = space.far(space.lifted(rows))
    pivot, key = far.argmin(1), far.min(1)
    order = np.lexsort((key, pivot))
    parts = [p for own in np.split(order, np.flatnonzero(np.diff(pivot[order])) + 1) for p in np.array_split(own, max(1, len(own) // 50))]
    blocks = Blocks(space, [(i, 8, int(pivot[p[0]]), float(key[p].min()), float(key[p].max())) for i, p in enumerate(parts)])
    of = {row: i for i, p in enumerate(parts) for row in p.tolist()}
    for q in rows[:40]:
        s = products(q[None], rows)[0]
        best = first_scores(s, np.arange(len(s)), None, None, 5)
        qf = space.far(np.append(q, 0)[None])[0]
        asked = set(blocks.wanted(8, float(q @ q), qf, [{"low": int(s[best[-1]]), "high": None}], 0, len(parts)).tolist())
        assert {of[i] for i in best.tolist()} <= asked and len(asked) < len(parts) / 2
        low, high = int(0.5 * s[best[0]]), int(0.6 * s[best[0]])
        inside = np.flatnonzero((s >= low) & (s <= high)).tolist()
        asked = set(blocks.wanted(8, float(q @ q), qf, [{"low": low, "high": high}], 0, len(parts)).tolist())
        assert {of[i] for i in inside} <= asked and len(asked) < len(parts)
