"""The Merkle manifest against trees built level by level in plain Python."""

import zlib
from hashlib import sha256

import pytest

from odweave.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree int, part int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def way(tree, at, fanout):
    """(nodes before, nodes behind) on each level from a leaf to the root."""
    out = []
    for level in tree[:-1]:
        run = at // fanout * fanout
        out.append((level[run:at], level[at + 1 : run + fanout]))
        at //= fanout
    return out


def plain(rows, fanout):
    """The rows of verified_rows."""
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    groups = {}
    for r in sorted(rows, key=order):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r) for r in groups[s]], fanout) for s in names}
    top = levels([trees[s][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = way(trees[s], i, fanout) + way(top, k, fanout)
            false = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4] or "")
            node = leaf([*r[:4], low]) if false else leaf(r)
            for before, behind in path:
                node = h(*before, node, *behind)
            proof = h(*[x for before, behind in path for x in before + behind])
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def rows(n):
    odd = [
        (None, None, None, None, None), (None, None, None, None, None), (None, "b", "en", 3, "Aé\n"), (7, None, "en", 0, ""),
        (7, None, "en", 0, ""), (7, None, "en", 0, None), (5, "", "", -1, "İ A Z"), (10, "a", "de", 5, "X" * 300_000), (3, "ä", "x", 1, "日本 B"),
    ]
    return [*odd, *((i * 7 % n, "hot" if i % 3 else f"s{i % 11}", "en", i, f"Text {i} OF {i % 5}") for i in range(n))]


@pytest.mark.parametrize(("n", "fanout", "parts"), [(700, 16, 4), (300, 2, 5), (400, 3, 13), (1, 16, 4)])
def test_against_plain_trees(spark, n, fanout, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        made = rows(n) if n > 1 else [(1, "one", "en", 1, "A")]
        docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in made], SCHEMA).repartition(3)
        got = [tuple(r) for r in merkle.verified_rows(docs, fanout=fanout).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=repr) == sorted(plain(made, fanout), key=repr)
    changed = [r for r in got if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    if n > 1:
        assert not all(r[-1] for r in changed) and all(r[-1] for r in got if r not in changed)


def test_node_records(spark):
    docs = spark.createDataFrame([(*r, "", 1, 2) for r in rows(500)], SCHEMA)
    forest, top = merkle.manifest(docs, fanout=4)
    want = {}
    groups = {}
    for r in sorted(rows(500), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault("" if r[1] is None else f"={r[1]}", []).append(leaf(r))
    for s, leaves in groups.items():
        want |= {(s, k + 1, i): x for k, level in enumerate(levels(leaves, 4)[1:]) for i, x in enumerate(level)}
    got = [((r["tree"], r["level"], r["index"]), bytes(r["digest"]).hex()) for r in merkle.all_nodes(forest).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert {r["name"] for r in top.leaves.collect()} == set(groups)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.verified_rows(docs).collect() == []
    assert merkle.verified_rows(docs).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
