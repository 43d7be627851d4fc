"""The Jaccard join against all pairs."""

import random
import re
from collections import defaultdict
from types import SimpleNamespace

import pytest
from hypothesis import given
from hypothesis import strategies as st

from odweave.llm import jaccard, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    data = (text or "").encode()
    words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in data))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Components by comparing every two documents that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    done = set()
    for own in where.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                if (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def texts(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnop") + str(r.randrange(400))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 6, 20, 60, 150]))]
        for _ in range(r.choice([1, 2, 5])):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, len(base) // 30])):
                own[r.randrange(len(own))] = word()
            rows.append(own[: max(1, len(own) - r.choice([0, 0, 1, 15]))])
    rows += [[word() for _ in range(r.randrange(1, 120))] + passage for _ in range(25)]
    rows += [passage[: r.randrange(40, 60)] for _ in range(10)]
    return [(i, r.choice([" ", "\n", " \t"]).join(w.upper() if r.random() < 0.1 else w for w in x)) for i, x in enumerate(rows)]


@given(st.text(alphabet="aB \t\n\x1cé", max_size=60))
def test_shingles(text):
    assert len(jaccard.shingles(text)) == len(shingle_set(text))
    assert jaccard.shingles(text).tolist() == jaccard.shingles(f" {text.replace('B', 'b')}\n").tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, documents, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "GROUP", 2)
    rows = [*texts(seed), (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "x " * 30_000)]
    random.Random(seed).shuffle(rows)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(documents(rows)).collect()}
    assert out == brute(rows)


def test_repeats_and_nulls(spark, documents):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (None, "alone")]
    out = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.link(documents(rows)).collect())
    assert out == [("3", 2, 3), ("5", 2, 3), ("5", 2, 3), ("None", 1, None), ("None", 2, 3)]
    assert jaccard.link(documents([])).count() == 0


def test_near_copies_with_null_ids_and_an_id_on_two_texts(spark, documents):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(80)]
    rows = [(100 + i, [*base[:k], f"x{i}", *base[k + 1 :]]) for i, k in enumerate([0, 79, 1, 78, 2, 77, 3, 76, 4, 75])]
    # sets of null ids that are alike only to others, and an id on two texts that aren't alike
    chain = [f"c{k}" for k in range(64)]
    rows += [(3, chain[:50]), (201, chain[7:57]), (5, chain[14:64])]
    rows += [(300, [f"y{k}" for k in range(40)]), (301, [f"z{k}" for k in range(40)]), (2, [f"y{k}" for k in range(41)])]
    rows += [(1, [f"z{k}" for k in range(41)]), (400, [f"n{k}" for k in range(40)]), (401, [f"n{k}" for k in range(41)])]
    texts = [(i, " ".join(x)) for i, x in rows]
    for seed in range(3):
        # surrogates of null ids over 1000; 300 and 301 become one id
        nulls = {100 + i for i in r.sample(range(10), 6)} | {201, 400, 401}
        real = {i: None if i in nulls else 300 if i == 301 else i for i, _ in texts}
        want, least = brute(texts), {}
        for i, (_, c) in want.items():
            least.setdefault(c, []).append(real[i])
        least = {c: min((i for i in ids if i is not None), default=None) for c, ids in least.items()}
        got = jaccard.link(documents([(real[i], t) for i, t in texts])).collect()
        key = lambda x: tuple(-1 if v is None else v for v in x)
        assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=key) == sorted(
            ((real[i], n, least[c]) for i, (n, c) in want.items()), key=key
        )


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_jaccard_join(spark, d).collect()}
    assert out == brute(rows)


def test_batches_of_more_rows_than_16_bits_number(spark):
    """Every shingle stays with its own document, however many rows a batch has."""
    n, blocks = 70_000, 4
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    docs = spark.range(n).selectExpr("concat('w', id, ' is one of many') AS text").coalesce(1)
    none = SimpleNamespace(value=bytes((1 << jaccard.SKETCH) // 8))
    got = {}
    for r in jaccard.scatter(docs, none, blocks, "text").collect():
        key, size, _, shingle, _ = jaccard._unpack(bytes(r.data))
        got |= {(r.block, g): (k, m) for g, k, m in zip(shingle.tolist(), key.tolist(), size.tolist(), strict=True)}
    assert len(got) == n
    for i in [0, 1, 399, 400, 4463, 4464, 65_535, 65_536, 69_999]:
        s = jaccard.shingles(f"w{i} is one of many")
        g = int(s[0])
        assert got[g % blocks, g // blocks & (1 << 48) - 1] == (jaccard.set_key(s), 1)
