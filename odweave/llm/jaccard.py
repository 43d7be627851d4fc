"""Exact Jaccard join on word shingles, by a blocked sparse product of documents and n-grams.

A document is the set of its distinct shingles of five words. Documents with the same set are one class, so
copies are never compared. Candidates come from the sparse product of classes and shingles, in blocks of
shingles: a class sends, of its set in one global order, the first n - ceil(3n/4) + m shingles, where
m = max(1, floor(n/10)). Two sets whose Jaccard similarity is 3/4 or more share at least min(m, m') shingles
in what both have sent, so pairs that accumulate fewer are discarded, and so are pairs of unfit sizes. The
order puts shingles of many documents last, which a counting sketch of fixed size finds.

A block's task turns each shingle that several classes share into a list. The product is accumulated in two
steps, neither of which makes all pairs of a group:
1. Each class meets the smallest class of each of its lists, if that is so for enough of them, and those that
   most often are the smallest, have the most frequent shingles (as what many near copies come from has), or are
   the last. This links groups of near copies, pair by pair.
2. Classes of different components that share enough lists meet in those lists.
Candidates are verified by whole sets, computed anew from whole texts. No pair is lost: a class whose counts
of lists headed by other components are too small to link with anyone is left out of step 2, nothing else is.

Defined results: null and empty texts, and texts of white space, have empty sets and link with nothing;
texts of one to four words have one shingle; rows that repeat an id with the same text are one document, and
with other texts documents of their own, with the id as their name; a row with a null id links as any other,
and names no component (one of null ids only is null); an empty table gives an empty one.
Shingles and sets are compared by 64-bit hashes, and sets by their sizes too.
Ids are integers: they are cast, and one that can't be raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.common import ARROW_ROWS, discard, stretches, written
from odweave.llm.components import components

WORDS = 5
#: Jaccard similarity from which documents link, as a fraction.
OVER, UNDER = 3, 4
#: Cells of the sketch of document frequencies, as a power of 2; it and its result have a fixed size.
SKETCH = 23
CHUNKS = 64
#: Classes that a verification's group holds besides the one they are compared with.
GROUP = 256
#: Rows and pairs of a table that is broadcast: at most 250,000 rows of 28 bytes and 500,000 entries of 16, 15 MB. A count
#: checks them, and more are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Bytes of texts for each block of shingles.
BLOCK = 8_000_000
#: Tasks of a stage over blocks at most; with more blocks, a task takes several.
TASKS = 20_000

_rng = np.random.default_rng(9)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
PLACE = _rng.integers(1, 2**63, WORDS + 1, dtype=np.uint64) | np.uint64(1)
RATIO = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A well-mixed permutation of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of RATIO and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size, one = max(n, 1 << 16), np.uint64(1)
        out = []
        for r in (RATIO, pow(RATIO, -1, 2**64)):
            p = np.full(size, np.uint64(r))
            p[0] = one
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    word = (b != 32) & ((b < 9) | (b > 13))
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    up, down = powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[b] * up, dtype=np.uint64)])
    w = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    n = len(w)
    if n < WORDS:
        return mix((w * PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n) * PLACE[-1])
    s = w[: n - WORDS + 1] * PLACE[0]
    for k in range(1, WORDS):
        s = s + w[k : n - WORDS + 1 + k] * PLACE[k]
    return np.unique(mix(s))


def set_key(s: np.ndarray) -> int:
    """The hash that stands for a set."""
    return int(mix(mix(s).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))[0].astype(np.int64))


def slack(n):
    """m of a set of n: an array's, or a number's."""
    return np.maximum(1, n // 10)


def sent(s: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """What a set sends: the start of it, with frequent shingles last; and the share of these, in 255ths."""
    n = len(s)
    k = min(n, n - -(-OVER * n // UNDER) + int(slack(n)))
    cell = (s >> np.uint64(64 - SKETCH)).astype(np.int64)
    often = (hot[cell >> 3] >> (cell & 7)) & 1
    return s[np.argsort(often, kind="stable")[:k]], int(often.sum()) * 255 // n


def survey(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set_key, n, mark) of each document, where mark is a hash of its text, and (chunk, counts) of each partition's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH, np.uint32)
        rows = 0

        def out(ids: list, keys: list, ns: list, marks: list, chunks: list, counts: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            n = max(len(ids), len(chunks))
            cols = [pa.array(c or [None] * n, t) for c, t in zip((ids, keys, ns, marks, chunks, counts), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=["id", "set_key", "n", "mark", "chunk", "counts"])

        for b in batches:
            keys, ns, seen = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t)
                keys.append(set_key(s))
                ns.append(len(s))
                seen.append(s)
            rows += len(ns)
            every = (np.concatenate(seen) >> np.uint64(64 - SKETCH)).astype(np.int64) if seen else np.zeros(0, np.int64)
            np.add.at(cells, every, np.uint32(1))
            yield out(b.column(0).to_pylist(), keys, ns, b.column(2).to_pylist(), [], [])
        if rows:
            parts = np.minimum(cells, 255).astype(np.uint8).reshape(CHUNKS, -1)
            yield out([], [], [], [], list(range(CHUNKS)), [zstandard.compress(p.tobytes(), 1) for p in parts])

    return docs.select(F.col(id_col).cast("long"), text_col, F.xxhash64(text_col)).mapInArrow(
        run, "id long, set_key long, n long, mark long, chunk int, counts binary"
    )


def frequent(surveyed: DataFrame) -> bytes:
    """A bit for each cell of the sketch: whether some shingle in it is frequent. 2**SKETCH bits, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(c), np.uint8)
                totals[k] = totals.get(k, np.zeros(len(part), np.int64)) + part
        for k, total in totals.items():
            mean = total.mean()
            bits = np.packbits(total > mean + max(8, 6 * np.sqrt(mean)), bitorder="little")
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = surveyed.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, bits binary")
    got = {r.chunk: bytes(r.bits) for r in rows.collect()}
    return b"".join(got.get(c, bytes((1 << SKETCH) // CHUNKS // 8)) for c in range(CHUNKS))


def scatter(docs: DataFrame, hot, blocks: int, text_col: str) -> DataFrame:
    """(block, data): what the documents of a batch send to each block of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(hot.value, np.uint8)
        for b in (x.slice(at, ARROW_ROWS) for x in batches for at in range(0, len(x), ARROW_ROWS)):  # 16 bits number a batch's texts
            keys, ns, parts, shares, places, seen = [], [], [], [], [], set()
            for t in b.column(0).to_pylist():
                s = shingles(t)
                if not len(s) or (k := (set_key(s), len(s))) in seen:
                    continue
                seen.add(k)
                keys.append(k[0])
                ns.append(k[1])
                part, share = sent(s, often)
                parts.append(part)
                shares.append(share)
                places.append((np.arange(len(parts[-1])) * 255 // len(parts[-1])).astype(np.uint8))
            if not parts:
                continue
            g = np.concatenate(parts)
            who = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p) for p in parts])
            block = (g % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            block = block[order]
            g, who, place = (g // np.uint64(blocks))[order], who[order], np.concatenate(places)[order]
            key, n, share = np.array(keys, np.int64), np.array(ns, np.uint32), np.array(shares, np.uint8)
            made, at = [], []
            for k, x, y in stretches(block):
                own, index = np.unique(who[x:y], return_inverse=True)
                head = np.array([len(own), y - x], np.uint32).tobytes()
                low, high = g[x:y].astype(np.uint32), (g[x:y] >> np.uint64(32)).astype(np.uint16)
                made.append(b"".join((head, key[own].tobytes(), n[own].tobytes(), share[own].tobytes(), index.astype(np.uint16).tobytes(), low.tobytes(), high.tobytes(), place[x:y].tobytes())))
                at.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(made, pa.binary())], names=["block", "data"])

    return docs.select(text_col).mapInArrow(run, "block int, data binary")


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    d, m = np.frombuffer(data, np.uint32, 2).tolist()
    at, out = 8, []
    for kind, count in ((np.int64, d), (np.uint32, d), (np.uint8, d), (np.uint16, m), (np.uint32, m), (np.uint16, m), (np.uint8, m)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    key, n, share, index, low, high, place = out
    return key[index], n[index], share[index], low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), place


LIST_COLUMNS = ["shingle", "set_key", "n", "place", "head", "head_n", "common", "common_n", "last", "last_n"]


def lists(scattered: DataFrame, blocks: int) -> DataFrame:
    """LIST_COLUMNS: the classes of each shingle that several share, and the smallest, that with the
    largest share of frequent shingles, and the largest of them.

    place is where the shingle stands in what the class has sent, in 255ths and rounded down.

    Only 48 bits of a shingle and its block are kept: two that agree in these add to counts, which are verified.
    """

    def made(k: int, parts: list) -> Iterator[pa.RecordBatch]:
        key, n, share, g, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        order = order[several]
        key, n, share, g, place = key[order], n[order].astype(np.int64), share[order], g[order], place[order]
        order = np.lexsort((n, key, g))
        key, n, share, g, place = key[order], n[order], share[order], g[order], place[order]
        once = np.ones(len(g), bool)
        once[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])
        key, n, share, g, place = key[once], n[once], share[once], g[once], place[once].astype(np.int16)
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        size = np.diff(np.append(np.flatnonzero(first), len(g)))
        start = np.flatnonzero(first)
        most = np.lexsort((share, g))[start + size - 1]
        heads = [np.repeat(x, size) for x in (start, most, start + size - 1)]
        keep = np.repeat(size > 1, size)
        heads = [h[keep] for h in heads]
        whole = (g[keep] << np.uint64(14) | np.uint64(k & 0x3FFF)).astype(np.int64)
        for a in range(0, len(whole), 100_000):
            s = slice(a, a + 100_000)
            cols = [whole[s], key[keep][s], n[keep][s], place[keep][s], *(x[h[s]] for h in heads for x in (key, n))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=LIST_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != block and parts:
                    yield from made(block, parts)
                    parts = []
                block = k
                parts.append(_unpack(data))
        if parts:
            yield from made(block, parts)

    kinds = ", ".join(f"{c} {'short' if c == 'place' else 'long'}" for c in LIST_COLUMNS)
    return scattered.repartition(min(blocks, TASKS), "block").sortWithinPartitions("block").mapInArrow(run, kinds)


def _slack(c: str):
    return F.greatest(F.lit(1), F.floor(F.col(c) / 10))


def _fit(a: str, b: str):
    """Whether sizes let two sets link at all."""
    return (F.col(a) * UNDER >= F.col(b) * OVER) & (F.col(b) * UNDER >= F.col(a) * OVER)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of class ids whose whole sets are similar enough.

    A document that stands for a class sends its set to the groups it is compared in, and b's set to as many
    groups as b's partners fill. classes has (class, doc, mark): the documents that stand for the classes.
    """
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    size = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("groups"))
    sized = pairs.join(size, "b")
    jobs = sized.select(
        F.col("a").alias("class"), F.struct(F.col("b"), F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("g")).alias("job")
    ).groupBy("class").agg(F.collect_list("job").alias("jobs"))
    wanted = written(
        classes.join(jobs, "class", "left").join(size.withColumnRenamed("b", "class"), "class", "left")
        .filter("jobs IS NOT NULL OR groups IS NOT NULL")
        .select("class", "doc", "mark", "jobs", F.coalesce("groups", F.lit(0)).alias("groups")),
        "wanted",
    )
    few = wanted.count() <= BROADCAST_ROWS and pairs.count() <= 2 * BROADCAST_ROWS
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_mark"))
    rows = rows.join(F.broadcast(wanted) if few else wanted, (F.col("_mark") == F.col("mark")) & F.col("_doc").eqNullSafe(F.col("doc")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # rows that repeat id and text stand for a class once in a task
        for b in batches:
            out = []
            for c, t, jobs, groups in zip(*(b.column(x).to_pylist() for x in ("class", "_text", "jobs", "groups")), strict=True):
                if c in done:
                    continue
                done.add(c)
                data = shingles(t).tobytes()
                out += [(c, g, None, data) for g in range(groups)]
                out += [(j["b"], j["g"], c, data) for j in jobs or []]
            for k in range(0, len(out), 2000):
                part = out[k : k + 2000]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                cols = [pa.array([r[i] for r in part], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=["b", "g", "a", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            found = []
            for b, g, a, data in zip(*(batch.column(x).to_pylist() for x in ("b", "g", "a", "data")), strict=True):
                s = np.frombuffer(data, np.uint64)
                if a is None:
                    now, own = (b, g), s
                    continue
                if now != (b, g):
                    raise ValueError("a group lacks the set that it is compared with")
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                both = int((own[at] == s).sum())
                if UNDER * both >= OVER * (len(own) + len(s) - both):
                    found.append((a, b))
            cols = [pa.array([f[i] for f in found], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b"])

    sets = rows.select("class", "_text", "jobs", "groups").mapInArrow(send, "b long, g int, a long, data binary")
    # a class may have several documents of the same id and text; one of them is enough, and more do no harm
    sets = sets.repartition("b", "g").sortWithinPartitions(F.col("b"), F.col("g"), F.col("a").asc_nulls_first())
    links = written(sets.mapInArrow(compare, "a long, b long").distinct(), "links")
    discard(pairs, wanted)
    return links


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every document."""
    return grouped(docs, id_col, text_col).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "doc", "id").alias("component_id")
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark): of each group of documents that links reach the one with the smallest id, nulls last; no empty one.

    mark is xxhash64 of the text, by which an id that stands on several texts names each of them.
    """
    found = grouped(docs, id_col, text_col)
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")).alias("d")
    return found.filter("n > 0").groupBy(F.coalesce("component", "class")).agg(least).select("d.id", "d.mark")


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, n, class, doc, component, least) of every document; its component is null if it links with no other set."""
    spark = docs.sparkSession
    seen = written(survey(docs, id_col, text_col), "survey")
    hot = spark.sparkContext.broadcast(frequent(seen))
    own = seen.filter("chunk IS NULL").select("id", "set_key", "n", "mark")
    # a class is named by its set until the end; its smallest id, if it has one, and a hash of the text find a text for it
    first_doc = F.min(F.struct(F.col("id").isNull(), F.col("id").alias("doc"), "mark"))
    classes = written(
        own.filter("n > 0").groupBy("set_key", "n").agg(first_doc.alias("d"))
        .select("set_key", "n", F.xxhash64("set_key", "n").alias("class"), "d.doc", "d.mark"),
        "classes",
    )
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK)
    shared = written(lists(scatter(docs, hot, blocks, text_col), blocks), "lists")
    name = classes.select("set_key", "n", "class")
    heads = name.select(F.col("set_key").alias("head"), F.col("n").alias("head_n"), F.col("class").alias("b"))

    # step 1: each class with the smallest of its lists, and with the one that is most often so, most common, or last
    def met(head: str) -> DataFrame:
        own = shared.select("set_key", "n", F.col(head).alias("head"), F.col(f"{head}_n").alias("head_n"))
        return own.filter("set_key <> head OR n <> head_n").groupBy("set_key", "n", "head", "head_n").agg(F.count("*").alias("c"))

    def most(meets: DataFrame) -> DataFrame:
        some = meets.filter(_fit("n", "head_n") & (F.col("c") * 3 >= F.least(_slack("n"), _slack("head_n"))))
        return some.groupBy("set_key", "n").agg(F.max(F.struct("c", "head", "head_n")).alias("m")).select("set_key", "n", "m.*")

    def named(meets: DataFrame) -> DataFrame:
        return meets.join(name, ["set_key", "n"]).join(heads, ["head", "head_n"])

    meets = written(named(met("head")), "meets")
    enough = F.col("c") >= F.least(_slack("n"), _slack("head_n"))
    texts = classes.select("class", "doc", "mark")
    often = [most(meets.select("set_key", "n", "head", "head_n", "c")), most(met("common")), most(met("last"))]
    first = meets.filter(enough & _fit("n", "head_n")).select(F.col("class").alias("a"), "b")
    for x in often:
        first = first.unionByName(named(x).select(F.col("class").alias("a"), "b"))
    links = verified(first, texts, docs, id_col, text_col)
    parts = written(components(links), "parts")

    # step 2: classes that meet enough heads of other components, with all of their lists
    of = parts.select(F.col("node").alias("class"), F.col("component").alias("p"))
    of_head = parts.select(F.col("node").alias("b"), F.col("component").alias("q"))
    apart = meets.join(of, "class", "left").join(of_head, "b", "left").filter(
        F.coalesce("p", "class") != F.coalesce("q", "b")
    )
    least = F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * OVER / UNDER) / 10))
    members = apart.groupBy("set_key", "n", "class").agg(F.sum("c").alias("c"))
    outside = apart.groupBy(F.col("head").alias("set_key"), F.col("head_n").alias("n"), F.col("b").alias("class")).agg(F.sum("c").alias("c"))
    # a head never meets itself, so what others of its lists meet it with counts for it too
    active = (
        members.unionByName(outside).groupBy("set_key", "n", "class").agg(F.sum("c").alias("c")).filter(F.col("c") * 2 >= least)
    )
    active = written(active.join(of, "class", "left").select("set_key", "n", "class", F.coalesce("p", "class").alias("p")), "active")
    if active.limit(1).count():
        mine = shared.select("shingle", "set_key", "n", "place").join(active, ["set_key", "n"]).select("shingle", "n", "class", "p", "place")
        mine = written(mine, "mine")
        full = shared.select("shingle", "set_key", "n", "place").join(mine.select("shingle").distinct(), "shingle", "left_semi")
        full = full.join(name, ["set_key", "n"]).join(of, "class", "left").select(
            "shingle", F.col("n").alias("m"), F.col("class").alias("other"), F.coalesce("p", "class").alias("q"), F.col("place").alias("there")
        )
        full = written(full, "full")
        # a list of one component makes no pair, however long it is
        several = full.groupBy("shingle").agg(F.min("q").alias("low"), F.max("q").alias("high")).filter("low <> high").select("shingle")
        full = full.join(several, "shingle", "left_semi")
        # sets of n and m that link share t shingles, and so share k of those that stand before n - t + k and m - t + k
        k, t = F.expr("greatest(1, least(n, m) div 60)"), F.expr("(3 * (n + m) + 6) div 7")
        sent_n, sent_m = (F.expr(f"{x} - (3 * {x} + 3) div 4 + greatest(1, {x} div 10)") for x in ("n", "m"))
        early = (F.col("place") * sent_n < (F.col("n") - t + k) * 255) & (F.col("there") * sent_m < (F.col("m") - t + k) * 255)
        pairs = (
            mine.join(full, "shingle").filter((F.col("p") != F.col("q")) & _fit("n", "m") & early)
            .groupBy("class", "other", "n", "m").agg(F.count("*").alias("c"))
            .filter(F.col("c") >= k)
            .select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"))
        )
        links = links.unionByName(verified(pairs, texts, docs, id_col, text_col))
        parts = written(components(links), "parts")
    discard(shared, meets, active)
    found = parts.join(texts.select(F.col("class").alias("node"), "doc"), "node")
    least = written(found.groupBy("component").agg(F.min("doc").alias("least")), "least")
    named_parts = parts.join(least, "component").select(F.col("node").alias("class"), "component", "least")
    by_set = classes.select("set_key", "n", "class", "doc").join(named_parts, "class", "left")
    return own.join(by_set, ["set_key", "n"], "left").drop("set_key")
