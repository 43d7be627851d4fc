"""Near-duplicate vectors by p-stable hashing for Euclidean distance, with exact cosine checks.

Vectors are normalised, so that a cosine is a distance. A table hashes a vector by PROJECTIONS random
projections, each quantised to steps of WIDTH; vectors that share a bucket in any of TABLES tables are
compared exactly, in double precision. Copies of a vector are one class with a count. A large bucket is dealt
to blocks of pairs of chunks; a block gives sums of links and a spanning forest, never its pairs. A pair is
counted in the first table in which it meets.

Links may be missed (recall is measured in the tests and stated in the README), never invented.

Defined results: columns but the id and the vector aren't read, and may have any name; vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, and neither do rows with a null id (their component is null); rows that repeat an id are vectors of
their own, with the id as their name; vectors of different length link with nothing; an empty table gives an
empty table.
Ids are integers: they are cast, and one that can't be raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.common import written
from odweave.llm.components import components, forest

LEAST = 0.9
TABLES = 72
PROJECTIONS = 16
WIDTH = 2.0
SEED = 20240501
#: Vectors of a chunk; a block compares two chunks.
CHUNK = 1024
#: Rows that a task gathers before it compares them.
GATHER = 20_000


class Hashes:
    """The projections of all tables for vectors of one dimension."""

    def __init__(self, dim: int):
        r = np.random.default_rng(SEED + dim)
        self.a = r.normal(size=(dim, TABLES * PROJECTIONS)) / WIDTH
        self.b = r.uniform(size=TABLES * PROJECTIONS)
        self.mix = r.integers(1, 2**63, size=(TABLES, PROJECTIONS), dtype=np.int64) | 1

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        q = np.floor(unit @ self.a + self.b).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
        h = (q * self.mix[None]).sum(2)
        return (h ^ (h >> 29)) * np.int64(-0x61C8864680B583EB)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _good(v: list | None) -> bytes | None:
    """A vector as bytes, if it can link."""
    if not v or None in v:
        return None
    x = np.array(v, "<f8")
    return x.tobytes() if np.isfinite(x).all() and x.any() else None


def keyed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, key, vector): key is a digest of the vector, null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [_good(v) if i is not None else None for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            keys = [g and hashlib.blake2b(g, digest_size=16).digest() for g in good]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.binary()), pa.array(good, pa.binary())], names=["id", "key", "vector"]
            )

    return vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "id long, key binary, vector binary")


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def bucketed(classes: DataFrame) -> DataFrame:
    """(rep, dim, buckets): the bucket of each class in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, Hashes] = {}
        for b in batches:
            values = b.column("vector").to_pylist()
            dims = np.array([len(v) // 8 for v in values])
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                made = hashes.setdefault(d, Hashes(d))(unit(_matrix([values[i] for i in at])))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("rep").take(pa.array(at)),
                        pa.array(np.full(len(at), d, np.int32)),
                        pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), TABLES).cast(pa.list_(pa.int64())),
                    ],
                    names=["rep", "dim", "buckets"],
                )

    return classes.select("rep", "vector").mapInArrow(run, "rep long, dim int, buckets array<bigint>")


def _compare(t: pa.Table, hashes: dict[int, Hashes]) -> tuple[np.ndarray, ...]:
    """(rep, links, forest parent) from the rows of whole blocks."""
    block = np.concatenate([[True], np.zeros(len(t) - 1, bool)])
    for c in ("tab", "bucket", "low", "high", "dim"):
        v = t[c].to_numpy()
        block[1:] |= v[1:] != v[:-1]
    start = np.flatnonzero(block)
    size = np.diff(np.append(start, len(t)))
    rep, n, tab, dim = (t[c].to_numpy() for c in ("rep", "n", "tab", "dim"))
    chunk, low, high = (t[c].to_numpy() for c in ("chunk", "low", "high"))
    values = t["vector"].to_pylist()
    left, right = [], []
    for s, k in zip(start.tolist(), size.tolist(), strict=True):
        if k < 2:
            continue
        x = unit(_matrix(values[s : s + k]))
        i, j = np.nonzero(np.triu(x @ x.T >= LEAST - 1e-9, 1))
        if len(i):
            # the same sum for every pair, in whatever block it stands
            exact = np.einsum("ij,ij->i", x[i], x[j]) >= LEAST
            i, j = i[exact], j[exact]
        if low[s] != high[s]:  # pairs inside a chunk belong to the chunk's own block
            across = chunk[s + i] != chunk[s + j]
            i, j = i[across], j[across]
        if len(i) and tab[s] > 0:
            h = hashes.setdefault(int(dim[s]), Hashes(int(dim[s])))(x)[:, : tab[s]]
            first = np.ones(len(i), bool)
            for a in range(0, len(i), 100_000):
                p = slice(a, a + 100_000)
                first[p] = ~(h[i[p]] == h[j[p]]).any(1)
            i, j = i[first], j[first]
        left.append(s + i)
        right.append(s + j)
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    links = np.bincount(a, n[b], len(t)) + np.bincount(b, n[a], len(t))
    at = np.flatnonzero(links)
    return rep[at], links[at].astype(np.int64), rep[forest(len(t), a, b)][at]


def linked(classes: DataFrame) -> DataFrame:
    """(rep, links, parent): links of a class in one block, and a class of smaller place that it reaches there."""
    entries = bucketed(classes).select("rep", "dim", F.posexplode("buckets").alias("tab", "bucket"))
    sizes = entries.groupBy("dim", "tab", "bucket").agg(F.count("*").alias("size")).filter("size > 1")
    chunks = F.ceil(F.col("size") / F.lit(CHUNK)).cast("int")
    dealt = (
        entries.join(sizes, ["dim", "tab", "bucket"])
        .withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumn("low", F.least("chunk", "other"))
        .withColumn("high", F.greatest("chunk", "other"))
    )
    rows = dealt.join(classes.select("rep", "n", "vector"), "rep").select(
        "dim", "tab", "bucket", "low", "high", "chunk", "rep", "n", "vector"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, Hashes] = {}
        held: list[pa.RecordBatch] = []
        count = 0

        def out(t: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _compare(t, hashes)], names=["rep", "links", "parent"])

        keys = ("dim", "tab", "bucket", "low", "high")
        for b in batches:
            held.append(b)
            count += len(b)
            if count < GATHER:
                continue
            t = pa.Table.from_batches(held)
            same = np.ones(len(t), bool)
            for c in keys:
                v = t[c].to_numpy()
                same &= v == v[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield out(t.slice(0, cut))
            held, count = t.slice(cut).to_batches(), len(t) - cut
        if held:
            yield out(pa.Table.from_batches(held))

    keys = ["dim", "tab", "bucket", "low", "high"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, links long, parent long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    rows = written(keyed(vectors, id_col, vector_col), "vectors")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")
    )
    # an id that stands on several vectors names several classes: edges are between names, counts by key
    classes = written(classes.withColumn("name", F.col("rep")).withColumn("rep", F.xxhash64("key")), "classes")
    found = written(linked(classes), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    names = classes.select("rep", "name")
    edges = (
        found.filter("rep <> parent").select("rep", "parent").distinct()
        .join(names.withColumnRenamed("name", "a"), "rep")
        .join(names.select(F.col("rep").alias("parent"), F.col("name").alias("b")), "parent")
        .select("a", "b")
    )
    same_id = rows.filter("key IS NOT NULL").join(classes.select("key", "name"), "key").filter("id <> name")
    edges = edges.unionByName(same_id.select(F.col("id").alias("a"), F.col("name").alias("b")))
    parts = components(edges)
    out = (
        rows.select("id", "key")
        .join(classes.select("key", "rep", "n"), "key", "left")
        .join(links, "rep", "left")
        .join(parts, F.col("id") == F.col("node"), "left")
    )
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), 0).otherwise(F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce(F.when(F.col("n").isNotNull(), F.col("component")), F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
