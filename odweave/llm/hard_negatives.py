"""Hard negatives of anchors, by exact search over one-dimensional distance keys.

Components become integers, so that scores, which are inner products, are exact. A vector x of length |x| gets one
more component, sqrt(M - |x|^2) with M the largest |x|^2, and a query gets a 0 there: the squared distance between
them is then |q|^2 + M - 2 * score, and the highest scores are the nearest vectors. Every vector is stored under the
nearest of PIVOTS pivots, sorted by its distance to it, the key, and cut into blocks of a key interval each.

By the triangle inequality a block with keys a to b of a pivot at distance f from the query holds no vector nearer
than max(f - b, a - f) nor farther than f + b. A query asks for the first k scores in bands [low, high], which are
annuli. Its blocks, but those that lie inside all annuli, are taken in the order of their least distance, in rounds
that grow by STEPS: a round's scan raises the k-th score of each band, and blocks beyond the distance of that score
are never asked for. When a query has no block left, its answer is certified; none is ever approximate.

The stated queries, a fiftieth of all rows, meet the rows they need block by block: a task holds one block and up to
GROUP queries. What plans the rounds is 40 bytes for each block, at most about BLOCKS of them; pivots come from at
most SAMPLE rows (a bounded sample, which decides on speed only).

Defined results: rows with a null label, a null vector, a null or non-finite component, or a null id take no part;
rows that repeat an id are rows of their own, and so is each of them as an anchor; vectors of different length never
meet; equal scores and ids come in the order in which the rows are read; a score that isn't a 64-bit integer raises;
an empty table gives no rows. Only the named columns are read, so that others may have any name.
Ids are integers: they are cast, and one that can't be raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odweave.llm.common import discard, written

SCALE = 256
#: Pivots at most; there are no more than blocks.
PIVOTS = 32
#: Rows from which pivots are chosen, and passes that move a pivot to the mean of its rows.
SAMPLE = 1024
PASSES = 8
#: Rows of a block at least, and blocks at most (but for those that end with a pivot or a partition).
BLOCK = 2048
BLOCKS = 100_000
#: Rows of a partition of the index, and queries that meet a block in one task, about.
ROWS = 200_000
GROUP = 4096
#: Growth of the number of blocks that a query has met after each round.
STEPS = 8
#: Distances are taken for smaller by this share of the vectors' lengths, beyond any error of rounding.
SLACK = 1e-6

ANCHOR = 50
POSITIVES = 5
NEGATIVES = 3


def _matrix(values: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), dim) if dim else np.zeros((len(values), 0))


def integer_vectors(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(uid, vec_id, label, dim, square, vector) of the rows that take part; vectors as bytes of integral doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            ends, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            keep, dims, squares, out = [], [], [], []
            for i in range(len(b)):
                x = flat[ends[i] : ends[i + 1]]
                if np.isfinite(x).all():
                    x = np.floor(SCALE * x)
                    if not np.isfinite(x).all():
                        raise OverflowError("a component is too large for a score of 64 bits")
                    keep.append(i)
                    dims.append(len(x))
                    squares.append(float(x @ x))
                    out.append(x.astype("<f8").tobytes())
            at = pa.array(keep, pa.int64())
            cols = [b.column(0).take(at), b.column(1).take(at), pa.array(dims, pa.int32()), pa.array(squares, pa.float64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "dim", "square", "vector"])

    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = own.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    made = own.mapInArrow(run, "vec_id long, label long, dim int, square double, vector binary")
    return made.withColumn("uid", F.monotonically_increasing_id())


class Space:
    """The augmented space of vectors of all lengths: its largest square, and pivots for each length."""

    def __init__(self, most: float, sample: list[tuple[int, bytes]], pivots: int = PIVOTS):
        self.count = min(pivots, PIVOTS)
        self.bounded, self.most = bool(np.isfinite(most)), most if np.isfinite(most) else 0.0
        self.pivots = {d: self._chosen(self.lifted(_matrix([v for k, v in sample if k == d], d))) for d in {d for d, _ in sample}}

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with their additional component."""
        last = np.sqrt(np.maximum(0, self.most - (x * x).sum(1))) if self.bounded else np.zeros(len(x))
        return np.column_stack([x, last])

    def _chosen(self, x: np.ndarray) -> np.ndarray:
        """Rows far from each other, moved to the means of the rows that are nearest to them."""
        at, far = [0], np.linalg.norm(x - x[0], axis=1)
        while len(at) < self.count and far.max() > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(x - x[at[-1]], axis=1))
        p = x[at]
        for _ in range(PASSES):
            own = np.argmin([np.linalg.norm(x - q, axis=1) for q in p], axis=0)
            p = np.array([x[own == i].mean(0) if (own == i).any() else p[i] for i in range(len(p))])
        return p

    def far(self, x: np.ndarray) -> np.ndarray:
        """The distance of each lifted row to each pivot of its length; the origin serves a length without pivots."""
        if not self.bounded:
            return np.zeros((len(x), 1))
        p = self.pivots.get(x.shape[1] - 1)
        return np.stack([np.linalg.norm(x - q, axis=1) for q in (p if p is not None else np.zeros((1, x.shape[1])))], axis=1)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each length, and their vectors."""
    dims = b.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        own = b.take(pa.array(np.flatnonzero(dims == d)))
        yield own, _matrix(own.column("vector").to_pylist(), d)


def indexed(rows: DataFrame, space: Space, count: int) -> DataFrame:
    """rows with ``pivot``, ``key`` and ``block``, stored in the order of (pivot, key)."""
    names = ["uid", "vec_id", "label", "dim", "vector"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, x in _by_dim(b):
                far = space.far(space.lifted(x))
                at = far.argmin(1)
                cols = [pa.array(at.astype(np.int32)), pa.array(far[np.arange(len(far)), at])]
                yield pa.RecordBatch.from_arrays([*own.columns, *cols], names=[*names, "pivot", "key"])

    block = max(BLOCK, ceil(count / BLOCKS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        last, held, current = None, 0, (TaskContext.get().partitionId() << 32) - 1
        for b in batches:
            if not len(b):
                continue
            pair = np.stack([b.column("dim").to_numpy(), b.column("pivot").to_numpy()], axis=1)
            new = np.append(last is None or (pair[0] != last).any(), (pair[1:] != pair[:-1]).any(1))
            first = np.maximum.accumulate(np.where(new, np.arange(len(pair)), 0))
            place = np.arange(len(pair)) - first + np.where(np.cumsum(new) == 0, held, 0)
            ids = current + np.cumsum(new | (place % block == 0))
            last, held, current = pair[-1], int(place[-1]) + 1, int(ids[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids)], names=[*b.schema.names, "block"])

    schema = "uid long, vec_id long, label long, dim int, vector binary, pivot int, key double"
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(own, ceil(count / block)), ceil(count / ROWS))
    keys = ["dim", "pivot", "key", "vec_id", "uid"]
    made = rows.select(*names).mapInArrow(keyed, schema)
    return made.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(cut, schema + ", block long")


class Blocks:
    """The key intervals of all blocks, and which of them a query asks for in a round."""

    def __init__(self, space: Space, blocks: list[tuple[int, int, int, float, float]]):
        self.space, self.of = space, {}
        for d in {b[1] for b in blocks}:
            own = sorted(b for b in blocks if b[1] == d)
            self.of[d] = tuple(np.array([b[i] for b in own], kind) for i, kind in ((0, np.int64), (2, np.int64), (3, np.float64), (4, np.float64)))

    def wanted(self, dim: int, square: float, far: np.ndarray, bands: list[dict], first: int, end: int) -> np.ndarray:
        """Blocks from place ``first`` to ``end`` of the query's order that may hold a vector of a band.

        All but the bands' lower ends is the same in every round, and so is the order.
        """
        block, pivot, a, b = self.of[dim]
        if not self.space.bounded:
            return block[first:end]
        whole = square + self.space.most
        slack = SLACK * np.sqrt(whole)
        distance = lambda score: np.sqrt(max(0.0, whole - 2.0 * score))
        f = far[pivot]
        near = np.maximum(0, np.maximum(f - b, a - f)) - slack
        inner = min(0.0 if x["high"] is None else distance(x["high"]) for x in bands)
        outer = max(np.inf if x["low"] is None else distance(x["low"]) for x in bands)
        at = np.flatnonzero(f + b + slack >= inner)
        at = at[np.argsort(near[at], kind="stable")][first:end]
        return block[at[near[at] <= outer]]


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of integral vectors, exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ x.T).astype(np.int64)
    exact = [[sum(int(p) * int(q) for p, q in zip(u, v, strict=True)) for v in x.tolist()] for u in a.tolist()]
    return np.array(exact, np.int64)  # raises beyond 64 bits


def first_scores(scores: np.ndarray, allowed: np.ndarray, low: int | None, high: int | None, k: int) -> np.ndarray:
    """Places, among those allowed, of the first k scores from low to high; ties in the order of places."""
    own = scores[allowed]
    keep = np.ones(len(own), bool)
    if low is not None:
        keep &= own >= low
    if high is not None:
        keep &= own <= high
    at, own = allowed[keep], own[keep]
    if len(at) > k:
        top = own >= np.partition(own, len(own) - k)[len(own) - k]
        at, own = at[top], own[top]
    return at[np.lexsort((at, -own))[:k]]


BANDS = "array<struct<band: int, low: bigint, high: bigint>>"


def search(index: DataFrame, queries: DataFrame, bands: DataFrame, blocks: Blocks, k: int, same: bool) -> DataFrame:
    """(uid, band, score, vec_id, other): the first k rows, of the query's label or of others, in each band of each query.

    queries: (uid, grp, label, dim, square, vector, far); bands: (uid, band, low, high), ends included or null.
    """
    most = max((len(x[0]) for x in blocks.of.values()), default=0)
    rank = F.row_number().over(Window.partitionBy("uid", "band").orderBy(F.desc("score"), "vec_id", "other"))
    found, first, end = None, 0, 1
    while first < most:
        now = bands
        if found is not None:
            least = found.groupBy("uid", "band").agg(F.min("score").alias("_least"), F.count("*").alias("_n")).filter(F.col("_n") == k)
            now = bands.join(least, ["uid", "band"], "left").select("uid", "band", F.greatest("low", "_least").alias("low"), "high")
        own = now.filter("low IS NULL OR high IS NULL OR low <= high").groupBy("uid").agg(F.collect_list(F.struct("band", "low", "high")).alias("bands"))

        def plan(batches: Iterator[pa.RecordBatch], first: int = first, end: int = end) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims, squares, far, of = (b.column(c).to_pylist() for c in ("dim", "square", "far", "bands"))
                got = [blocks.wanted(d, s, np.array(f), x, first, end) for d, s, f, x in zip(dims, squares, far, of, strict=True)]
                at = pa.array(np.repeat(np.arange(len(got)), [len(x) for x in got]))
                cols = [pa.array(np.concatenate(got) if got else np.zeros(0, np.int64)), *[b.column(c).take(at) for c in ("grp", "uid", "label", "vector", "bands")]]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "grp", "uid", "label", "vector", "bands"])

        asked = written(
            queries.join(own, "uid").mapInArrow(plan, f"block long, grp int, uid long, label long, vector binary, bands {BANDS}"), "asked"
        )
        if asked.isEmpty():
            break

        def scan(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
            dim = right["dim"][0].as_py()
            ids, others, labels = (right[c].to_numpy() for c in ("vec_id", "uid", "label"))
            x, out = _matrix(right["vector"].to_pylist(), dim), []
            uids, own, of = left["uid"].to_pylist(), left["label"].to_pylist(), left["bands"].to_pylist()
            vectors = left["vector"].to_pylist()
            for at in range(0, len(left), 256):
                for j, s in enumerate(products(_matrix(vectors[at : at + 256], dim), x), at):
                    fits = (labels == own[j]) & (others != uids[j]) if same else labels != own[j]
                    allowed = np.flatnonzero(fits)
                    for band in of[j]:
                        out += [(uids[j], band["band"], int(s[i]), int(ids[i]), int(others[i])) for i in first_scores(s, allowed, band["low"], band["high"], k)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["uid", "band", "score", "vec_id", "other"])

        met = index.join(asked.select(*[F.col(c).alias(c) for c in ("block", "grp")]).distinct(), "block").select("block", "grp", "uid", "vec_id", "label", "dim", "vector")
        made = asked.groupBy("block", "grp").cogroup(met.groupBy("block", "grp")).applyInArrow(scan, "uid long, band int, score long, vec_id long, other long")
        made = made if found is None else made.unionByName(found)
        before, found = found, written(made.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank"), "found")
        discard(asked, *([before] if before is not None else []))
        first, end = end, end * STEPS
    return found if found is not None else bands.select("uid", "band", *[F.lit(0).cast("long").alias(c) for c in ("score", "vec_id", "other")]).limit(0)


def hard_negatives(
    rows: DataFrame,
    relabelled: int = 7,
    labels: int = 10,
    anchor: int = ANCHOR,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Anchors are rows whose id ``anchor`` divides; ids that ``relabelled`` divides get the next of ``labels`` labels.
    """
    label = F.col(label_col).cast("long")
    noisy = F.when(F.col(id_col).cast("long") % relabelled == 0, (label + 1) % labels).otherwise(label)
    own = rows.select(F.col(id_col).alias("vec_id"), noisy.alias("label"), F.col(vector_col).alias("vector"))
    all_ = written(integer_vectors(own, "vec_id", "label", "vector"), "integers")
    count, most = all_.agg(F.count("*"), F.max("square")).first()
    sample = all_.select("dim", "vector").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).collect()
    space = Space(most or 0.0, [(r["dim"], bytes(r["vector"])) for r in sample], ceil(count / BLOCK))
    index = written(indexed(all_, space, count), "index")
    places = index.groupBy("block").agg(F.first("dim"), F.first("pivot"), F.min("key"), F.max("key")).collect()  # bounded by BLOCKS
    blocks = Blocks(space, [tuple(r) for r in places])

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, x in _by_dim(b):
                far = space.far(np.column_stack([x, np.zeros(len(x))]))
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * far.shape[1])
                yield pa.RecordBatch.from_arrays([*one.columns, pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], names=[*one.schema.names, "far"])

    asking = all_.filter(F.col("vec_id") % anchor == 0)
    groups = max(1, ceil(asking.count() / GROUP))
    asking = asking.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asking.schema)
    queries = written(asking.mapInArrow(distances, f"{schema}, far array<double>"), "queries")
    discard(all_)
    anything = queries.select("uid", F.lit(0).alias("band"), *[F.lit(None).cast("long").alias(c) for c in ("low", "high")])
    found = search(index, queries, anything, blocks, positives, True)
    order = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "other")).cast("int")
    score = F.col("score")
    low, high = F.ceil(F.lit(50) * score.cast("decimal(38,0)") / 100), F.floor(F.lit(95) * score.cast("decimal(38,0)") / 100)
    pairs = written(
        found.select("uid", order.alias("band"), F.col("vec_id").alias("positive_id"), score.alias("positive_score"), low.cast("long").alias("low"), high.cast("long").alias("high")),
        "pairs",
    )
    hard = search(index, queries, pairs.select("uid", "band", "low", "high"), blocks, negatives, False)
    rank = F.row_number().over(Window.partitionBy("uid", "band").orderBy(F.desc("score"), "vec_id", "other")).cast("int")
    named = pairs.join(queries.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return hard.withColumn("rank", rank).join(named, ["uid", "band"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
