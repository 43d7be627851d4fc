"""A Merkle manifest of a dataset: one tree for each group of rows, and one over the groups' roots.

Leaves are hashed where the rows are read, so that only digests are ever shuffled. They are sorted by group and
id into partitions, and a count of each group in each partition gives every leaf its index. A task takes the
leaves of one group in one partition, a *segment*, and keeps a stack with one unfinished run for each level: a
run of FANOUT nodes that is full, or the last one of its level, is hashed and carried up, and no run is padded.
Runs that cross segments can't be finished there; their nodes come out as peaks, at most 2 * (FANOUT - 1) for
each level of a segment, and are merged level by level in groups of at most FANOUT rows.

A proof needs, for each level, the run of the leaf's ancestor. A segment has its inner runs itself and gets the
at most two outer ones of each level by a join, so that proofs of all leaves cost one more pass over digests.

Defined results: a null value is hashed as ``-``; null ids come first, and rows that repeat an id are leaves of
their own, in the order of their digests; the null group comes before all others; a group of one leaf has that
leaf for its root, and a single group's root is the dataset's; an empty table gives no rows. Only the named
columns are read, so that others may have any name.
Ids are integers: they are cast, and one that can't be raises.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odweave.llm.common import discard, written

FANOUT = 16
#: Leaves of a partition, about.
ROWS = 250_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*values: Column) -> Column:
    """The digest of a row, in bytes; each value is written as its length in bytes, a colon and itself, or as ``-``."""
    text = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered_row(id_: Column) -> Column:
    """Whether the row is one of the fifth that the check tampers with."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def digest(run: list[bytes]) -> bytes:
    """The digest of a run of nodes, which are hashed as hex text."""
    return sha256(b"".join([x.hex().encode() for x in run])).digest()


def widths(total: int, fanout: int) -> list[int]:
    """Nodes of each level of a tree, from its leaves to its root."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Range:
    """A stack over leaves from an index of one tree onwards: the runs that it has finished, and the peaks that are left."""

    def __init__(self, start: int, total: int, fanout: int):
        self.fanout, self.start, self.widths = fanout, start, widths(total, fanout)
        self.open: list[list[bytes]] = [[] for _ in self.widths]
        self.first = [0] * len(self.widths)
        self.next = start
        self.runs: dict[tuple[int, int], list[bytes]] = {}
        self.peaks: list[tuple[int, int, bytes]] = []

    def push(self, node: bytes) -> None:
        """The next leaf; runs that it finishes are carried up."""
        level, index = 0, self.next
        self.next += 1
        while True:
            held = self.open[level]
            if not held:
                self.first[level] = index
            held.append(node)
            last = index + 1 == self.widths[level]
            if len(self.widths) == level + 1 or not last and (index + 1) % self.fanout:
                return
            run, first = index // self.fanout, self.first[level]
            self.open[level] = []
            if first != run * self.fanout:  # it began in an earlier segment
                self.peaks += [(level, first + i, x) for i, x in enumerate(held)]
                return
            self.runs[level, run] = held
            node, level, index = digest(held), level + 1, run

    def finish(self) -> list[tuple[int, int, bytes]]:
        """(level, index, digest) of every node whose run isn't finished here, the root too."""
        for level, held in enumerate(self.open):
            self.peaks += [(level, self.first[level] + i, x) for i, x in enumerate(held)]
        return self.peaks


@dataclass
class Forest:
    """Trees over sorted leaves: leaves and segments with their places, nodes, runs that cross segments, and roots."""

    leaves: DataFrame
    segments: DataFrame
    nodes: DataFrame
    runs: DataFrame
    roots: DataFrame
    fanout: int


def _filled(run: Range, digests: list[bytes]) -> Range:
    for d in digests:
        run.push(d)
    return run


def grow(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> Forest:
    """The trees of leaves (tree, digest, ...), each with its leaves in the order of some columns.

    ``leaves`` is a written table. ``nodes`` has (tree, level, index, digest) of what tasks finished themselves.
    """
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(leaves.count() / ROWS))
    keys = ["tree", *order, "_place"]
    dealt = leaves.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    own = written(
        dealt.drop("_place").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "leaves"
    )
    discard(leaves)
    counts = own.groupBy("part", "tree").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    segments = written(
        counts.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("tree")).alias("total")),
        "segments",
    )

    def stack(key: tuple, rows: pa.Table, place: pa.Table) -> pa.Table:
        at = place.to_pylist()[0]
        r = _filled(Range(at["start"], at["total"], fanout), rows.sort_by("row")["digest"].to_pylist())
        peaks = [(*p, True) for p in r.finish()]
        inner = [(level + 1, i, digest(x), False) for (level, i), x in r.runs.items()]
        seen = {p[:2] for p in peaks}
        out = [*peaks, *(x for x in inner if x[:2] not in seen)]
        types = (pa.int32(), pa.int64(), pa.binary(), pa.bool_())
        cols = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
        n = len(out)
        return pa.table([pa.array([at["tree"]] * n), pa.array([at["total"]] * n, pa.int64()), *cols], ["tree", "total", "level", "index", "digest", "peak"])

    small = own.select("part", "tree", "row", "digest").groupBy("part", "tree")
    made = small.cogroup(segments.groupBy("part", "tree")).applyInArrow(
        stack, "tree string, total long, level int, index long, digest binary, peak boolean"
    )
    nodes = written(made, "nodes")
    most = segments.agg(F.max("total")).first()[0] or 0
    # nodes of a tree of n leaves at a level: ceil(n / fanout ** level); a level of one node is the root's
    width = lambda level: F.ceil(F.col("total") / F.lit(fanout**level))
    runs, roots, carried = [], [], None
    for level in range(len(widths(max(most, 1), fanout))):
        here = nodes.filter(F.col("peak") & (F.col("level") == level)).select("tree", "total", "index", "digest")
        here = here if carried is None else here.unionByName(carried)
        roots.append(here.filter(width(level) == 1).select("tree", "digest"))
        up = F.floor(F.col("index") / fanout).alias("run")
        of_run = F.sort_array(F.collect_list(F.struct("index", "digest")))
        run = here.filter(width(level) > 1).groupBy("tree", "total", up).agg(F.transform(of_run, lambda x: x["digest"]).alias("digests"))
        run = written(run, "runs")
        runs.append(run.withColumn("level", F.lit(level)))
        text = F.array_join(F.transform("digests", lambda d: F.lower(F.hex(d))), "")
        carried = run.select("tree", "total", F.col("run").alias("index"), F.unhex(F.sha2(text, 256)).alias("digest"))
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    return Forest(own, segments, nodes, union(runs), union(roots), fanout)


def all_nodes(forest: Forest) -> DataFrame:
    """(tree, level, index, digest) of every inner node, those that cross segments too."""
    text = F.array_join(F.transform("digests", lambda d: F.lower(F.hex(d))), "")
    across = forest.runs.select("tree", (F.col("level") + 1).alias("level"), F.col("run").alias("index"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return forest.nodes.filter("level > 0").select("tree", "level", "index", "digest").unionByName(across)


def outer_runs(forest: Forest) -> DataFrame:
    """Segments with ``outer``: the runs (level, run, digests) on the paths of their leaves that they don't have themselves."""
    power = lambda level: F.pow(F.lit(forest.fanout).cast("double"), level)
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log(F.col("total").cast("double")) / F.log(F.lit(float(forest.fanout)))).cast("int"), F.lit(1)))
    each = forest.segments.withColumn("level", F.explode(levels))
    first, last = F.col("start"), F.col("start") + F.col("n") - 1
    ends = F.array_distinct(F.array(*[F.floor(x / power(F.col("level") + 1)) for x in (first, last)]))
    wanted = each.select("part", "tree", "level", F.explode(ends).alias("run"))
    found = wanted.join(forest.runs.drop("total"), ["tree", "level", "run"])
    outer = found.groupBy("part", "tree").agg(F.collect_list(F.struct("level", "run", "digests")).alias("outer"))
    return forest.segments.join(outer, ["part", "tree"], "left")


def _own_runs(rows: pa.Table, at: dict, fanout: int) -> Range:
    r = _filled(Range(at["start"], at["total"], fanout), rows["digest"].to_pylist())
    r.runs.update({(x["level"], x["run"]): x["digests"] for x in at["outer"] or []})
    return r


class Paths:
    """Siblings on the way from leaves to the root, as hex text; the way above a run is kept for its next leaf."""

    def __init__(self, runs: Range, above: list[tuple[bytes, bytes]]):
        self.runs, self.above = runs, above
        self.kept: dict[int, tuple[int, list]] = {}

    def __call__(self, index: int, level: int = 0) -> list[tuple[bytes, bytes]]:
        """(nodes before, nodes behind) for each level from this one to the root."""
        if level + 1 >= len(self.runs.widths):
            return self.above
        run, at = divmod(index, self.runs.fanout)
        known = self.kept.get(level)
        if known is None or known[0] != run:
            text = [x.hex().encode() for x in self.runs.runs[level, run]]
            known = self.kept[level] = (run, text, self(run, level + 1))
        _, text, rest = known
        return [(b"".join(text[:at]), b"".join(text[at + 1 :])), *rest]


PATHS = "array<struct<before: binary, behind: binary>>"


def root_paths(forest: Forest) -> DataFrame:
    """(name, digest, path) of every leaf of a forest of one tree, whose leaves have a ``name``."""
    fanout = forest.fanout

    def run(key: tuple, rows: pa.Table, place: pa.Table) -> pa.Table:
        rows, at = rows.sort_by("row"), place.to_pylist()[0]
        path = Paths(_own_runs(rows, at, fanout), [])
        made = [[{"before": a, "behind": b} for a, b in path(at["start"] + i)] for i in range(len(rows))]
        kind = pa.list_(pa.struct([("before", pa.binary()), ("behind", pa.binary())]))
        return pa.table([rows["name"].combine_chunks(), rows["digest"].combine_chunks(), pa.array(made, kind)], ["name", "digest", "path"])

    own = forest.leaves.groupBy("part", "tree").cogroup(outer_runs(forest).groupBy("part", "tree"))
    return own.applyInArrow(run, f"name string, digest binary, path {PATHS}")


def proven(forest: Forest, upper: DataFrame, root: bytes) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of every leaf; upper has the path above each tree's root."""
    fanout = forest.fanout

    def run(key: tuple, rows: pa.Table, place: pa.Table) -> pa.Table:
        rows, at = rows.sort_by("row"), place.to_pylist()[0]
        path = Paths(_own_runs(rows, at, fanout), [(x["before"], x["behind"]) for x in at["path"]])
        proofs, folded = [], []
        for i, (leaf, false) in enumerate(zip(rows["digest"].to_pylist(), rows["tampered"].to_pylist(), strict=True)):
            ways, node = path(at["start"] + i), (leaf if false is None else false).hex().encode()
            proofs.append(sha256(b"".join([x for way in ways for x in way])).hexdigest())
            for before, behind in ways:
                node = sha256(before + node + behind).hexdigest().encode()
            folded.append(node.decode())
        leaves, n = [x.hex() for x in rows["digest"].to_pylist()], len(rows)
        cols = [pa.array(leaves), pa.array([at["subroot"].hex()] * n), pa.array([root.hex()] * n), pa.array(proofs), pa.array(folded)]
        return pa.table([rows["doc_id"].combine_chunks(), *cols], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    places = outer_runs(forest).join(upper.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path"), "tree")
    own = forest.leaves.groupBy("part", "tree").cogroup(places.groupBy("part", "tree"))
    return own.applyInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id", text_col: str = "text", fanout: int = FANOUT) -> tuple[Forest, Forest]:
    """The trees of all groups, and the tree over their roots, whose leaves are named by ``=`` and the group (empty: null)."""
    cols = {c: F.col(c) for c in fields}
    false = cols | {text_col: F.translate(text_col, UPPER, LOWER)}
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("tree"),
        F.col(id_col).cast("long").alias("doc_id"),
        leaf_digest(*cols.values()).alias("digest"),
        F.when(tampered_row(F.col(id_col)), leaf_digest(*false.values())).alias("tampered"),
    )
    groups = grow(written(leaves, "digests"), ["doc_id", "digest"], fanout)
    top = written(groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "roots")
    return groups, grow(top, ["name"], fanout)


def verified_rows(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id", text_col: str = "text", fanout: int = FANOUT) -> DataFrame:
    """Every row with its leaf, its group's root, the root, its proof, and the root that its proof gives after tampering.

    A row is tampered with as ``tampered_row`` says, by lower-casing the letters A to Z of its text.
    """
    groups, top = manifest(docs, fields, group_col, id_col, text_col, fanout)
    root = top.roots.first()  # one digest
    rows = proven(groups, root_paths(top), bytes(root["digest"]) if root else b"")
    return rows.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("doc_id", id_col)
