"""Best-fit decreasing packing of token sequences into windows.

A text is cut into full windows and a rest. The pieces are dealt by a hash of their document to groups, and
each group is packed longest piece first: a segment tree over remaining capacities finds the tightest open
window that takes the piece, or a new one is opened.

Defined results: a null text is an empty one and still has its end token; repeated rows and null ids are
documents of their own; an empty table gives no pieces. The number of groups follows the input, so that a group, which
costs 24 bytes a piece in its task (and the ids, if they are kept), has about PIECES_PER_GROUP pieces at most; pieces
are dealt by document, place and content, so that rows without an id meet only if their texts are the same. A group's
windows are as full as its pieces allow: some hundred documents leave under 1 % of padding.
Ids are integers: they are cast, and one that can't be raises.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.bpe import word_bpe

WINDOW = 4096
END = 2
#: Pieces of a group at most, about, and so many that its windows are full: with more pieces, Spark's own number of
#: partitions decides between the two.
PIECES_PER_GROUP = 1_000_000
ENOUGH = 5_000
#: Most sequences of a group, so that (group, sequence) is one integer.
PER_GROUP = 1 << 40

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


class Capacities:
    """A segment tree over the capacities 0 to size: which of them an open window has left."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        """A window has that much left."""
        self.windows[capacity].append(window)
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest window that has at least so much left."""
        i, count = self.leaves + least, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.windows[capacity].pop()


def pack(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths are in decreasing order and at most window."""
    n = len(lengths)
    sequence, offset = np.empty(n, np.int64), np.zeros(n, np.int64)
    full = int(np.searchsorted(-lengths, -window, side="right"))
    sequence[:full] = np.arange(full)
    tree, opened = Capacities(window), full
    for i, k in enumerate(lengths[full:].tolist(), full):
        got = tree.take(k)
        if got is None:
            sequence[i], left = opened, window
            opened += 1
        else:
            left, sequence[i] = got
            offset[i] = window - left
        if left > k:
            tree.add(left - k, int(sequence[i]))
    return sequence, offset


def cut(docs: DataFrame, raw: bytes, id_col: str, text_col: str, window: int, end: int, keep_ids: bool) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, and ids if asked for) of each piece of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = word_bpe(raw).encode, np.array([end], "<u4").tobytes()
        for b in batches:
            rows = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, data in zip(b.column(0).to_pylist(), encode(texts), strict=True):
                data += stop
                for at in range(0, len(data), 4 * window):
                    part = data[at : at + 4 * window]
                    rows.append((i, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4, part if keep_ids else None))
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            if keep_ids:
                cols.append(pa.array([r[5] for r in rows], pa.binary()))
            names = [id_col, *[x.split()[0] for x in PIECES.split(", ")], "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names[: len(cols)])

    schema = f"`{id_col}` long, {PIECES}" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, id_col: str, window: int, groups: int) -> DataFrame:
    """pieces with ``sequence_id`` and ``offset``, packed within each of some groups: the partitions of a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        all_ = list(batches)
        if not all_:
            return
        t = pa.Table.from_batches(all_)
        t = t.sort_by([("length", "descending"), (id_col, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = pack(t["length"].to_numpy(), window)
        base = TaskContext.get().partitionId() * PER_GROUP
        t = t.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))
        yield from t.combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(groups, F.xxhash64(id_col, "start", "ids_crc32", "doc_tokens")).mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    raw: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end: int = END,
    keep_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its sequence and its offset there; raw is a tokenizers file."""
    size, rows = docs.agg(F.sum(F.octet_length(text_col)), F.count("*")).first()
    # a document makes one piece, and one more for each window; a token has two bytes at least, but for odd texts
    most = rows + (size or 0) // (2 * window)
    groups = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), most // ENOUGH), ceil(most / PIECES_PER_GROUP))
    return pack_pieces(cut(docs, raw, id_col, text_col, window, end, keep_ids), id_col, window, groups)
