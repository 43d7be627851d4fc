"""Token ids of a corpus in ORC files, in ascending order of document ids.

A row of a file is a piece of at most PIECE ids of one document, so that batches of writers and readers stay
small however long a text is. ORC writes ids with integer run lengths; row indexes and Bloom filters on the
document id let a reader skip stripes and groups of rows, and stripes are read in parallel.

Documents are dealt to files by ranges of ids, ties by their texts' hashes and their places, so that one id with
very many rows is cut too. ``row`` numbers documents in this order: the file's number above 33 bits, the place
in the file below. Reading needs sums of files, of which there are few, and of documents in a file.

Defined results: a null text is an empty one, which has just the end id; rows that repeat an id are documents of
their own; null ids come first; an empty table makes no rows. Other columns aren't read.
Ids are integers: they are cast, and one that can't be raises.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odweave.llm.bpe import level_bpe
from odweave.llm.common import remove, scratch, written

END = 0
#: Ids of a row at most.
PIECE = 4096
#: Bytes of texts for each file, about.
FILE = 256 << 20
#: Bits of ``row`` for the place in a file.
PLACES = 33

ROWS = "doc_id long, row long, piece int, ids array<int>"
OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
}


def pieces(docs: DataFrame, raw: bytes, id_col: str = "doc_id", text_col: str = "text", end: int = END, piece: int = PIECE) -> DataFrame:
    """(doc_id, row, piece, ids) of every text in ascending order of ids, each partition a range of them."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(size / FILE))
    keys = ["doc_id", "_tie", "_place"]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    own = own.select("*", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_place"))
    dealt = own.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, row, stop = level_bpe(raw).encode, TaskContext.get().partitionId() << PLACES, np.array([end], np.uint32)
        for b in batches:
            made = [np.concatenate([x, stop]) for x in encode(b.column(1).to_pylist())]
            length = np.array([len(x) for x in made], np.int64)
            n = -(-length // piece)
            first = np.cumsum(n) - n
            part = np.arange(int(n.sum())) - np.repeat(first, n)
            ends = np.minimum((part + 1) * piece, np.repeat(length, n)) + np.repeat(np.cumsum(length) - length, n)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(made).astype(np.int32)))
            at = pa.array(np.repeat(np.arange(len(made)), n))
            cols = [b.column(0).take(at), pa.array(np.repeat(row + np.arange(len(made)), n)), pa.array(part.astype(np.int32)), ids]
            row += len(made)
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "piece", "ids"])

    return dealt.mapInArrow(run, ROWS)


def write_tokens(docs: DataFrame, raw: bytes, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, **options: str) -> None:
    """Write all texts' ids as ORC files into folder; options are ORC's."""
    pieces(docs, raw, id_col, text_col, end).write.options(**OPTIONS | options).orc(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, row, piece, ids) of the files; a filter on doc_id skips stripes and groups of rows."""
    return spark.read.schema(ROWS).orc(folder)


#: Fixed value: the polynomial of CRC-32 as zlib has it, lowest power first.
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials over bits, modulo that of CRC-32; the highest bit is the power 0."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings one after another, from theirs and the second one's length."""
    shift, power = 0x80000000, 0x00800000  # 1, and the power 8
    while length:
        if length & 1:
            shift = _times(shift, power)
        power, length = _times(power, power), length >> 1
    return _times(shift, first) ^ second


def _read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, piece, n, crc): neighbouring pieces of a document as one."""
    for b in batches:
        row = b.column(1).to_numpy()
        if not len(row):
            continue
        ids = b.column(3)
        ends = ids.offsets.to_numpy()
        flat = np.asarray(ids.values).astype("<u4", copy=False)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        cuts = np.append(ends[first], ends[-1])
        crc = [zlib.crc32(flat[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        at = pa.array(first)
        cols = [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(np.diff(cuts).astype(np.int64)), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "piece", "n", "crc"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, n_tokens, ids_crc32) from the parts of each document."""
    for b in batches:
        n, crc = [], []
        for parts in b.column(2).to_pylist():
            total, value = 0, 0
            for p in parts:
                value = joined_crc(value, p["crc"], 4 * p["n"]) if total else p["crc"]
                total += p["n"]
            n.append(total)
            crc.append(value)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "row", "n_tokens", "ids_crc32"])


def documents_read(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of whole files, as read by ``read_tokens``."""
    parts = tokens.mapInArrow(_read_parts, "doc_id long, row long, piece int, n long, crc long")
    of_row = F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("parts")
    each = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), of_row).select("doc_id", "row", "parts")
    docs = written(each.mapInArrow(_whole, "doc_id long, row long, n_tokens long, ids_crc32 long"), "token-documents")
    docs = docs.withColumn("_file", F.shiftright("row", PLACES))
    files = docs.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(files, "_file").select("doc_id", (F.col("_start") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, raw: bytes, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every text, written into ORC files and read from there."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "token-orc")
    write_tokens(docs, raw, folder, id_col, text_col, end)
    tokens = read_tokens(spark, folder)
    out = documents_read(tokens)
    remove(spark, folder)  # what is left to do reads the documents' counts
    return out.withColumnRenamed("doc_id", id_col)
