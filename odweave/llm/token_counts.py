"""Token counts of documents in flat token files without an index, by a scan for separators.

A file holds ids of 16 bits, or of 32 where the vocabulary or the separator needs them, each document's followed by
the separator. Files are cut into byte blocks; a task
searches its block for separators in one array comparison, and gives their number, the first, the last, and the
lengths between them. A prefix scan over a file's blocks, one row each, gives every block the number of
documents before it and where the open one began, which stitches documents that cross blocks.

Defined results: columns but the id and the text aren't read, and may have any name; null and empty texts have 0 tokens; the separator isn't counted; repeated rows and null ids
are documents of their own; tokens behind a file's last separator belong to no document; an empty table makes
no files.
Ids are integers: they are cast, and one that can't be raises.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odweave.llm.bpe import word_bpe
from odweave.llm.common import attempt_name, file_system, remove, scratch, written

SEPARATOR = 49407
#: Bytes of a block, and of a file before the next is begun.
BLOCK = 4 << 20
FILE = 128 << 20


def id_type(raw: bytes, separator: int) -> str:
    """The type of a file's ids: the least that holds all of a tokenizers file's, added ones too, and the separator."""
    spec = json.loads(raw)
    most = max(separator, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", [])))
    return "<u2" if most < 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, raw: bytes, folder: str, id_col: str, text_col: str, separator: int, kind: str = "<u2") -> DataFrame:
    """Write all texts' tokens into files in folder; (file, size, ids) of each, ids in the order of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        encode, end = word_bpe(raw, "text").encode, np.array([separator], kind).tobytes()
        name, out, ids, size, k = attempt_name(), None, [], 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "size", "ids"])

        for b in batches:
            made = encode([t or "" for t in b.column(1).to_pylist()])
            for i, data in zip(b.column(0).to_pylist(), made, strict=True):
                if out is None:
                    path, ids, size = f"{name}-{k:04d}.tokens", [], 0
                    out, k = fs.open_output_stream(f"{base}/{path}"), k + 1
                flat = np.frombuffer(data, "<u4").astype(kind).tobytes() + end
                out.write(flat)
                ids.append(i)
                size += len(flat)
                if size >= FILE:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "file string, size long, ids array<bigint>")
    return written(rows, "token-files")


def scan_blocks(files: DataFrame, folder: str, separator: int, block: int, kind: str = "<u2") -> DataFrame:
    """(file, start, n, first, last, inner): separators of each block by their place in tokens, and lengths between them."""
    width = np.dtype(kind).itemsize
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("start")
    tasks = files.sparkSession.sparkContext.defaultParallelism * 4
    blocks = files.filter("size > 0").select("file", "size", starts).repartition(tasks, "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                with fs.open_input_file(f"{base}/{r['file']}") as f:
                    f.seek(r["start"])
                    ids = np.frombuffer(f.read(min(block, r["size"] - r["start"])), kind)
                at = np.flatnonzero(ids == separator) + r["start"] // width
                ends = (int(at[0]), int(at[-1])) if len(at) else (None, None)
                rows.append((r["file"], r["start"], len(at), *ends, np.diff(at) - 1))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            cols = [pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "start", "n", "first", "last", "inner"])

    return blocks.mapInArrow(run, "file string, start long, n long, first long, last long, inner array<bigint>")


def count_tokens(files: DataFrame, folder: str, separator: int = SEPARATOR, block: int = BLOCK, kind: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the files (file, size) in folder; block is a multiple of an id's bytes."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    scanned = scan_blocks(files, folder, separator, block, kind)
    stitched = scanned.select(
        "*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("_open")
    ).filter("n > 0")
    lengths = F.concat(F.array(F.col("first") - F.col("_open")), "inner")
    each = stitched.select("file", "_before", F.posexplode(lengths).alias("_i", "n_tokens"))
    return each.select("file", (F.col("_before") + F.col("_i")).alias("ordinal"), "n_tokens")


def documents_counted(docs: DataFrame, raw: bytes, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """(id_col, n_tokens) of every text, written into token files and counted there."""
    folder, kind = scratch(docs.sparkSession, "tokens"), id_type(raw, separator)
    files = write_tokens(docs, raw, folder, id_col, text_col, separator, kind)
    ids = files.select("file", F.posexplode("ids").alias("_i", id_col)).withColumn("ordinal", F.col("_i").cast("long"))
    counts = written(count_tokens(files.select("file", "size"), folder, separator, block, kind), "token-counts")
    remove(docs.sparkSession, folder)
    # ids compress well, and would be broadcast for their small files
    return ids.join(counts.hint("merge"), ["file", "ordinal"], "left").select(id_col, "n_tokens")
