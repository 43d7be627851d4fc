"""Byte-level BPE by a global shuffle of distinct words.

Texts are gathered in blocks. A block's texts are exploded into pre-tokens, each at its position, and its
distinct words, in the order of their first positions, are dealt by a hash of the word to buckets. All rows
of a bucket meet in one task, which encodes each of its distinct words once. The ids go back to the word's
block, in the order in which the words came, are joined to the block's pre-tokens, and put together by
position. A block sends a word once, so a frequent word has as many entries as there are blocks. Rows hold
compressed lists of words or ids, not single ones: a row for each pre-token would be many times the input.
Decoding looks each id up in the token-byte table, whose size is the vocabulary's.

Defined results: columns but the id and the text aren't read, and may have any name; null and empty texts have no ids; repeated rows and null ids stay; a text of any length is
in one block. A block is what a task reads one after another, twice: once for its words and once for its
texts. Both readings carry a checksum of the texts, and a difference between them (an input whose order
changes between attempts, which files don't) stops the job; write such an input as a table first.
Ids are integers: they are cast, and one that can't be raises.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.bpe import byte_bpe
from odweave.llm.common import stretches

#: Characters of texts in a block, and bytes of texts for each bucket that words are dealt to.
BLOCK = 5_000_000
BUCKET = 16_000_000
#: Tasks of a stage over buckets at most; with more buckets, a task takes several.
TASKS = 20_000

PACKED = "block long, bucket int, crc long, data binary"


def _id_type(ranks: dict[bytes, int]) -> str:
    """The type in which ids travel: 16 bits where they hold the vocabulary's."""
    return "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"


def _squeeze(*parts: bytes) -> bytes:
    return zstandard.compress(b"".join(parts), 3)


def _list(values: list[bytes]) -> bytes:
    """Byte strings in one: their number, lengths and bytes."""
    return _squeeze(np.array([len(values), *map(len, values)], "<u4").tobytes(), *values)


def _unlist(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "bucket", "crc", "data"]
    )


def _deal(texts: list[bytes], split, buckets: int) -> tuple[list[list[str]], list[bytes], np.ndarray]:
    """(pre-tokens of each text by position, distinct words by first position, the bucket of each word)."""
    tokens = [split(t.decode()) for t in texts]
    words = [w.encode() for w in dict.fromkeys(w for own in tokens for w in own)]
    return tokens, words, np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))


def _blocks(docs: DataFrame, make, id_col: str, text_col: str) -> DataFrame:
    """Rows that make(block, checksum, ids, texts) gives for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append((t or "").encode())
                size += len(t or "")
                if size >= BLOCK:
                    yield _rows(make(block, zlib.crc32(b"\n".join(texts)), ids, texts))
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield _rows(make(block, zlib.crc32(b"\n".join(texts)), ids, texts))

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, PACKED)


def explode_words(docs: DataFrame, raw: bytes, pattern: str, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(block, bucket, crc, data): the distinct words of each block and bucket."""

    def make(block: int, crc: int, ids: list, texts: list[bytes]) -> list[tuple]:
        _, words, bucket = _deal(texts, byte_bpe(raw, pattern).split, buckets)
        order = np.argsort(bucket, kind="stable")
        ordered = [words[i] for i in order.tolist()]
        parts = [(k, ordered[a:b]) for k, a, b in stretches(bucket[order])]
        return [(block, k, crc, _list(part)) for k, part in parts] or [(block, 0, crc, _list([]))]

    return _blocks(docs, make, id_col, text_col)


def encode_words(words: DataFrame, raw: bytes, pattern: str, buckets: int) -> DataFrame:
    """words with the ids of each word in its place; a bucket's task encodes each of its words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, done, kind = byte_bpe(raw, pattern).encode_piece, {}, _id_type(byte_bpe(raw, pattern).ranks)
        for b in batches:
            out = []
            for data in b.column("data").to_pylist():
                own = _unlist(data)
                for w in own:
                    if w not in done:
                        done[w] = np.array(encode(w), kind).tobytes()
                out.append(_list([done[w] for w in own]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], names=b.schema.names)

    return words.repartition(min(buckets, TASKS), "bucket").mapInArrow(run, PACKED)


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of many ranges, one after another."""
    end = np.cumsum(length)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - length), length)


def _texts(block: int, crc: int, ids: list, texts: list[bytes]) -> list[tuple]:
    known = np.array([x is not None for x in ids], np.uint8).tobytes()
    return [(block, None, crc, _list([np.array([x or 0 for x in ids], "<i8").tobytes(), known, *texts]))]


def encode(docs: DataFrame, raw: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids) of every text; ids are little-endian unsigned 32-bit integers."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)

    def assemble(head: pa.Table, body: pa.Table) -> pa.Table:
        body = body.sort_by("bucket")
        if len(head) != 1 or pc.unique(body["crc"]).to_pylist() != head["crc"].to_pylist():
            raise ValueError("a block's texts differ between two readings: write the input as a table first")
        doc_ids, known, *texts = _unlist(head["data"][0].as_py())
        tokens, words, bucket = _deal(texts, byte_bpe(raw, pattern).split, buckets)
        made = [x for data in body["data"].to_pylist() for x in _unlist(data)]
        size = np.empty(len(words), np.int64)
        order = np.argsort(bucket, kind="stable")
        kind = _id_type(byte_bpe(raw, pattern).ranks)
        lengths = np.fromiter(map(len, made), np.int64, len(made)) // np.dtype(kind).itemsize
        start = np.empty(len(words), np.int64)
        start[order], size[order] = np.cumsum(lengths) - lengths, lengths
        flat, index = np.frombuffer(b"".join(made), kind), {w.decode(): i for i, w in enumerate(words)}
        out, counts = [], []
        for own in tokens:
            code = np.fromiter(map(index.__getitem__, own), np.int64, len(own))
            ids = flat[gather(start[code], size[code])].astype("<u4")
            out.append(ids.tobytes())
            counts.append(len(ids))
        return pa.table(
            {
                "id": pa.array(np.frombuffer(doc_ids, "<i8"), pa.int64(), mask=np.frombuffer(known, np.uint8) == 0),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids": pa.array(out, pa.binary()),
            }
        )

    ids = encode_words(explode_words(docs, raw, pattern, id_col, text_col, buckets), raw, pattern, buckets)
    blocks = _blocks(docs, _texts, id_col, text_col).groupBy("block").cogroup(ids.groupBy("block"))
    return blocks.applyInArrow(assemble, "id long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, raw: bytes, pattern: str, ids_col: str = "ids") -> DataFrame:
    """encoded with ``decoded``: the bytes of each id from the token-byte table. A column of that name is replaced."""
    encoded = encoded.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = byte_bpe(raw, pattern).token_bytes().__getitem__
        for b in batches:
            got = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{fields}, decoded binary")
