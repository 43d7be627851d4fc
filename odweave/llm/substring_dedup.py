"""Removal of byte strings that start in several places of a corpus, by suffix arrays of shards.

1. Every window of LENGTH bytes is filed under the smallest hash of the grams (a quarter of it) inside it.
   Equal windows have equal keys. A maximal run of windows of one key is a segment; copies of a segment in a
   block of documents are one entry, with their places. The block's columns go to a file, which later steps read.
2. All entries of a key meet in one bucket. Windows whose key stands once in the corpus are unique, unless it stands
   twice inside a segment. A key's only content that stands several times repeats as a whole. What is left, several contents of one key, is
   to be sorted, and one block sends the bytes of each such content.
3. A bucket's task joins whole keys to shards of SHARD bytes, leaves out windows whose hash stands once in a shard,
   builds the suffix array of the others by induced sorting, and reads repeats off the permuted common prefixes;
   contents that stand several times repeat themselves. Runs of repeated windows go back to the blocks, which remove the bytes that they cover.

A key with more than HOT contents (the edge of a passage that very many documents share) would make a large
shard. Its windows are counted one by one first, each under its own hash, and its segments are cut down to
runs of windows that repeat; what differs around the passage is gone then, and copies collapse.

Passages are found by shorter strings, of which those stay that have fewer than LENGTH bytes and touch PASSAGE_WORDS
words or fewer; over 50 words that take less than 200 bytes together (of three letters and less) aren't found. Where both
are asked for, the longer strings are looked for only inside what the shorter ones cover.

Defined results: null and empty texts, and texts shorter than LENGTH, lose nothing (null stays null); repeated
rows are documents of their own and so repeat each other; ids may be null; other columns pass through, those
named like the new ones are replaced; an empty table gives an empty one. Windows are filed by 64-bit hashes;
bytes decide between contents of a key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.common import attempt_name, discard, file_system, scratch, stretches, written
from odweave.llm.jaccard import BYTE, mix, powers
from odweave.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 400
#: A passage is a removed run of PASSAGE-byte strings that touches more than PASSAGE_WORDS words or has LENGTH bytes. The
#: first are fewer bytes than so many words usually take, so that they find the passage; then words decide, and in
#: writing without spaces, code or long links, which have few words, bytes do.
PASSAGE = 200
PASSAGE_WORDS = 50
#: Bytes of texts in a block, and for each bucket.
BLOCK = 5_000_000
BUCKET = 8_000_000
#: Window starts that are hashed at once, most windows of a segment, bytes of a shard (sorting takes 170 times as much memory).
SLICE = 1 << 19
MOST = 1024
SHARD = 500_000
#: Contents of a key from which its windows are counted one by one.
HOT = 500
#: Tasks of a stage over buckets at most; with more buckets, a task takes several, one after another.
TASKS = 20_000
BREAK = b"\xff"
#: Flags of a content: it repeats as a whole; it stands several times; it is to be sorted; this block sends it; hot.
WHOLE, SEVERAL, SORT, SEND, TOO_MANY = 1, 2, 4, 8, 16
#: Added to a segment's number of windows where it may repeat itself.
OWN = 1 << 15

ROWS = "block long, bucket int, data binary"
NEW = "n_bytes long, n_removed long, n_spans long, span_starts array<bigint>, span_ends array<bigint>"
PASSAGES = "n_passages long, passage_bytes long, without_passages string"


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays in one compressed byte string."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), level)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of pack."""
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw, "<i8", len(kinds), 8).tolist()
    at, out = 8 + 8 * len(kinds), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


ENTRY = ("<u8", "<u8", "<u2", "<u4", "<u4")  # key, content, windows, occurrences, and a place of each occurrence
REPLY = ("<u8", "<u8", "<u2", "u1", "<u4", "<u4")  # key, content, windows, flags, occurrences, places
PIECE = ("<u8", "<u8", "u1", "<u4", "u1")  # key, content, flags, size, bytes
RUNS = ("<u8", "<u4", "<u4", "<u4", "<u4", "<u4")  # content, occurrences, number of runs, places; starts and lengths of runs


def window_hashes(b: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key of each window, keys that stand at several places near by, what gives the hash of any substring).

    A gram that is the smallest of a window is so on one side of it at least, up to half a window away.
    """
    up, down = powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[b] * up, dtype=np.uint64)])
    gram = length // 4
    grams = low = mix((total[gram:] - total[:-gram]) * down[: len(b) - gram + 1])
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        if width <= (span + 1) // 2 < 2 * width:
            least = np.zeros(len(grams), bool)
            least[: len(low)] = grams[: len(low)] == low
            least[width - 1 :] |= grams[width - 1 :] == low
        low = np.minimum(low[:-width], low[width:])
        width *= 2
        if 2 * width > span and width <= (span + 1) // 2:
            least = np.ones(len(grams), bool)
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = np.flatnonzero(least)
    order = np.argsort(grams[at], kind="stable")
    value, at = grams[at][order], at[order]
    near = (value[1:] == value[:-1]) & (at[1:] - at[:-1] < MOST + span)
    return low, np.unique(value[1:][near]), total, down


def segments(b: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, windows, key, content) of all segments of texts that end at the given places of b.

    OWN is added to the windows of a segment that may hold a window twice.
    """
    out = []
    gone = np.zeros(len(b) + 1, np.int32)  # windows that cross an end
    np.add.at(gone, np.maximum(ends - length + 1, np.append(0, ends[:-1])), 1)
    np.add.at(gone, ends, -1)
    whole = np.cumsum(gone)[:-1] == 0
    for a in range(0, len(b) - length + 1, SLICE):
        z = min(a + SLICE, len(b) - length + 1)
        ok = whole[a:z]
        if not ok.any():
            continue
        key, twice, total, down = window_hashes(b[a : z + length - 1], length)
        first = ok.copy()
        first[1:] &= (key[1:] != key[:-1]) | ~ok[:-1]
        start = np.flatnonzero(first)
        edge = np.flatnonzero(first | ~ok)
        stop = np.append(edge, z - a)[np.searchsorted(edge, start) + 1]
        cuts = -(-(stop - start) // MOST)
        nth = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start, stop = np.repeat(start, cuts) + nth * MOST, np.repeat(stop, cuts)
        count = np.minimum(stop - start, MOST)
        content = mix((total[start + count + length - 1] - total[start]) * down[start] + count.astype(np.uint64))
        out.append((start + a, count | np.isin(key[start], twice) * OWN, key[start], content))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def grouped(key: np.ndarray, content: np.ndarray, count: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of distinct contents: key, content, windows, occurrences, places."""
    order = np.argsort(content, kind="stable")
    key, content, count, start = key[order], content[order], count[order], start[order]
    first = np.ones(len(order), bool)
    first[1:] = content[1:] != content[:-1]
    at = np.flatnonzero(first)
    return key[at], content[at], count[at], np.diff(np.append(at, len(order))), start


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of many ranges, one after another."""
    end = np.cumsum(length)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - length), length)


def _by_bucket(block: int, buckets: int, key, content, count, occurs, start) -> list[tuple]:
    """The rows of a block's entries."""
    of = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    place, rows = np.cumsum(occurs) - occurs, []
    for k, x, y in stretches(of[order]):
        o = order[x:y]
        where = start[ranges(place[o], occurs[o])]
        rows.append((block, k, pack(key[o].astype("<u8"), content[o].astype("<u8"), count[o].astype("<u2"), occurs[o].astype("<u4"), where.astype("<u4"))))
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    types = (pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["block", "bucket", "data"])


def _bytes(t: pa.Table, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, their ends)."""
    texts = [x or b"" for x in t[text_col].cast(pa.large_binary()).to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))


def _stored(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def _restored(place: bytes) -> pa.Table:
    """The columns of a block, from where survey has put them."""
    path, start, size = json.loads(place)
    fs, path = file_system(path)
    with fs.open_input_file(path) as f:
        f.seek(start)
        data = f.read(size)
    with pa.ipc.open_stream(zstandard.decompress(data)) as r:
        return r.read_all()


def survey(docs: DataFrame, text_col: str, length: int, buckets: int, folder: str) -> DataFrame:
    """Of each block of documents a row that says where its columns are (bucket -1), and rows with its entries.

    A task writes its blocks into one file of the shared folder, so that no later step shuffles texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        block, held, size, at, name = TaskContext.get().partitionId() << 32, [], 0, 0, attempt_name()

        def made(out) -> pa.RecordBatch:
            nonlocal at
            t = pa.Table.from_batches(held).combine_chunks()
            data = _stored(t)
            out.write(data)
            place = json.dumps([f"{folder}/{name}", at, len(data)]).encode()
            at += len(data)
            b, ends = _bytes(t, text_col)
            start, count, key, content = segments(b, ends, length)
            return _batch([(block, -1, place), *_by_bucket(block, buckets, *grouped(key, content, count, start))])

        with fs.open_output_stream(f"{base}/{name}") as out:
            for b in batches:
                held.append(b)
                size += b.column(b.schema.get_field_index(text_col)).nbytes
                if size >= BLOCK:
                    yield made(out)
                    block, held, size = block + 1, [], 0
            if held:
                yield made(out)

    return docs.mapInArrow(run, ROWS)


def judged(entries: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """The entries (block, bucket, data) that aren't unique, with flags."""

    def judge(t: pa.Table) -> pa.Table:
        got = [unpack(x, *ENTRY) for x in t["data"].to_pylist()]
        of = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        key, content, count, occurs = (np.concatenate([g[i] for g in got]) for i in range(4))
        order = np.lexsort((content, key))
        k, c, o = key[order], content[order], occurs[order].astype(np.int64)
        new_key, new = np.ones(len(k), bool), np.ones(len(k), bool)
        new_key[1:] = k[1:] != k[:-1]
        new[1:] = new_key[1:] | (c[1:] != c[:-1])
        key_at, at = np.flatnonzero(new_key), np.flatnonzero(new)
        of_key = np.cumsum(new_key) - 1
        total, contents = np.add.reduceat(o, key_at)[of_key], np.add.reduceat(new.astype(np.int64), key_at)[of_key]
        stands = np.add.reduceat(o, at)[np.cumsum(new) - 1]
        flags = np.where(contents == 1, WHOLE, np.where(contents > hot, TOO_MANY, SORT + SEND * new)) + SEVERAL * (stands > 1)
        alone = total < 2
        flags[alone] = np.where(count[order][alone] >= OWN, SORT + SEND, 0)
        flag = np.empty(len(k), np.uint8)
        flag[order] = flags
        rows = []
        for i, (g, block) in enumerate(zip(got, t["block"].to_pylist(), strict=True)):
            mine = flag[of == i]
            keep = np.flatnonzero(mine)
            if len(keep):
                n = g[3].astype(np.int64)
                where = g[4][ranges((np.cumsum(n) - n)[keep], n[keep])]
                rows.append((block, t["bucket"][0].as_py(), pack(g[0][keep], g[1][keep], g[2][keep] & (OWN - 1), mine[keep], g[3][keep], where)))
        return pa.Table.from_batches([_batch(rows)])

    return _dealt(entries, buckets).groupBy("bucket").applyInArrow(judge, ROWS)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """rows by bucket. Sorting costs far more than its bytes tell, so that the tasks are as many as the buckets."""
    return rows.repartition(min(buckets, TASKS), "bucket")


def _beside(texts: DataFrame, rows: DataFrame, buckets: int, run, kinds: str) -> DataFrame:
    """What run makes of each block's text and rows. The texts themselves are read by the tasks, which are as many as the buckets."""
    own, rows = (x.repartition(min(buckets, TASKS), "block") for x in (texts, rows))
    return own.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, kinds)


def _pieces(b: np.ndarray, replies: list[bytes], repeated: np.ndarray, length: int) -> dict[int, list[tuple]]:
    """By bucket the pieces (key, content, flags, occurrences, places, bytes) that a block sends to be sorted."""
    out: dict[int, list] = {}
    for bucket, data in replies:
        key, content, count, flags, occurs, where = unpack(data, *REPLY)
        place = np.cumsum(occurs.astype(np.int64)) - occurs
        mine = out.setdefault(bucket, [])
        for i in np.flatnonzero(flags & (SEND | TOO_MANY)).tolist():
            s, c = int(where[place[i]]), int(count[i])
            if flags[i] & SEND:
                mine.append((key[i], content[i], flags[i], None, b[s : s + c + length - 1]))
                continue
            again = np.isin(_each_window(b[s : s + c + length - 1], length), repeated)
            edge = np.flatnonzero(np.diff(again, prepend=False, append=False))
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                part = b[s + x : s + y + length - 1]
                mine.append((key[i], None, flags[i] & SEVERAL, where[place[i] : place[i] + occurs[i]] + x, part))
    return out


def _each_window(b: np.ndarray, length: int) -> np.ndarray:
    """The hash of every window."""
    up, down = powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[b] * up, dtype=np.uint64)])
    n = len(b) - length + 1
    return mix((total[length:] - total[:-length]) * down[:n])


def hot_windows(texts: DataFrame, hot: DataFrame, text_col: str, length: int, buckets: int) -> DataFrame:
    """(block, bucket -2, data): those windows of a block's hot segments that repeat in the corpus."""

    def each(text: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(replies):
            return pa.Table.from_batches([_batch([])])
        b, _ = _bytes(_restored(text["data"][0].as_py()), text_col)
        seen, block = [], text["block"][0].as_py()
        for data in replies["data"].to_pylist():
            _, _, count, flags, occurs, where = unpack(data, *REPLY)
            place = np.cumsum(occurs.astype(np.int64)) - occurs
            for i in np.flatnonzero(flags & TOO_MANY).tolist():
                h = _each_window(b[where[place[i]] : where[place[i]] + count[i] + length - 1], length)
                seen.append(np.repeat(h, min(2, int(occurs[i]))))
        if not seen:
            return pa.Table.from_batches([_batch([])])
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        return pa.Table.from_batches([_batch(_by_bucket(block, buckets, h, h, np.minimum(n, 2), np.zeros(len(h), np.int64), n[:0]))])

    def count(t: pa.Table) -> pa.Table:
        got = [unpack(x, *ENTRY) for x in t["data"].to_pylist()]
        h, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        total = np.bincount(at, np.concatenate([g[2] for g in got]))
        again = h[total > 1]
        rows = []
        for g, block in zip(got, t["block"].to_pylist(), strict=True):
            mine = g[0][np.isin(g[0], again)]
            if len(mine):
                rows.append((block, -2, pack(mine)))
        return pa.Table.from_batches([_batch(rows)])

    return _dealt(_beside(texts, hot, buckets, each, ROWS), buckets).groupBy("bucket").applyInArrow(count, ROWS)


def pieces(texts: DataFrame, live: DataFrame, text_col: str, length: int, buckets: int) -> DataFrame:
    """(block, bucket, data): the bytes of contents that are to be sorted."""

    def send(text: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(text) or not len(replies):
            return pa.Table.from_batches([_batch([])])
        b, _ = _bytes(_restored(text["data"][0].as_py()), text_col)
        rows = list(zip(replies["bucket"].to_pylist(), replies["data"].to_pylist(), strict=True))
        again = [unpack(d, "<u8")[0] for k, d in rows if k == -2]
        repeated = np.concatenate(again) if again else np.zeros(0, np.uint64)
        out, block = [], text["block"][0].as_py()
        for bucket, own in _pieces(b, [r for r in rows if r[0] >= 0], repeated, length).items():
            # hot pieces of the same bytes go once, with all places
            cut: dict[bytes, list] = {}
            for key, content, flags, where, part in own:
                if content is None:
                    cut.setdefault(part.tobytes(), []).append((key, flags, where))
                else:
                    cut[part.tobytes()] = [(key, flags | SORT, np.zeros(0, np.uint32), content)]
            if not cut:
                continue
            key = np.array([v[0][0] for v in cut.values()], "<u8")
            where = [np.concatenate([x[2] for x in v]) for v in cut.values()]
            content = np.array([v[0][3] if len(v[0]) > 3 else i for i, v in enumerate(cut.values())], "<u8")
            flags = np.array([v[0][1] | (SEVERAL if len(w) > 1 else 0) for v, w in zip(cut.values(), where, strict=True)], "u1")
            size = np.fromiter(map(len, cut), "<u4", len(cut))
            places = np.concatenate(where).astype("<u4")
            occurs = np.fromiter(map(len, where), "<u4", len(cut))
            out.append((block, bucket, pack(key, content, flags, size, np.frombuffer(b"".join(cut), "u1"), occurs, places, level=3)))
        return pa.Table.from_batches([_batch(out)])

    return _beside(texts, live, buckets, send, ROWS)


def repeats(contents: list[bytes], several: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, lengths) of the runs of repeated windows of each distinct content of a shard, by its suffix array.

    A window whose hash no other of the shard has is unique; the array is that of the runs of the other windows.
    """
    data = BREAK.join(contents) + BREAK
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    begin = np.cumsum(sizes + 1) - sizes - 1
    own = ranges(begin, sizes - length + 1)  # windows that a content holds whole
    whole = np.zeros(len(data), bool)
    whole[own] = True
    value = _each_window(np.frombuffer(data, np.uint8), length)[own]
    order = np.argsort(value)
    same = value[order[1:]] == value[order[:-1]]
    likely = np.zeros(len(data), bool)
    likely[own[order[1:][same]]] = True
    likely[own[order[:-1][same]]] = True
    again = np.zeros(len(data), bool)
    edge = np.flatnonzero(np.diff(likely, prepend=False, append=False))
    if len(edge):
        start, count = edge[::2], edge[1::2] - edge[::2]
        part = BREAK.join([data[x : x + n + length - 1] for x, n in zip(start.tolist(), count.tolist(), strict=True)]) + BREAK
        prefixes, before = common_prefixes(part, suffix_array(part))
        inner = ranges(np.cumsum(count + length) - count - length, count)
        found = inner[prefixes[inner] >= length]
        twice = np.zeros(len(part), bool)
        twice[found] = True
        twice[before[found]] = True
        again[ranges(start, count)] = twice[inner]
    at = np.repeat(np.arange(len(contents)), sizes + 1)
    again |= whole & several[at]
    edge = np.flatnonzero(np.diff(again, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    of = at[start]
    cuts = np.searchsorted(of, np.arange(len(contents) + 1))
    return [(start[x:y] - begin[i], stop[x:y] - start[x:y]) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]


def sort_shards(sent: DataFrame, live: DataFrame, length: int, buckets: int, shard: int = SHARD) -> DataFrame:
    """(block, bucket, data): for each block the runs of repeated windows of its contents."""

    def run(own: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        index: dict[bytes, int] = {}
        keys: list[int] = []
        several: list[bool] = []
        by_content: dict[int, int] = {}
        cut: list[tuple] = []  # of hot pieces: block, number, places
        for block, data in zip(own["block"].to_pylist(), own["data"].to_pylist(), strict=True):
            key, content, flags, size, raw, occurs, places = unpack(data, *PIECE, "<u4", "<u4")
            ends, stops, flat = np.cumsum(size), np.cumsum(occurs), raw.tobytes()
            for i in range(len(key)):
                part = flat[ends[i] - size[i] : ends[i]]
                at = index.get(part)
                if at is None:
                    at = index[part] = len(keys)
                    keys.append(int(key[i]))
                    several.append(bool(flags[i] & SEVERAL))
                else:
                    several[at] = True
                if flags[i] & SORT:
                    by_content[int(content[i])] = at
                else:
                    cut.append((block, at, places[stops[i] - occurs[i] : stops[i]]))
        values, found = list(index), [None] * len(keys)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        part, size = [], 0
        for n, i in enumerate(order):
            part.append(i)
            size += len(values[i])
            if n + 1 == len(order) or (size >= shard and keys[order[n + 1]] != keys[i]):
                for j, r in zip(part, repeats([values[j] for j in part], np.array([several[j] for j in part]), length), strict=True):
                    found[j] = r
                part, size = [], 0
        back: dict[int, list] = {}
        for block, data in zip(replies["block"].to_pylist(), replies["data"].to_pylist(), strict=True):
            _, content, count, flags, occurs, where = unpack(data, *REPLY)
            stops = np.cumsum(occurs)
            for i in np.flatnonzero(flags & (WHOLE | SORT)).tolist():
                places = where[stops[i] - occurs[i] : stops[i]]
                if flags[i] & WHOLE:
                    runs = (np.zeros(1, np.int64), count[i : i + 1].astype(np.int64))
                else:
                    runs = found[by_content[int(content[i])]]
                if len(runs[0]):
                    back.setdefault(block, []).append((places, *runs))
        for block, at, places in cut:
            if len(found[at][0]):
                back.setdefault(block, []).append((places, *found[at]))
        for block, got in back.items():
            start = np.concatenate([(p[:, None] + s[None]).ravel() for p, s, _ in got])
            size = np.concatenate([np.tile(n, len(p)) for p, _, n in got])
            rows.append((block, None, pack(start.astype("<u4"), size.astype("<u4"))))
        return pa.Table.from_batches([_batch(rows)])

    own, replies = _dealt(sent, buckets), _dealt(live, buckets)
    return own.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(run, ROWS)


def narrowed(texts: DataFrame, runs: DataFrame, text_col: str, shorter: int, length: int, buckets: int) -> DataFrame:
    """The entries (block, bucket, data) of windows of length bytes inside runs of shorter strings that repeat.

    A string that starts in two places holds shorter ones that do so, and they cover it: no other window repeats.
    """

    def run(text: pa.Table, found: pa.Table) -> pa.Table:
        if not len(found):
            return pa.Table.from_batches([_batch([])])
        b, ends = _bytes(_restored(text["data"][0].as_py()), text_col)
        start, stop = _spans(_covered(len(b), found["data"].to_pylist(), shorter), ends)
        long = stop - start >= length
        start, size = start[long], (stop - start)[long]
        at = np.cumsum(size)
        place, count, key, content = segments(b[ranges(start, size)], at, length)
        place = place + (start - (at - size))[np.searchsorted(at, place, side="right")]
        rows = _by_bucket(text["block"][0].as_py(), buckets, *grouped(key, content, count, place))
        return pa.Table.from_batches([_batch(rows)])

    return _beside(texts, runs, buckets, run, ROWS)


def _covered(n: int, found: list[bytes], length: int) -> np.ndarray:
    """Whether each of n bytes is in a window that repeats."""
    cover = np.zeros(n + 1, np.int32)
    for data in found:
        start, size = unpack(data, "<u4", "<u4")
        np.add.at(cover, start, 1)
        np.add.at(cover, start.astype(np.int64) + size + length - 1, -1)
    return np.cumsum(cover)[:-1] > 0


def _spans(gone: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the maximal runs of bytes that are gone, inside texts that end at the given places."""
    n = len(gone)
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    edge[0] = True
    first = np.flatnonzero(gone & (edge[:n] | ~np.append(False, gone[:-1])))
    last = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False))) + 1
    return first, last


def _touched(b: np.ndarray, ends: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The number of words that hold bytes of each span. White space and the ends of texts divide words."""
    word = (b != 32) & ((b < 9) | (b > 13))
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = ends[:-1][ends[:-1] < len(b)]
    begin[inner] = word[inner]
    total = np.append(0, np.cumsum(begin))
    return total[stop] - total[start] + (word[start] & ~begin[start])


def repeated_runs(texts: DataFrame, entries: DataFrame, text_col: str, length: int, hot: int, buckets: int) -> DataFrame:
    """(block, bucket, data): of each block the runs of windows that repeat, from the blocks' entries."""
    live = written(judged(entries, buckets, hot), "live")

    def too_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool((unpack(d, *REPLY)[3] & TOO_MANY).any()) for d in b.column("data").to_pylist()], pa.bool_()))

    hot_rows = live.mapInArrow(too_many, ROWS)
    told, used = live, [live]
    if hot_rows.limit(1).count():
        used.append(written(hot_windows(texts, hot_rows, text_col, length, buckets), "windows"))
        told = live.unionByName(used[-1])
    used.append(written(pieces(texts, told, text_col, length, buckets), "pieces"))
    runs = written(sort_shards(used[-1], live, length, buckets), "runs")
    discard(*used)
    return runs


def remove_repeats(
    docs: DataFrame,
    text_col: str = "text",
    length: int = LENGTH,
    hot: int = HOT,
    rewrite: bool = False,
    words: int = 0,
    passage: int | None = None,
) -> DataFrame:
    """docs with ``kept`` (the bytes that are left), counts, and the removed spans of each text (byte places).

    Spans that touch words or fewer words and have fewer than LENGTH bytes stay. With rewrite the text itself is what is left, without parts of
    characters, and there is no ``kept``. With passage, strings of so many bytes are found too, and
    ``n_passages``, ``passage_bytes`` and ``without_passages`` say what goes with those of their spans that touch
    more than PASSAGE_WORDS words or have LENGTH bytes.
    """
    new = (NEW if rewrite else f"kept binary, {NEW}") + (f", {PASSAGES}" if passage else "")
    docs = docs.drop(*[f.split()[0] for f in new.split(", ")])
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)
    folder = scratch(docs.sparkSession, "texts")
    rows = written(survey(docs, text_col, passage or length, buckets, folder), "blocks")
    texts = rows.filter("bucket = -1")
    runs = repeated_runs(texts, rows.filter("bucket >= 0"), text_col, passage or length, hot, buckets)
    found = runs.withColumn("bucket", F.lit(passage or length))
    if passage:
        runs = repeated_runs(texts, narrowed(texts, runs, text_col, passage, length, buckets), text_col, length, hot, buckets)
        found = found.unionByName(runs.withColumn("bucket", F.lit(length)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def apply(text: pa.Table, found: pa.Table) -> pa.Table:
        t = _restored(text["data"][0].as_py())
        b, ends = _bytes(t, text_col)
        begins = np.append(0, ends[:-1])
        null = t[text_col].is_null().to_pylist()
        by_length: dict[int, list[bytes]] = {}
        for n, data in zip(found["bucket"].to_pylist(), found["data"].to_pylist(), strict=True):
            by_length.setdefault(n, []).append(data)

        def left(n: int, least: int) -> tuple:
            """(bytes left of each text, spans, and where each text's spans begin)."""
            start, stop = _spans(_covered(len(b), by_length.get(n, []), n), ends)
            if least and len(start):
                many = (_touched(b, ends, start, stop) > least) | (stop - start >= LENGTH)
                start, stop = start[many], stop[many]
            gone = np.zeros(len(b) + 1, np.int32)
            gone[start] += 1
            np.add.at(gone, stop, -1)
            stay = np.cumsum(gone)[:-1] == 0
            return [b[x:y][stay[x:y]].tobytes() for x, y in zip(begins, ends, strict=True)], start, stop, np.searchsorted(start, np.append(begins, len(b)))

        def string(parts: list[bytes]) -> pa.Array:
            return pa.array([None if x else k.decode("utf-8", "ignore") for k, x in zip(parts, null, strict=True)], pa.string())

        kept, start, stop, at = left(length, words)
        if rewrite:
            t = t.set_column(t.schema.get_field_index(text_col), text_col, string(kept))
        else:
            t = t.append_column("kept", pa.array(kept, pa.binary()))
        own = [start[x:y] - z for x, y, z in zip(at, at[1:], begins, strict=False)], [stop[x:y] - z for x, y, z in zip(at, at[1:], begins, strict=False)]
        sizes = ends - begins
        cols = [sizes, sizes - np.fromiter(map(len, kept), np.int64, len(kept)), np.diff(at)]
        for name, col in zip(("n_bytes", "n_removed", "n_spans"), cols, strict=True):
            t = t.append_column(name, pa.array(col, pa.int64()))
        for name, col in zip(("span_starts", "span_ends"), own, strict=True):
            t = t.append_column(name, pa.array(col, pa.list_(pa.int64())))
        if passage:
            kept, _, _, at = left(passage, PASSAGE_WORDS)
            t = t.append_column("n_passages", pa.array(np.diff(at), pa.int64()))
            t = t.append_column("passage_bytes", pa.array(sizes - np.fromiter(map(len, kept), np.int64, len(kept)), pa.int64()))
            t = t.append_column("without_passages", string(kept))
        return t

    return _beside(texts, found, buckets, apply, f"{fields}, {new}")
