"""WARC archives: written with revisit records for repeated payloads, read back by boundary chains.

Reading splits archives into byte blocks. A task finds every place in its block where a record's magic
stands, and emits candidates: a place, its record's successor, and, by jumping pointers inside the block,
the first successor outside it. Pointer jumping over these from each file's start then keeps the places
that are reachable. Magic inside a payload is never reached, as its record isn't anyone's successor.

Defined results: columns but these three aren't read, and may have any name; null html is an empty payload; a null url is written empty; of rows with the same
payload, all with the largest page_id are responses (repeated rows included) and the others revisit it; a
null page_id is smaller than any; line breaks in a url become spaces; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.common import attempt_name, file_system, remove, scratch, written

MAGIC = b"WARC/1.0\r\n"
#: Bytes of a block that one task reads, of an archive before the next is begun, and of a header's first read.
BLOCK = 8 << 20
ARCHIVE = 256 << 20
HEADER = 16 << 10
#: Revisits known to be at most so many are broadcast to the writers (two ids and a digest of 40 letters, some 80 bytes
#: each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record of an archive."""
    name = "null" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').splitlines())}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with ``_main``: the page_id that a page revisits, null for a response.

    Payloads meet by digest and size only. The pages that revisit another are joined back: their number is
    counted first, and they are broadcast only up to BROADCAST_ROWS.
    """
    pages, body = pages.select("page_id", "url", "html"), F.coalesce(F.col("html"), F.lit(""))
    keys = pages.select("page_id", F.sha1(body).alias("_sha1"), F.octet_length(body).alias("_size")).filter(
        F.col("_size") >= min_bytes
    )
    mains = keys.groupBy("_sha1", "_size").agg(F.max("page_id").alias("_main"), F.count("*").alias("_n"))
    again = (
        keys.join(mains.filter("_n > 1"), ["_sha1", "_size"])
        .filter(~F.col("page_id").eqNullSafe(F.col("_main")))
        .select(F.col("page_id").alias("_page"), F.col("_sha1").alias("_digest"), "_main")
        .distinct()
    )
    again = written(again, "revisits")
    few = again.count() <= BROADCAST_ROWS
    joined = pages.withColumn("_sha1", F.sha1(body)).join(
        F.broadcast(again) if few else again,
        F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_sha1") == F.col("_digest")),
        "left",
    )
    return joined.drop("_page", "_digest", "_sha1")


def write_archives(roles: DataFrame, folder: str) -> DataFrame:
    """Write a record per page into archives in folder; (file, size) of each, from the attempts that ended well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name, out, size, k = attempt_name(), None, 0, 0
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    path = f"{name}-{k:04d}.warc"
                    out, size, k = fs.open_output_stream(f"{base}/{path}"), 0, k + 1
                main = row["_main"]
                made = record(row["page_id"], row["url"], (row["html"] or "").encode(), main, main is not None)
                out.write(made)
                size += len(made)
                if size >= ARCHIVE:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [path], "size": pa.array([size], pa.int64())})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [path], "size": pa.array([size], pa.int64())})

    return written(roles.select("page_id", "url", "html", "_main").mapInArrow(run, "file string, size long"), "archives")


def _header(f, at: int, size: int) -> tuple[dict, int] | None:
    """The fields of the record at a place and where its block starts, or None if no record is there."""
    want = HEADER
    while True:
        f.seek(at)
        head = f.read(min(want, size - at))
        if not head.startswith(MAGIC):
            return None
        end = head.find(b"\r\n\r\n")
        if end >= 0:
            break
        if len(head) < want:
            return None
        want *= 4
    fields = {}
    for line in head[len(MAGIC) : end].split(b"\r\n"):
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        fields[k.strip().lower()] = v.strip()
    if not fields.get(b"content-length", b"").isdigit():
        return None
    return fields, at + end + 4


def exits(places: np.ndarray, nexts: np.ndarray, stop: int) -> np.ndarray:
    """The first place at or beyond stop, or no candidate, on each candidate's chain; by pointer doubling."""
    at = np.searchsorted(places, nexts)
    known = (at < len(places)) & (nexts < stop)
    known[known] = places[at[known]] == nexts[known]
    jump = np.where(known, at, np.arange(len(places)))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return nexts[jump]
        jump = further


def candidates(blocks: DataFrame, folder: str) -> DataFrame:
    """(file, place, exit) of whatever looks like a record in the blocks (file, size, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for b in batches:
            for row in b.to_pylist():
                name, size, start = row["file"], row["size"], row["start"]
                stop = min(start + BLOCK, size)
                with fs.open_input_file(f"{base}/{name}") as f:
                    f.seek(start)
                    data = f.read(min(stop + len(MAGIC) - 1, size) - start)
                    places, nexts, i = [], [], data.find(MAGIC)
                    while i >= 0:
                        got = _header(f, start + i, size)
                        if got:
                            places.append(start + i)
                            nexts.append(got[1] + int(got[0][b"content-length"]) + 4)
                        i = data.find(MAGIC, i + 1)
                p, n = np.array(places, np.int64), np.array(nexts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(p), pa.string()), pa.array(p), pa.array(exits(p, n, stop))],
                    names=["file", "place", "exit"],
                )

    return blocks.mapInArrow(run, "file string, place long, exit long")


def reachable(cands: DataFrame) -> DataFrame:
    """(file, place) where a chain from the file's start enters a block; jumps double each round."""
    cands = written(cands, "candidates")
    entries = cands.select("file", F.col("exit").alias("place")).distinct()
    jump = cands.join(entries, ["file", "place"], "left_semi").unionByName(cands.filter("place = 0")).distinct()
    jump = written(jump, "jumps")
    known = jump.filter("place = 0").select("file", "place")
    n = known.count()
    while True:
        ahead = known.join(jump, ["file", "place"]).select("file", F.col("exit").alias("place"))
        ahead = ahead.join(jump.select("file", "place"), ["file", "place"], "left_semi")
        known = written(known.unionByName(ahead).distinct(), "known")
        if (more := known.count()) == n:
            return known
        n = more
        b = jump.select("file", F.col("place").alias("exit"), F.col("exit").alias("further"))
        jump = written(
            jump.join(b, ["file", "exit"], "left").select("file", "place", F.coalesce("further", "exit").alias("exit")),
            "jumps",
        )


#: Columns of a record that is read.
READ = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, digest_ok boolean"


def _page(field: bytes) -> int | None:
    name = field.strip(b"<>").rpartition(b":")[2]
    return None if name in (b"null", b"None", b"") else int(name)


def read_records(starts: DataFrame, folder: str) -> DataFrame:
    """The records of each block (file, size, place), followed from a place that is known to be a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for b in batches:
            for row in b.to_pylist():
                at, size, got = row["place"], row["size"], []
                stop = min((at // BLOCK + 1) * BLOCK, size)
                with fs.open_input_file(f"{base}/{row['file']}") as f:
                    while at < stop and (h := _header(f, at, size)):
                        fields, start = h
                        n = int(fields[b"content-length"])
                        f.seek(start)
                        http, _, body = f.read(n).partition(b"\r\n\r\n")
                        said = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
                        kind = fields[b"warc-type"].decode()
                        main = kind == "response"
                        made = digest(body) if main else said
                        refers = None if main else _page(fields[b"warc-refers-to"])
                        got.append((_page(fields[b"warc-record-id"]), kind, refers, made, len(body) if main else None, made == said))
                        at = start + n + 4
                names = [x.split()[0] for x in READ.split(", ")]
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
                cols = [pa.array([x[i] for x in got], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return starts.mapInArrow(run, READ)


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """All records of the archives (file, size) in folder; a revisit gets the size of what it revisits."""
    zero, step = F.lit(0).cast("long"), F.lit(BLOCK).cast("long")
    starts = F.explode(F.sequence(zero, F.col("size") - 1, step)).alias("start")
    spark = files.sparkSession
    n = spark.sparkContext.defaultParallelism * 4
    blocks = files.filter("size > 0").select("file", "size", starts).repartition(n, "file", "start")
    entries = reachable(candidates(blocks, folder))
    places = entries.join(files, "file").select("file", "size", "place").repartition(n, "file", "place")
    records = written(read_records(places, folder), "records")
    mains = (
        records.filter("record_type = 'response'")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("payload_bytes").alias("_bytes"))
    )
    again = records.filter("record_type = 'revisit'").drop("payload_bytes")
    full = again.join(mains, ["refers_to", "payload_digest"], "left").withColumnRenamed("_bytes", "payload_bytes")
    return records.filter("record_type = 'response'").unionByName(full)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives into the shared folder and read all records back; the archives then go."""
    folder = scratch(pages.sparkSession, "warc")
    records = read_archives(write_archives(with_roles(pages, min_bytes), folder), folder)
    remove(pages.sparkSession, folder)  # the records are written as a table
    return records
