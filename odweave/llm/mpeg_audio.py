"""MPEG audio as a media column: a lossless container for bytes, and a scanner for any MPEG stream.

``store`` puts a payload into the ancillary bytes of silent MPEG-1 Layer III frames, with an ID3v2 tag,
a variable-bitrate table and a CRC in each frame. ``scan`` reads a stream of any MPEG version and layer:
it parses the tags, resynchronises on frame headers, verifies the checksums of all three layers and the
variable-bitrate table (Xing, Info or VBRI), and gives the exact duration, as a fraction of seconds that also
holds where the sample rate changes, and the byte offset of each frame. An ID3v2 tag counts when its header
and all of its frames are well-formed; other bytes ahead of audio are junk. Not read: frames of free bit rate,
and what encoders put behind a Xing table.

Columns named like those that are added are replaced. Defined results: a null text is an empty one and stored as 192 spaces; equal texts give equal values;
bytes that aren't MPEG audio scan to zero frames; other columns pass through.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
RATE = 48_000
SIDE_BYTES = 17
OWNER = b"payload\0"

# Fixed values of the format: kbit/s by (version 1, layer), then for versions 2 and 2.5.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Samples a second by version bits (0: 2.5, 2: 2, 3: 1).
RATES = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        v = byte << 8
        for _ in range(8):
            v = (v << 1) ^ 0x8005 if v & 0x8000 else v << 1
        table.append(v & 0xFFFF)
    return table


CRC_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of a frame: polynomial 0x8005, most significant bit first, from 0xFFFF."""
    v = 0xFFFF
    for b in data:
        v = ((v << 8) & 0xFF00) ^ CRC_TABLE[(v >> 8) ^ b]
    return v


def header_fields(b1: int, b2: int, b3: int) -> tuple | None:
    """(bytes, samples, rate, version, layer, has_crc, side_bytes) of a header, or None if it is none."""
    if b1 & 0xE0 != 0xE0:
        return None
    ver, layer, index, rate = (b1 >> 3) & 3, 4 - ((b1 >> 1) & 3), b2 >> 4, (b2 >> 2) & 3
    if ver == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    one, hz, pad = ver == 3, RATES[ver][rate], (b2 >> 1) & 1
    bits = KBPS[1 if one else 2, layer][index] * 1000
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    size = (12 * bits // hz + pad) * 4 if layer == 1 else samples // 8 * bits // hz + pad
    mono = b3 >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if one else 9 if mono else 17
    return size, samples, hz, 1 if one else 2 if ver == 2 else 2.5, layer, not b1 & 1, side


def _frames_by_size() -> list[tuple[int, bytes]]:
    """(capacity, start of the frame up to its ancillary bytes), smallest first, of the frames written."""
    out = []
    for index in range(1, 15):
        head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
        size = header_fields(*head[1:])[0]
        side = bytes(SIDE_BYTES)
        out.append((size - 6 - SIDE_BYTES, head + struct.pack(">H", crc16(head[2:] + side)) + side))
    return out


WRITTEN = _frames_by_size()
VBR_BYTES = 120


def _frame(data: bytes) -> bytes:
    for room, start in WRITTEN:
        if len(data) <= room:
            return start + data + bytes(room - len(data))
    raise ValueError("more than a frame holds")


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def pad(data: bytes) -> bytes:
    """data and spaces up to the next positive multiple of UNIT."""
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def store(payload: bytes) -> bytes:
    """An MPEG stream that carries payload."""
    most = WRITTEN[-1][0]
    body = [_frame(payload[i : i + most]) for i in range(0, len(payload), most)]
    sizes = np.cumsum([0, *map(len, body)])
    total = int(sizes[-1])
    places = sizes[:-1][(np.arange(100) * len(body)) // 100] if body else np.zeros(100, int)
    toc = bytes((places * 256 // max(total, 1)).tolist())
    start = len(_frame(bytes(VBR_BYTES)))
    vbr = b"Xing" + struct.pack(">III", 0xF, len(body), total + start) + toc + struct.pack(">I", 100)
    private = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    tag = b"PRIV" + _syncsafe(len(private)) + b"\0\0" + private
    return b"".join((b"ID3\x04\0\0", _syncsafe(len(tag)), tag, _frame(vbr), *body))


def _syncsafe_int(data: bytes) -> int | None:
    """The number in bytes of seven bits each, or None if a byte has eight."""
    n = 0
    for b in data:
        if b & 0x80:
            return None
        n = n << 7 | b
    return n


def id3v2(data: bytes) -> tuple[int, dict[str, bytes]] | None:
    """(bytes, frames) of a tag at the start of data, or None if none is there that is well-formed."""
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (2, 3, 4) or data[4] == 0xFF:
        return None
    version, flags, size = data[3], data[5], _syncsafe_int(data[6:10])
    if size is None or 10 + size > len(data):
        return None
    at, stop, found = 10, 10 + size, {}
    if flags & 0x40 and version > 2:
        extended = _syncsafe_int(data[10:14]) if version == 4 else int.from_bytes(data[10:14], "big") + 4
        if extended is None or extended > size:
            return None
        at += extended
    width = 3 if version == 2 else 4
    head = 6 if version == 2 else 10
    while at + head <= stop and data[at]:
        name, said = data[at : at + width], data[at + width : at + 2 * width]
        n = _syncsafe_int(said) if version == 4 else int.from_bytes(said, "big")
        if not all(48 <= b <= 57 or 65 <= b <= 90 for b in name) or n is None or at + head + n > stop:
            return None
        found[name.decode()] = data[at + head : at + head + n]
        at += head + n
    if data[at:stop].strip(b"\0"):
        return None
    return stop + (10 if version == 4 and flags & 0x10 else 0), found


def _tags(data: bytes) -> tuple[int, int, dict[str, bytes]]:
    """Where audio starts and ends, and the frames of an ID3v2 tag and an ID3v1 tag."""
    start, end, found = 0, len(data), {}
    if got := id3v2(data):
        start, found = min(got[0], end), dict(got[1])
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        found["TAG"] = data[end - 128 :]
        end -= 128
    return start, end, found


def _allocation_widths(version: float, hz: int, kbps: int, channels: int) -> list[int]:
    """Bits of each subband's allocation in a Layer II frame. Fixed values of the format."""
    if version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = kbps // channels
    if each < 56:
        return [4] * 2 + [3] * (10 if hz == 32_000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if hz == 48_000 or each <= 80 else 7)


def protected_bits(frame: bytes) -> int | None:
    """How many bits behind the checksum of a frame it covers, or None if the frame is too short for them.

    Layer I covers the allocation of 32 subbands, 4 bits each; Layer II that of its subbands and 2 bits for each
    channel of a subband that has any; Layer III the side information. Above the bound of joint stereo both
    channels share an allocation.
    """
    size, _, hz, version, layer, _, side = header_fields(*frame[1:4])
    if layer == 3:
        return 8 * side
    mode = frame[3] >> 6
    channels = 1 if mode == 3 else 2
    bound = 4 * ((frame[3] >> 4 & 3) + 1) if mode == 1 else 32
    if layer == 1:
        return 4 * (channels * min(bound, 32) + (32 - min(bound, 32)))
    widths = _allocation_widths(version, hz, KBPS[1 if version == 1 else 2, 2][frame[2] >> 4], channels)
    bits, left, scales = int.from_bytes(frame[6:size], "big"), 8 * (size - 6), 0
    total = left
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            left -= width
            if left < 0:
                return None
            scales += bool(bits >> left & (1 << width) - 1) * (1 if band < bound else channels)
    return total - left + 2 * scales


def checksum(frame: bytes) -> int | None:
    """The checksum that a frame ought to have."""
    n = protected_bits(frame)
    if n is None or n > 8 * (len(frame) - 6):
        return None
    v = crc16(frame[2:4] + frame[6 : 6 + n // 8])
    for k in range(n % 8):
        bit = frame[6 + n // 8] >> (7 - k) & 1
        v = (v << 1 ^ (0x8005 if (v >> 15) ^ bit else 0)) & 0xFFFF
    return v


def vbr_table(frame: bytes, body: int) -> dict | None:
    """The variable-bitrate table of a frame whose main data begins at body."""
    if frame[body : body + 4] in (b"Xing", b"Info"):
        flags, at = int.from_bytes(frame[body + 4 : body + 8], "big"), body + 8
        out = {"frames": None, "bytes": None, "toc": None}
        for bit, key, width in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
            if flags & bit:
                part = frame[at : at + width]
                out[key] = part if key == "toc" else int.from_bytes(part, "big")
                at += width
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", frame[46:62])
        toc = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"frames": frames, "bytes": size, "toc": toc}
    return None


def scan(data: bytes) -> dict:
    """What a stream holds. A frame counts when another one or the stream's end follows it."""
    start, end, tags = _tags(data)
    raw = np.frombuffer(data, np.uint8)
    sync = np.flatnonzero((raw[start : end - 3] == 0xFF) & (raw[start + 1 : end - 2] >= 0xE0)) + start
    at = {}
    for i in sync.tolist():
        f = header_fields(data[i + 1], data[i + 2], data[i + 3])
        if f:
            at[i] = f
    starts = [i for i in sorted(at) if i + at[i][0] == end or i + at[i][0] in at]
    offsets, bodies, lost, good, bad, unchecked, vbr = [], [], 0, 0, 0, 0, None
    pos, k, synced, follows = start, 0, False, set(starts)
    duration, rate, samples = Fraction(0), 0, 0
    while pos < end:
        f = at.get(pos)
        if f is None or pos + f[0] > end or not (synced or pos in follows):
            while k < len(starts) and starts[k] <= pos:
                k += 1
            to = starts[k] if k < len(starts) else end
            lost, pos, synced = lost + to - pos, to, True
            continue
        synced = True
        size, n, hz, _, layer, crc, side = f
        body = pos + 4 + 2 * crc + side
        frame = data[pos : pos + size]
        if crc:
            right = checksum(frame) == int.from_bytes(data[pos + 4 : pos + 6], "big")
            good, bad = good + right, bad + (not right)
        else:
            unchecked += 1
        table = vbr_table(frame, body - pos) if layer == 3 and not offsets and vbr is None else None
        if table:
            vbr = table | {"at": pos}
        else:
            offsets.append(pos)
            bodies.append((body, pos + size))
            duration += Fraction(n, hz)
            samples, rate = samples + n, hz
        pos += size
    out = {"offsets": offsets, "lost": lost, "crc_good": good, "crc_bad": bad, "crc_unchecked": unchecked}
    out |= {"samples": samples, "rate": rate, "duration": duration, "tags": tags, "vbr": vbr}
    # some encoders count the table's own frame
    counts = (len(offsets),) if lost else (len(offsets), len(offsets) + 1)
    out["vbr_ok"] = vbr is not None and vbr["frames"] in counts and vbr["bytes"] == end - vbr["at"]
    out["payload"] = _payload(data, bodies, tags.get("PRIV", b""))
    return out


def _payload(data: bytes, bodies: list[tuple[int, int]], private: bytes) -> bytes | None:
    """The bytes that ``store`` put in, if this is a stream of its making and they are unharmed."""
    if not private.startswith(OWNER):
        return None
    n, crc = struct.unpack(">QI", private[len(OWNER) : len(OWNER) + 12])
    got = b"".join(data[a:b] for a, b in bodies)[:n]
    return got if len(got) == n and zlib.crc32(got) == crc else None


def feature(x: dict) -> str:
    """The features of a stream in one string."""
    d, vbr = x["duration"], x["vbr"]
    return (
        f"frames={len(x['offsets'])} samples={x['samples']} rate={x['rate']} seconds={d.numerator}/{d.denominator}"
        f" lost={x['lost']} crc={x['crc_good']}/{x['crc_bad']}/{x['crc_unchecked']}"
        f" vbr={int(vbr is not None)}{int(x['vbr_ok'])} last={x['offsets'][-1] if x['offsets'] else -1}"
    )


def media_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``n_bytes`` and ``media`` (the stream) in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = [(x or "").encode() for x in b.column(at).to_pylist()]
            rest = [b.column(i) for i in range(b.num_columns) if i != at]
            names = [n for i, n in enumerate(b.schema.names) if i != at]
            made = pa.array([store(pad(x)) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*rest, pa.array(map(len, texts), pa.int64()), made], names=[*names, "n_bytes", "media"])

    docs = docs.drop("n_bytes", "media")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return docs.mapInArrow(run, f"{fields}{', ' if fields else ''}n_bytes long, media binary")


#: Columns that ``scan_column`` adds.
SCANNED = (
    "payload binary, feature string, n_frames long, duration_samples long, sample_rate long, duration_num long,"
    " duration_den long, crc_bad long, lost_bytes long, vbr_ok boolean, seek_offsets array<bigint>"
)


def scan_column(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with the columns of SCANNED; payload is null in streams that ``store`` hasn't made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(x or b"") for x in b.column(b.schema.get_field_index(media_col)).to_pylist()]
            cols = [
                pa.array([x["payload"] for x in got], pa.binary()),
                pa.array([feature(x) for x in got], pa.string()),
                *[pa.array([f(x) for x in got], pa.int64()) for f in (lambda x: len(x["offsets"]), lambda x: x["samples"], lambda x: x["rate"], lambda x: x["duration"].numerator, lambda x: x["duration"].denominator, lambda x: x["crc_bad"], lambda x: x["lost"])],
                pa.array([x["vbr_ok"] for x in got], pa.bool_()),
                pa.array([x["offsets"] for x in got], pa.list_(pa.int64())),
            ]
            names = [x.split()[0] for x in SCANNED.split(", ")]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    media = media.drop(*[x.split()[0] for x in SCANNED.split(", ")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, f"{fields}, {SCANNED}")


def digests(scanned: DataFrame) -> DataFrame:
    """The contract's columns, derived from a scanned media column."""
    return scanned.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "n_frames",
        "duration_samples",
        "sample_rate",
        "duration_num",
        "duration_den",
        "crc_bad",
        "seek_offsets",
    )
