"""Line dedup, MPEG audio and WARC against plain Python."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from odweave.llm import line_dedup, mpeg_audio, queries, warc
from odweave.llm.common import scratch


def test_lines_by_hand(spark):
    rows = [(i, "a" if i < 6 else None, f"menu\nown {i}\n\nmenu\n") for i in range(12)]
    rows += [(20, "b", "menu"), (21, "b", None), (22, "b", ""), (None, "a", "menu"), (3, "a", "menu\nother")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS n_lines", "2 AS extra")
    out = line_dedup.line_dedup(df.drop("n_lines"), max_ratio=0.5, min_pages=5).collect()
    got = {(r.doc_id, r.source, r.text) for r in out}
    want = {(i, s, f"own {i}\n\n") for i, s, _ in rows[:12]}
    want |= {(20, "b", "menu"), (21, "b", None), (22, "b", ""), (None, "a", ""), (3, "a", "other")}
    assert got == want and len(out) == len(rows)
    assert next(r for r in out if r.doc_id == 2).n_dropped == 2
    assert line_dedup.line_dedup(df).columns == ["doc_id", "source", "text", "extra", "n_lines", "n_dropped"]
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


@given(st.binary(max_size=4000))
def test_mpeg_round_trip(data):
    got = mpeg_audio.scan(mpeg_audio.store(data))
    assert got["payload"] == data and got["crc_bad"] == got["lost"] == 0
    assert got["vbr_ok"] or not data
    assert got["samples"] == 1152 * len(got["offsets"])


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_mpeg_resynchronises(junk, tail):
    stream = mpeg_audio.store(bytes(range(256)) * 20)
    start = stream.index(b"\xff\xfa")
    whole = mpeg_audio.scan(stream[start:])["offsets"]
    got = mpeg_audio.scan(junk.replace(b"\xff", b"") + stream[start:] + b"TAG" + bytes(125))
    assert len(got["offsets"]) == len(whole)
    mpeg_audio.scan(tail)


@pytest.mark.parametrize("junk", [b"ID3", b"ID3\x04\0\0\0\0\0\x40", b"ID3\x03\0\0\0\0\0\x0aXX", b"ID3\x09\0\0\0\0\0\0", b"TAG", b"Xing"])
def test_mpeg_tags_that_are_none(junk):
    stream = mpeg_audio.store(bytes(range(256)) * 20)
    stream = stream[stream.index(b"\xff\xfa") :]
    got = mpeg_audio.scan(junk + stream)
    assert got["offsets"] == [len(junk) + i for i in mpeg_audio.scan(stream)["offsets"]]
    assert got["lost"] == len(junk) and not got["tags"]


def test_mpeg_tag_versions():
    title = [b"TT2\0\0\x03abc", b"TIT2\0\0\0\x03\0\0abc", b"TIT2\0\0\0\x03\0\0abc"]
    stream = mpeg_audio.store(b"x" * 999)
    stream = stream[stream.index(b"\xff\xfa") :]
    for version, frame in zip((2, 3, 4), title, strict=True):
        size = len(frame) + 20
        tag = b"ID3" + bytes([version, 0, 0, 0, 0, size >> 7, size & 127]) + frame + bytes(20)
        got = mpeg_audio.scan(tag + stream)
        assert got["tags"] == {frame[: 3 + (version > 2)].decode(): b"abc"} and got["lost"] == 0 and got["vbr_ok"]


def plain_crc(bits):
    """Bit by bit: polynomial 0x8005 from 0xFFFF."""
    v = 0xFFFF
    for b in bits:
        v = (v << 1) ^ (0x8005 if (v >> 15) != int(b) else 0)
        v &= 0xFFFF
    return v


def bits_of(data):
    return "".join(f"{b:08b}" for b in data)


def plain_layer_2(head, body):
    """The bits that the checksum covers, for 48 kHz stereo of 192 kbit/s and for 24 kHz joint stereo of bound 8."""
    first = head[1] & 8
    widths = [4] * 11 + [3] * 12 + [2] * 4 if first else [4] * 4 + [3] * 7 + [2] * 19
    bound, at, scales = 32 if first else 8, 0, 0
    for band, width in enumerate(widths):
        for _ in range(2 if band < bound else 1):
            if "1" in body[at : at + width]:
                scales += 1 if band < bound else 2
            at += width
    return bits_of(head[2:4]) + body[: at + 2 * scales]


@given(st.binary(min_size=110, max_size=110), st.integers(0, 255))
def test_mpeg_checksums_of_layers(noise, flip):
    heads = [
        (bytes([0xFF, 0xFE, 0x54, 0xC0]), lambda h, b: bits_of(h[2:4]) + b[:128]),  # Layer I, mono
        (bytes([0xFF, 0xFE, 0xB4, 0x00]), lambda h, b: bits_of(h[2:4]) + b[:256]),  # Layer I, stereo
        (bytes([0xFF, 0xFE, 0xB4, 0x50]), lambda h, b: bits_of(h[2:4]) + b[:160]),  # Layer I, joint stereo of bound 8
        (bytes([0xFF, 0xFC, 0xA4, 0x00]), plain_layer_2),
        (bytes([0xFF, 0xF4, 0x84, 0x50]), plain_layer_2),
        (bytes([0xFF, 0xFA, 0x94, 0x00]), lambda h, b: bits_of(h[2:4]) + b[:256]),  # Layer III, stereo
    ]
    for head, covered in heads:
        size = mpeg_audio.header_fields(*head[1:])[0]
        body = noise + bytes(size - 6 - len(noise))
        said = plain_crc(covered(head, bits_of(body)))
        frame = head + said.to_bytes(2, "big") + body
        got = mpeg_audio.scan(frame * 3)
        assert (len(got["offsets"]), got["crc_good"], got["crc_bad"]) == (3, 3, 0)
        n = len(covered(head, bits_of(body))) - 16
        hurt = bytearray(body)
        hurt[flip % len(body) if flip % 2 else 0] ^= 1
        want = plain_crc(covered(head, bits_of(bytes(hurt))))
        got = mpeg_audio.scan((head + said.to_bytes(2, "big") + bytes(hurt)) * 2)
        assert got["crc_bad"] == 2 * (want != said) and n >= 88


def test_mpeg_vbri_and_durations():
    head = bytes([0xFF, 0xFB, 0x94, 0xC0])
    size = mpeg_audio.header_fields(*head[1:])[0]
    audio = head + bytes(size - 4)
    toc = [size] * 4
    vbri = b"VBRI" + bytes(6) + (5 * size).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes([0, 4, 0, 1, 0, 2, 0, 1]) + b"".join(x.to_bytes(2, "big") for x in toc)
    first = head + bytes(32) + vbri
    got = mpeg_audio.scan(first + bytes(size - len(first)) + audio * 4)
    assert got["vbr_ok"] and got["vbr"]["toc"] == toc and got["offsets"] == [size * k for k in range(1, 5)]
    # 48 kHz and 44.1 kHz in one stream; frames counted by plain arithmetic
    other = bytes([0xFF, 0xFB, 0x90, 0xC0])
    other += bytes(mpeg_audio.header_fields(*other[1:])[0] - 4)
    got = mpeg_audio.scan(audio * 3 + other * 2)
    assert got["duration"] == 3 * Fraction(1152, 48_000) + 2 * Fraction(1152, 44_100)
    assert (size, len(other)) == (144 * 128_000 // 48_000, 144 * 128_000 // 44_100) and len(got["offsets"]) == 5


def test_media_query_against_plain_frames(spark):
    """Frames, offsets and duration of the registered query by a plain walk over the stored bytes."""
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op2_mpeg_audio(spark, d).collect()}
    for row in spark.read.parquet(f"{d}/documents.parquet").collect():
        r, text = got[row.doc_id], (row.text or "").encode()
        media = mpeg_audio.store(mpeg_audio.pad(text))
        at, offsets = 10 + int.from_bytes(media[6:10], "big"), []
        while at < len(media):
            kbps = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)[media[at + 2] >> 4]
            offsets.append(at)
            at += 144_000 * kbps // 48_000
        assert at == len(media) and r.seek_offsets == offsets[1:] and r.n_frames == len(offsets) - 1
        assert Fraction(r.duration_num, r.duration_den) == Fraction(1152 * r.n_frames, 48_000)
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(mpeg_audio.pad(text)).hexdigest(), hashlib.sha256(media).hexdigest())
        assert r.crc_bad == 0 and f"frames={r.n_frames} " in r.feature and r.payload_bytes % 192 == 0


def test_mpeg_finds_damage():
    stream = bytearray(mpeg_audio.store(b"x" * 3000))
    at = mpeg_audio.scan(bytes(stream))["offsets"][1]
    stream[at + 8] ^= 1  # side information of the second frame
    got = mpeg_audio.scan(bytes(stream))
    assert got["crc_bad"] == 1
    stream[at] = 0
    got = mpeg_audio.scan(bytes(stream))
    assert got["lost"] > 0 and got["payload"] is None and not got["vbr_ok"]


def test_media_of_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, "é" * 100), (3, "é" * 100), (None, "x" * 200_000)]
    out = mpeg_audio.digests(mpeg_audio.scan_column(mpeg_audio.media_column(documents(rows)))).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next((t or "") for i, t in rows if i == r.doc_id).encode()
        padded = mpeg_audio.pad(text)
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(padded))
        assert len(padded) % 192 == 0 < len(padded)
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-16:])
        assert r.media_sha256 == hashlib.sha256(mpeg_audio.store(padded)).hexdigest()
    assert mpeg_audio.scan_column(mpeg_audio.media_column(documents([]))).count() == 0
    clash = documents(rows).withColumnRenamed("lang", "media").withColumnRenamed("source", "feature")
    out = mpeg_audio.scan_column(mpeg_audio.media_column(clash))
    assert out.columns.count("media") == out.columns.count("feature") == 1 and "n_chars" in out.columns


def test_exits():
    places, nexts = np.array([0, 10, 25, 40]), np.array([25, 40, 60, 99])
    assert warc.exits(places, nexts, 50).tolist() == [60, 99, 60, 99]
    assert warc.exits(places[:0], nexts[:0], 50).tolist() == []


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_warc_round_trip(spark, monkeypatch, block):
    trap = warc.record(99, "u", b"inner", None, False).decode()
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (5, None, "same"), (3, "x\r\ny", None), (4, "u", "")]
    rows += [(6, "u", trap), (7, "u", "WARC/1.0\r\n"), (8, "u", "z" * 5000), (8, "u", "z" * 5000), (None, "u", "n"), (9, "u", trap * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    monkeypatch.setattr(warc, "BLOCK", block)
    out = warc.archive_round_trip(pages).collect()
    main = {}
    for i, _, h in rows:
        main[h or ""] = max(main.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        m, data = main[h or ""], (h or "").encode()
        own = (-1 if i is None else i) == m
        want.append((str(i), "response" if own else "revisit", None if own else m, warc.digest(data), len(data)))
    got = [(str(r.page_id), r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.digest_ok for r in out)


def test_warc_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(pages).count() == 0
    folder = scratch(spark, "none")
    assert warc.write_archives(pages.selectExpr("*", "page_id AS _main"), folder).count() == 0
