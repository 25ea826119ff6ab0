import hashlib
import struct
import zlib

import pytest

from tessera.llm import media_columns as m


def test_round_trip_and_tables(spark):
    texts = [(1, "hello"), (2, None), (3, ""), (4, "é" * 5000), (5, "x" * 192), (6, "hello")]
    got = {r.doc_id: r for r in m.text_media(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-16:])
        media = m.build(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[1].feature == got[6].feature


def test_keyframe_ranges_hold_the_frames():
    payload = bytes(range(256)) * 3 * 40
    media = m.build(payload[: 192 * 150])
    brand, (track,) = m.parse(media)
    assert (brand, track["codec"], track["n_samples"], track["duration"]) == ("isom", "raw ", 150, 150 * 20 / 600)
    assert [media[o : o + n] for o, n in track["keyframes"]] == [payload[192 * k : 192 * k + 192] for k in range(0, 150, 16)]


def test_box_sizes_and_errors(spark):
    good = m.build(b"a" * 192)
    at = good.index(b"mdat") - 4
    to_end = good[:at] + struct.pack(">I", 0) + good[at + 4 :]
    assert m.parse(to_end)[1][0]["n_samples"] == 1
    wide = struct.pack(">I4sQ", 1, b"free", 16) + b""
    assert m.parse(good + wide)[0] == "isom"
    for bad in (b"", good[:-1], good[:100], b"\0\0\0\7abcd"):
        with pytest.raises(m.MediaError):
            m.parse(bad)
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"nonsense"))], "media_id int, data binary")
    rows = {r.media_id: r.media for r in m.media_columns(df, "data").collect()}
    assert rows[1].tracks[0].keyframes[0].length == 192 and rows[2].error == "empty" and rows[3].error


def test_sample_counts_beyond_the_file_and_fragments_are_errors():
    whole = m.build(b"x" * 192)
    at = whole.index(b"stsz") + 8
    bomb = whole[: at + 4] + struct.pack(">I", 300_000_000) + whole[at + 8 :]
    for data in (bomb, whole + struct.pack(">I4s", 8, b"moof")):
        with pytest.raises(m.MediaError):
            m.parse(data)
