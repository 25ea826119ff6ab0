"""Media columns from ISO base media containers.

The reader walks nested boxes (32-bit, 64-bit and to-the-end sizes), decodes
the sample tables and gives codec, duration, sample count and the byte ranges
of keyframes. Payloads are never decoded. The writer stores bytes as 8-bit
uncompressed video samples, so that a payload can be put into a container and
read back without loss.

Defined cases. Null or empty bytes: no tracks, error "empty". Broken boxes or
tables: what was read so far is dropped, error says what broke. Equal bytes
give equal columns. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

#: Fixed values of the format: boxes that hold boxes, and how many bytes precede the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0}

SIDE, CHANNELS, TIMESCALE, FRAME_TICKS, KEY_EVERY = 8, 3, 600, 20, 16
SAMPLE = SIDE * SIDE * CHANNELS  # 192 bytes: one 8 x 8 frame of 8-bit RGB


class MediaError(ValueError):
    pass


def boxes(data: bytes, start: int, end: int):
    """(type, body start, body end) of each box from start to end."""
    while start < end:
        if end - start < 8:
            raise MediaError("box header cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise MediaError("64-bit box size cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            raise MediaError(f"box {kind.decode('latin-1')} doesn't fit its parent")
        yield kind, start + head, start + size
        start += size


def tree(data: bytes, start: int, end: int) -> list:
    return [(k, s, e, tree(data, s + CONTAINERS[k], e) if k in CONTAINERS else []) for k, s, e in boxes(data, start, end)]


def find(nodes: list, *path: bytes) -> list:
    for kind in path[:-1]:
        nodes = [x for n in nodes if n[0] == kind for x in n[3]]
    return [n for n in nodes if n[0] == path[-1]]


def _table(data: bytes, node: tuple, fmt: str, skip: int = 4) -> list[tuple]:
    """The entries behind a full box's version, flags and count."""
    _, s, e, _ = node
    if e - s < skip + 4:
        raise MediaError("sample table cut off")
    (n,), width = struct.unpack_from(">I", data, s + skip), struct.calcsize(">" + fmt)
    if s + skip + 4 + n * width > e:
        raise MediaError("sample table longer than its box")
    return list(struct.iter_unpack(">" + fmt, data[s + skip + 4 : s + skip + 4 + n * width]))


def _track(data: bytes, trak: tuple) -> dict:
    mdhd, hdlr = find(trak[3], b"mdia", b"mdhd"), find(trak[3], b"mdia", b"hdlr")
    stbl = find(trak[3], b"mdia", b"minf", b"stbl")
    if not mdhd or not hdlr or not stbl:
        raise MediaError("track without mdhd, hdlr or stbl")
    at = mdhd[0][1]
    scale, ticks = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    table = {k: [n for n in stbl[0][3] if n[0] == k] for k in (b"stsd", b"stts", b"stss", b"stsc", b"stsz", b"stco", b"co64")}
    for need in (b"stsd", b"stts", b"stsc", b"stsz"):
        if not table[need]:
            raise MediaError(f"no {need.decode()} table")
    _, s, _, _ = table[b"stsd"][0]
    codec = data[s + 12 : s + 16].decode("latin-1")
    _, s, e, _ = table[b"stsz"][0]
    fixed, n = struct.unpack_from(">II", data, s + 4)
    if fixed and fixed * n > len(data):
        raise MediaError("samples longer than the file")
    sizes = [fixed] * n if fixed else [x[0] for x in _table(data, table[b"stsz"][0], "I", 8)]
    chunks = [x[0] for x in (_table(data, table[b"stco"][0], "I") if table[b"stco"] else _table(data, table[b"co64"][0], "Q") if table[b"co64"] else [])]
    runs, ranges, sample = _table(data, table[b"stsc"][0], "III"), [], 0
    for i, (first, per, _) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunks)
        for c in range(first - 1, last):
            if c >= len(chunks):
                raise MediaError("stsc names a chunk beyond stco")
            offset = chunks[c]
            for _ in range(per):
                if sample == len(sizes):
                    break
                ranges.append((offset, sizes[sample]))
                offset += sizes[sample]
                sample += 1
    if sample != len(sizes):
        raise MediaError("chunks hold fewer samples than stsz has")
    if any(o + z > len(data) for o, z in ranges):
        raise MediaError("a sample lies beyond the end")
    timed = sum(c * d for c, d in _table(data, table[b"stts"][0], "II"))
    keys = [x[0] - 1 for x in _table(data, table[b"stss"][0], "I")] if table[b"stss"] else range(len(ranges))
    if any(not 0 <= k < len(ranges) for k in keys):
        raise MediaError("stss names a sample beyond stsz")
    return {
        "handler": data[hdlr[0][1] + 8 : hdlr[0][1] + 12].decode("latin-1"), "codec": codec, "timescale": scale,
        "duration": (ticks or timed) / scale if scale else None, "n_samples": len(sizes),
        "keyframes": [ranges[k] for k in keys], "samples": ranges,
    }


def parse(data: bytes) -> tuple[str, list[dict]]:
    """Major brand and tracks."""
    if not data:
        raise MediaError("empty")
    try:
        nodes = tree(data, 0, len(data))
        if find(nodes, b"moof"):  # their samples are in the fragments' own tables
            raise MediaError("fragmented files aren't read")
        ftyp = find(nodes, b"ftyp")
        return data[ftyp[0][1] : ftyp[0][1] + 4].decode("latin-1") if ftyp else "", [_track(data, t) for t in find(nodes, b"moov", b"trak")]
    except struct.error as e:
        raise MediaError(f"cut off: {e}") from None


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


#: Fixed value of the format: the unity matrix.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def build(payload: bytes) -> bytes:
    """An ISO media file whose one video track holds the payload, SAMPLE bytes a frame; its length is a multiple of that."""
    n, rest = divmod(len(payload), SAMPLE)
    if rest or not n:
        raise ValueError(f"a positive multiple of {SAMPLE} bytes is needed")
    ticks = n * FRAME_TICKS
    keys = range(1, n + 1, KEY_EVERY)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIII", SIDE, SIDE, 0x480000, 0x480000, 0),
        struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 24, -1),
    )

    def moov(offset: int) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, FRAME_TICKS)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64", struct.pack(">IQ", 1, offset)) if offset >> 32 else _full(b"stco", struct.pack(">II", 1, offset)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"video\0"),
            minf,
        )
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(16), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    start = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(start) + _box(b"mdat", payload)


COLUMNS = (
    "struct<brand string, error string, tracks array<struct<handler string, codec string, timescale long, duration double, "
    "n_samples long, keyframes array<struct<offset long, length long>>>>>"
)


def media_columns(df: DataFrame, column: str, out: str = "media") -> DataFrame:
    """df with a struct of what the ISO media file in the binary column says of itself, in the place of a column of that name.

    Null, empty, damaged and fragmented files have an error and no tracks.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kind = _parse_datatype_string(COLUMNS)
    df = df if out == column else df.drop(out)
    schema = StructType([*df.schema.fields, StructField(out, kind)])

    def read(batches):
        for batch in batches:
            found = []
            for data in as_bytes(batch.column(column)):
                try:
                    brand, tracks = parse(data)
                    found.append({"brand": brand, "error": None, "tracks": [{**{k: v for k, v in t.items() if k != "samples"}, "keyframes": [{"offset": o, "length": z} for o, z in t["keyframes"]]} for t in tracks]})
                except MediaError as e:
                    found.append({"brand": None, "error": str(e), "tracks": []})
            from pyspark.sql.pandas.types import to_arrow_type

            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, to_arrow_type(kind))], names=[*batch.schema.names, out])

    return df.mapInArrow(read, schema)


def feature(brand: str, track: dict) -> str:
    """Brand, handler, codec, duration, samples, and the keyframes' number, first, last and CRC-32."""
    keys = track["keyframes"]
    packed = b"".join(struct.pack("<QQ", *k) for k in keys)
    span = f"{keys[0][0]}+{keys[0][1]}..{keys[-1][0]}+{keys[-1][1]}" if keys else "-"
    return f"{brand}/{track['handler']}/{track['codec'].strip()}/{track['duration']:.6f}s/{track['n_samples']}/{len(keys)}:{span}:{zlib.crc32(packed):08x}"


def _store_and_read(batches):
    for batch in batches:
        rows = []
        for text in as_bytes(batch.column("text")):
            padded = text + b" " * (SAMPLE - len(text) % SAMPLE if len(text) % SAMPLE or not text else 0)
            media = build(padded)
            brand, (track,) = parse(media)
            back = b"".join(media[o : o + n] for o, n in _joined(track["samples"]))
            rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(brand, track)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring byte ranges as one."""
    out: list[tuple[int, int]] = []
    for o, n in ranges:
        if out and out[-1][0] + out[-1][1] == o:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((o, n))
    return out


def text_media(docs: DataFrame) -> DataFrame:
    """Each text as the payload of an ISO media file, and what reading that file gives."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _store_and_read,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
