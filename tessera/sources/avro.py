"""Avro object container files, as far as table metadata needs them: any schema, codecs null, deflate, zstandard and snappy."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from io import BytesIO

_MAGIC = b"Obj\x01"
_NAMED = ("record", "enum", "fixed")


def _long(f: BytesIO) -> int:
    shift = n = 0
    while True:
        (b,) = f.read(1)
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n >> 1 ^ -(n & 1)
        shift += 7


def _bytes(f: BytesIO) -> bytes:
    return f.read(_long(f))


def _blocks(f: BytesIO) -> Iterator[None]:
    """Once an item of an array or map."""
    while n := _long(f):
        if n < 0:
            n = -n
            _long(f)  # the block's size in bytes
        for _ in range(n):
            yield


def _known(schema, names: dict) -> None:
    """All named types of the schema."""
    if isinstance(schema, list):
        for s in schema:
            _known(s, names)
    elif isinstance(schema, dict):
        if schema["type"] in _NAMED:
            names[schema["name"]] = names[f"{schema['namespace']}.{schema['name']}" if "namespace" in schema else schema["name"]] = schema
        for s in [x["type"] for x in schema.get("fields", [])] + [schema[k] for k in ("items", "values") if k in schema] + ([schema["type"]] if isinstance(schema["type"], (dict, list)) else []):
            _known(s, names)


def _value(f: BytesIO, schema, names: dict):
    if isinstance(schema, list):
        return _value(f, schema[_long(f)], names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return _value(f, kind, names)
    match kind:
        case "null":
            return None
        case "boolean":
            return f.read(1) == b"\x01"
        case "int" | "long":
            return _long(f)
        case "float":
            return struct.unpack("<f", f.read(4))[0]
        case "double":
            return struct.unpack("<d", f.read(8))[0]
        case "bytes":
            return _bytes(f)
        case "string":
            return _bytes(f).decode()
        case "record":
            return {x["name"]: _value(f, x["type"], names) for x in schema["fields"]}
        case "enum":
            return schema["symbols"][_long(f)]
        case "fixed":
            return f.read(schema["size"])
        case "array":
            return [_value(f, schema["items"], names) for _ in _blocks(f)]
        case "map":
            return {_bytes(f).decode(): _value(f, schema["values"], names) for _ in _blocks(f)}
    return _value(f, names[kind], names)


def _inflated(data: bytes, codec: str) -> bytes:
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "snappy":
        import pyarrow as pa

        n = sum((b & 0x7F) << 7 * i for i, b in enumerate(data[: next(i for i, b in enumerate(data) if b < 0x80) + 1]))
        return pa.decompress(data[:-4], n, "snappy", asbytes=True)  # a checksum follows
    if codec != "null":
        raise ValueError(f"Avro codec {codec}")
    return data


def records(content: bytes) -> Iterator[dict]:
    """The records of a file, by the schema that it holds."""
    f = BytesIO(content)
    if f.read(4) != _MAGIC:
        raise ValueError("not an Avro container file")
    meta = {_bytes(f).decode(): _bytes(f) for _ in _blocks(f)}
    schema, codec, mark = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(16)
    names: dict = {}
    _known(schema, names)
    while f.tell() < len(content):
        n = _long(f)
        block = BytesIO(_inflated(_bytes(f), codec))
        for _ in range(n):
            yield _value(block, schema, names)
        if f.read(16) != mark:
            raise ValueError("a block's end mark is wrong")


def _put_long(n: int) -> bytes:
    n, out = n << 1 ^ n >> 63, bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _put_bytes(b: bytes) -> bytes:
    return _put_long(len(b)) + b


def _put(v, schema) -> bytes:
    if isinstance(schema, list):  # of null and one type
        at = next(i for i, s in enumerate(schema) if (s == "null") == (v is None))
        return _put_long(at) + _put(v, schema[at])
    kind = schema["type"] if isinstance(schema, dict) else schema
    match kind:
        case "null":
            return b""
        case "int" | "long":
            return _put_long(v)
        case "string":
            return _put_bytes(v.encode())
        case "record":
            return b"".join(_put(v.get(x["name"]), x["type"]) for x in schema["fields"])
    raise ValueError(f"Avro type {kind} isn't written")


def container(rows: list[dict], schema: dict, meta: dict[str, str]) -> bytes:
    """A file of rows of records of null, int, long, string and records."""
    entries = {"avro.schema": json.dumps(schema), "avro.codec": "deflate", **meta}
    mark, squeeze = os.urandom(16), zlib.compressobj(wbits=-15)
    body = squeeze.compress(b"".join(_put(r, schema) for r in rows)) + squeeze.flush()
    head = _put_long(len(entries)) + b"".join(_put_bytes(k.encode()) + _put_bytes(v.encode()) for k, v in entries.items()) + _put_long(0)
    return _MAGIC + head + mark + (_put_long(len(rows)) + _put_bytes(body) + mark if rows else b"")
