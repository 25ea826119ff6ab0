"""Functions that no built-in expression gives, as Arrow-batched pandas functions.

register() names them in a session, so SQL and expr() find them.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import struct
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_M = 0xFFFFFFFF


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit, signed."""
    h, n = seed & _M, len(data) // 4 * 4
    for i in range(0, n, 4):
        h = _mix(h, int.from_bytes(data[i : i + 4], "little"))
    if tail := data[n:]:
        k = int.from_bytes(tail, "little") * 0xCC9E2D51 & _M
        h ^= ((k << 15 | k >> 17) & _M) * 0x1B873593 & _M
    h ^= len(data)
    for mult, shift in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
        h = (h ^ h >> shift) * mult & _M
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _mix(h: int, k: int) -> int:
    k = k * 0xCC9E2D51 & _M
    h ^= ((k << 15 | k >> 17) & _M) * 0x1B873593 & _M
    return ((h << 13 | h >> 19) & _M) * 5 + 0xE6546B64 & _M


def iceberg_bytes(v) -> bytes:
    """A value as Iceberg hashes it: integers as 8 bytes, text as UTF-8."""
    return struct.pack("<q", int(v)) if isinstance(v, int) or hasattr(v, "__index__") else v if isinstance(v, bytes) else str(v).encode()


def sm3(data: bytes) -> str:
    """The SM3 digest (GB/T 32905-2016), hexadecimal."""
    if "sm3" in hashlib.algorithms_available:
        try:
            return hashlib.new("sm3", data).hexdigest()
        except ValueError:
            pass
    rot = lambda x, n: (x << n % 32 | x >> (32 - n % 32)) & _M if n % 32 else x
    v = [0x7380166F, 0x4914B2B9, 0x172442D7, 0xDA8A0600, 0xA96F30BC, 0x163138AA, 0xE38DEE4D, 0xB0FB0E4E]
    padded = data + b"\x80" + bytes((55 - len(data)) % 64) + struct.pack(">Q", 8 * len(data))
    for at in range(0, len(padded), 64):
        w = list(struct.unpack(">16I", padded[at : at + 64]))
        for j in range(16, 68):
            x = w[j - 16] ^ w[j - 9] ^ rot(w[j - 3], 15)
            w.append(x ^ rot(x, 15) ^ rot(x, 23) ^ rot(w[j - 13], 7) ^ w[j - 6])
        a, b, c, d, e, f, g, h = v
        for j in range(64):
            s1 = rot((rot(a, 12) + e + rot(0x79CC4519 if j < 16 else 0x7A879D8A, j)) & _M, 7)
            s2 = s1 ^ rot(a, 12)
            t1 = ((a ^ b ^ c if j < 16 else a & b | a & c | b & c) + d + s2 + (w[j] ^ w[j + 4])) & _M
            t2 = ((e ^ f ^ g if j < 16 else e & f | ~e & _M & g) + h + s1 + w[j]) & _M
            a, b, c, d, e, f, g, h = t1, a, rot(b, 9), c, t2 ^ rot(t2, 9) ^ rot(t2, 17), e, rot(f, 19), g
        v = [x ^ y for x, y in zip(v, (a, b, c, d, e, f, g, h), strict=True)]
    return "".join(f"{x:08x}" for x in v)


def ngram_similarity(hay: str, needle: str, n: int) -> float:
    """1 - missing / all of the needle's n-grams; 0 for a haystack over 32 KiB."""
    if len(hay.encode()) > 32 * 1024 or len(needle) < n:
        return 0.0
    have: dict[str, int] = {}
    for i in range(len(hay) - n + 1):
        have[hay[i : i + n]] = have.get(hay[i : i + n], 0) + 1
    total, missing = len(needle) - n + 1, 0
    for i in range(total):
        g = needle[i : i + n]
        if have.get(g, 0) > 0:
            have[g] -= 1
        else:
            missing += 1
    return 1.0 - missing / total


def bitmap_bytes(values) -> bytes:
    """A bitmap's portable form: count, then the sorted distinct values as deltas in LEB128."""
    out, last = bytearray(struct.pack("<q", len(set(values)))), 0
    for v in sorted(set(int(x) for x in values)):
        d = v - last
        last = v
        while d > 127:
            out.append(d & 127 | 128)
            d >>= 7
        out.append(d)
    return bytes(out)


def bitmap_values(data: bytes) -> list[int]:
    out, at, last = [], 8, 0
    while at < len(data):
        d = shift = 0
        while True:
            b = data[at]
            at += 1
            d |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        last += d
        out.append(last)
    return out


def sort_key(values: list) -> bytes:
    """Bytes that order as the values of each place do: NULL first, numbers by value, text and binary by bytes with 0x00 escaped."""
    out = bytearray()
    for v in values:
        if v is None:
            out += b"\x00"
            continue
        out += b"\x01"
        if isinstance(v, datetime.datetime):
            v = (v.replace(tzinfo=None) - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
        elif isinstance(v, datetime.date):
            v = v.toordinal()
        if isinstance(v, int):  # the sign bit flipped
            out += (int(v) + (1 << 127)).to_bytes(16, "big")
        elif isinstance(v, float):  # negative ones have all bits flipped, others the sign's
            (bits,) = struct.unpack(">Q", struct.pack(">d", v + 0.0))
            out += (bits ^ ((1 << 64) - 1 if bits >> 63 else 1 << 63)).to_bytes(8, "big")
        elif isinstance(v, Decimal):
            sign, digits, places = v.as_tuple()
            out += ((-1 if sign else 1) * int("".join(map(str, digits))) * 10 ** (38 + places) + (1 << 255)).to_bytes(32, "big")
        else:
            raw = v if isinstance(v, bytes) else str(v).encode()
            out += raw.replace(b"\x00", b"\x00\xff") + b"\x00\x01"
    return bytes(out)


def mann_whitney(x: pd.Series, group: pd.Series, alternative: str = "two-sided", continuity: bool = True) -> str:
    """'[U, p]' of the Mann-Whitney U test (normal approximation with tie correction); group false is the first sample."""
    import math

    ok = x.notna() & group.notna()
    x, g = x[ok].astype(float), group[ok].astype(bool)
    n1, n2 = int((~g).sum()), int(g.sum())
    if not n1 or not n2:
        return "[nan, nan]"
    ranks, n = x.rank(), n1 + n2
    u1 = float(ranks[~g].sum()) - n1 * (n1 + 1) / 2
    u2 = n1 * n2 - u1
    ties = float((x.value_counts() ** 3 - x.value_counts()).sum())
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    u = max(u1, u2) if alternative == "two-sided" else u1 if alternative == "greater" else u2
    z = (u - n1 * n2 / 2 - (0.5 if continuity else 0)) / sd if sd else 0.0
    p = math.erfc(z / math.sqrt(2)) / 2
    return f"[{min(u1, u2) if alternative == 'two-sided' else u1}, {min(1.0, 2 * p) if alternative == 'two-sided' else p}]"


def histogram_json(x: pd.Series, buckets: int) -> str:
    """Equi-height buckets [low, high, rows up to and with it, rows equal to high] as JSON text; a bucket extends over ties."""
    import json

    counts = x.dropna().value_counts().sort_index()
    if counts.empty:
        return "[]"
    size, out, low, held, total = max(1, int(counts.sum()) // buckets), [], None, 0, 0
    for v, c in counts.items():
        low = v if low is None else low
        held, total = held + int(c), total + int(c)
        if held >= size or v == counts.index[-1]:
            out.append([str(low), str(v), str(total), str(int(c))])
            low, held = None, 0
    return json.dumps(out)


def _each(f, kind: str):
    """A pandas function of one or more columns by a function of one value each; NULL gives NULL."""

    @F.pandas_udf(kind)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v is pd.NA for v in row) else f(*row) for row in zip(*cols, strict=True)], dtype=object)

    return run


def named_udfs() -> dict:
    import xxhash

    @F.pandas_udf("int")
    def murmur_hash3_32(*cols: pd.Series) -> pd.Series:
        out = []
        for row in zip(*cols, strict=True):
            h = 104729
            for v in row:
                h = murmur3_32(str(v).encode(), h) if v is not None else None
                if h is None:
                    break
            out.append(h)
        return pd.Series(out, dtype="Int32")

    @F.pandas_udf("decimal(38,0)")
    def xx_hash3_128(*cols: pd.Series) -> pd.Series:
        out = []
        for row in zip(*cols, strict=True):
            h = None if any(v is None for v in row) else xxhash.xxh3_128_intdigest("".join(map(str, row)).encode())
            h = h if h is None or h < 1 << 127 else h - (1 << 128)
            out.append(None if h is None or abs(h) >= 10**38 else Decimal(h))
        return pd.Series(out, dtype=object)

    # Of Arrow columns, as pandas makes doubles of integers beside nulls.
    @F.arrow_udf("binary")
    def encode_sort_key(*cols: pa.Array) -> pa.Array:
        return pa.array([sort_key(list(row)) for row in zip(*(c.to_pylist() for c in cols), strict=True)], pa.binary())

    @F.arrow_udf("string")
    def encode_fingerprint_sha256(*cols: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(sort_key(list(row))).hexdigest() for row in zip(*(c.to_pylist() for c in cols), strict=True)], pa.string())

    @F.pandas_udf("string")
    def mann_whitney_u_test(x: pd.Series, group: pd.Series) -> str:
        return mann_whitney(x, group)

    @F.pandas_udf("string")
    def histogram(x: pd.Series, buckets: pd.Series) -> str:
        return histogram_json(x, int(buckets.iloc[0]))

    return {
        "murmur_hash3_32": murmur_hash3_32,
        "xx_hash3_128": xx_hash3_128,
        "encode_sort_key": encode_sort_key,
        "encode_fingerprint_sha256": encode_fingerprint_sha256,
        "encode_row_id": encode_fingerprint_sha256,
        "mann_whitney_u_test": mann_whitney_u_test,
        "histogram": histogram,
        "sm3": _each(lambda s: sm3(s.encode() if isinstance(s, str) else bytes(s)), "string"),
        "ngram_search": _each(lambda h, x, n: ngram_similarity(h, x, int(n)), "float"),
        "ngram_search_case_insensitive": _each(lambda h, x, n: ngram_similarity(h.lower() if h.isascii() else h, x.lower(), int(n)), "float"),
        "bitmap_to_binary": _each(bitmap_bytes, "binary"),
        "bitmap_from_binary": _each(lambda b: bitmap_values(bytes(b)), "array<bigint>"),
        "bitmap_to_base64": _each(lambda v: base64.b64encode(bitmap_bytes(v)).decode(), "string"),
        "__iceberg_transform_bucket": _each(lambda v, n: (murmur3_32(iceberg_bytes(v)) & 0x7FFFFFFF) % int(n), "int"),
    }


#: The names that named_udfs() gives.
NAMES = frozenset(
    """
    murmur_hash3_32
    xx_hash3_128
    encode_sort_key
    encode_fingerprint_sha256
    encode_row_id
    mann_whitney_u_test
    histogram
    sm3
    ngram_search
    ngram_search_case_insensitive
    bitmap_to_binary
    bitmap_from_binary
    bitmap_to_base64
    __iceberg_transform_bucket
    """.split()
)


def register(spark: SparkSession, names: set[str]) -> None:
    """Make the functions of these names known to the session."""
    if names:
        found = named_udfs()
        for name in sorted(names):
            spark.udf.register(name, found[name])
