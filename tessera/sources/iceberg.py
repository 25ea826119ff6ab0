"""Iceberg tables of Parquet files by their published format, without its runtime: scans, metadata tables, appends.

A scan reads the files that the snapshot's manifests list, and no others;
columns are found by field id, so renamed and added ones come out right.
Position and equality deletes are anti-joins. Manifests are decoded in tasks;
the driver gets the list of data files, as any planner of such a scan does.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Files
from .avro import container, records

_PLAIN = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "uuid": T.StringType(),
}
FILES = "manifest_path string, content int, file_path string, file_format string, record_count long, file_size_in_bytes long, sequence_number long, equality_ids array<int>"


def _type(t) -> T.DataType:
    if isinstance(t, str):
        if m := re.match(r"decimal\((\d+),\s*(\d+)\)", t):
            return T.DecimalType(int(m[1]), int(m[2]))
        return T.BinaryType() if t.startswith("fixed") else _PLAIN[t]
    if t["type"] == "list":
        return T.ArrayType(_type(t["element"]), not t["element-required"])
    if t["type"] == "map":
        return T.MapType(_type(t["key"]), _type(t["value"]), not t["value-required"])
    return T.StructType([T.StructField(f["name"], _type(f["type"]), True, {"parquet.field.id": f["id"]}) for f in t["fields"]])


def _named(t: T.DataType) -> str:
    """The format's name of a column's type; nested columns aren't written."""
    if isinstance(t, T.DecimalType):
        return f"decimal({t.precision}, {t.scale})"
    name = next((n for n, x in _PLAIN.items() if x == t), None)
    if name is None:
        raise ValueError(f"a column of type {t.simpleString()} isn't written")
    return name


def metadata(spark: SparkSession, path: str) -> dict:
    """The newest metadata file."""
    files = Files(spark, path)
    names = [n for n in files.names(f"{path}/metadata") if n.endswith(".metadata.json")]
    if not names:
        raise ValueError(f"no Iceberg table at {path}")
    newest = max(names, key=lambda n: int(re.match(r"v?(\d+)", n)[1]))
    return json.loads(files.text(f"{path}/metadata/{newest}")) | {"__file": newest}


def _snapshot(meta: dict, snapshot_id: int | None) -> dict | None:
    wanted = meta.get("current-snapshot-id") if snapshot_id is None else snapshot_id
    return next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == wanted), None)


def _manifests(spark: SparkSession, snapshot: dict | None) -> list[dict]:
    if snapshot is None:
        return []
    content = spark.read.format("binaryFile").load(snapshot["manifest-list"]).select("content").first()[0]
    return list(records(bytes(content)))


def manifests(spark: SparkSession, path: str, snapshot_id: int | None = None) -> DataFrame:
    """The metadata table of a snapshot's manifests."""
    rows = [(m["manifest_path"], m["manifest_length"], m.get("content", 0), m.get("sequence_number") or 0, m["added_snapshot_id"]) for m in _manifests(spark, _snapshot(metadata(spark, path), snapshot_id))]
    return spark.createDataFrame(rows, "path string, length long, content int, sequence_number long, added_snapshot_id long")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    rows = [(s["snapshot-id"], s.get("parent-snapshot-id"), s.get("sequence-number", 0), s["timestamp-ms"], (s.get("summary") or {}).get("operation"), s["manifest-list"]) for s in metadata(spark, path).get("snapshots", [])]
    return spark.createDataFrame(rows, "snapshot_id long, parent_id long, sequence_number long, timestamp_ms long, operation string, manifest_list string")


def files(spark: SparkSession, path: str, snapshot_id: int | None = None) -> DataFrame:
    """The metadata table of a snapshot's live data and delete files."""
    listed = {_place(m["manifest_path"]): m.get("sequence_number") or 0 for m in _manifests(spark, _snapshot(metadata(spark, path), snapshot_id))}
    if not listed:
        return spark.createDataFrame([], FILES)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                for e in records(content):
                    if e["status"] != 2:
                        d, seq = e["data_file"], e.get("sequence_number")
                        out.append((name, d.get("content", 0), d["file_path"], d["file_format"].upper(), d["record_count"], d["file_size_in_bytes"], listed[_place(name)] if seq is None else seq, d.get("equality_ids")))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in FILES.split(", ")])

    found = _manifests(spark, _snapshot(metadata(spark, path), snapshot_id))
    return spark.read.format("binaryFile").load([m["manifest_path"] for m in found]).select("path", "content").mapInPandas(decode, FILES)


def _place(path: str) -> str:
    return re.sub(r"^\w+:(//[^/]*)?", "", path)


def _place_of(c: str) -> Column:
    return F.regexp_replace(F.col(c), r"^\w+:(//[^/]*)?", "")


def scan(spark: SparkSession, path: str, snapshot_id: int | None = None) -> DataFrame:
    """The rows of a snapshot, by default the current one."""
    meta = metadata(spark, path)
    current = next((s for s in meta["schemas"] if s["schema-id"] == meta["current-schema-id"])) if "schemas" in meta else meta["schema"]
    schema = _type(current | {"type": "struct"})
    found = files(spark, path, snapshot_id).collect()
    if any(f.file_format != "PARQUET" for f in found):
        raise ValueError("only Parquet files are read")
    data, at, equal = ([f for f in found if f.content == k] for k in (0, 1, 2))
    if not data:
        return spark.createDataFrame([], schema)
    names, by_id = schema.names, {f["id"]: schema[f["name"]] for f in current["fields"]}
    if "schema.name-mapping.default" not in meta.get("properties", {}):
        # By field id, under names that no file has: Spark finds types by name where a file's name stands for another column now.
        spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        by_id = {i: T.StructField(f"__id{i}", f.dataType, True, {"parquet.field.id": i}) for i, f in by_id.items()}
    else:
        by_id = {i: T.StructField(f.name, f.dataType) for i, f in by_id.items()}
    df = spark.read.schema(T.StructType(list(by_id.values()))).parquet(*[f.file_path for f in data])
    kept = [F.col(f"`{f.name}`").alias(n) for n, f in zip(names, by_id.values(), strict=True)]
    if at or equal:
        df = df.select(*df.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")).withColumn("__file", _place_of("__file"))
    if at:
        gone = spark.read.schema("file_path string, pos long").parquet(*[f.file_path for f in at]).select(_place_of("file_path").alias("__file"), F.col("pos").alias("__row"))
        df = df.join(gone, ["__file", "__row"], "left_anti")
    if equal:
        # A delete reaches the files that are older than itself.
        age = spark.createDataFrame([(_place(f.file_path), f.sequence_number) for f in data], "__file string, __age long")
        df = df.join(age, "__file")
        for ids in sorted({tuple(f.equality_ids) for f in equal}):
            keys = [by_id[i] for i in ids]
            for seq in sorted({f.sequence_number for f in equal if tuple(f.equality_ids) == ids}):
                gone = spark.read.schema(T.StructType(keys)).parquet(*[f.file_path for f in equal if tuple(f.equality_ids) == ids and f.sequence_number == seq]).distinct().toDF(*[f"__k{i}" for i in ids])
                same = [F.col(f"`{k.name}`").eqNullSafe(F.col(f"__k{i}")) for i, k in zip(ids, keys, strict=True)]
                df = df.join(gone, [*same, F.col("__age") < seq], "left_anti")
    return df.select(*kept)


_ENTRY = {
    "type": "record", "name": "manifest_entry", "fields": [
        {"name": "status", "type": "int", "field-id": 0},
        {"name": "snapshot_id", "type": ["null", "long"], "default": None, "field-id": 1},
        {"name": "sequence_number", "type": ["null", "long"], "default": None, "field-id": 3},
        {"name": "file_sequence_number", "type": ["null", "long"], "default": None, "field-id": 4},
        {"name": "data_file", "field-id": 2, "type": {"type": "record", "name": "r2", "fields": [
            {"name": "content", "type": "int", "field-id": 134},
            {"name": "file_path", "type": "string", "field-id": 100},
            {"name": "file_format", "type": "string", "field-id": 101},
            {"name": "partition", "type": {"type": "record", "name": "r102", "fields": []}, "field-id": 102},
            {"name": "record_count", "type": "long", "field-id": 103},
            {"name": "file_size_in_bytes", "type": "long", "field-id": 104},
        ]}},
    ],
}
_LONGS = {"manifest_length": 501, "sequence_number": 515, "min_sequence_number": 516, "added_snapshot_id": 503, "added_rows_count": 512, "existing_rows_count": 513, "deleted_rows_count": 514}
_INTS = {"partition_spec_id": 502, "content": 517, "added_files_count": 504, "existing_files_count": 505, "deleted_files_count": 506}
_LIST = {
    "type": "record", "name": "manifest_file",
    "fields": [{"name": "manifest_path", "type": "string", "field-id": 500}, *({"name": n, "type": t, "field-id": i} for t, group in (("long", _LONGS), ("int", _INTS)) for n, i in group.items())],
}


def append(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows into an unpartitioned table, which is made where there is none; a new snapshot of format version 2.

    The metadata file of the next version is created last, and creating it
    fails where another writer was first. Columns go by position.
    """
    spark, store = df.sparkSession, Files(df.sparkSession, path)
    exists = any(n.endswith(".metadata.json") for n in store.names(f"{path}/metadata"))
    if exists:
        meta = metadata(spark, path)
        schema = next(s for s in meta["schemas"] if s["schema-id"] == meta["current-schema-id"])
        fields, number = schema["fields"], int(re.match(r"v?(\d+)", meta.pop("__file"))[1])
    else:
        fields, number = [{"id": i + 1, "name": f.name, "required": False, "type": _named(f.dataType)} for i, f in enumerate(df.schema.fields)], 0
        schema = {"type": "struct", "schema-id": 0, "fields": fields}
        meta = {"format-version": 2, "table-uuid": str(uuid.uuid4()), "location": path, "last-sequence-number": 0, "last-column-id": len(fields), "current-schema-id": 0, "schemas": [schema], "default-spec-id": 0, "partition-specs": [{"spec-id": 0, "fields": []}], "last-partition-id": 999, "default-sort-order-id": 0, "sort-orders": [{"order-id": 0, "fields": []}], "properties": {}, "snapshots": [], "snapshot-log": [], "metadata-log": []}
    if len(fields) != len(df.columns):
        raise ValueError("column count doesn't match")
    typed = [F.col(f"`{c}`").cast(_type(f["type"])).alias(f["name"], metadata={"parquet.field.id": f["id"]}) for c, f in zip(df.columns, fields, strict=True)]
    seq, snapshot_id, tag = meta["last-sequence-number"] + 1, uuid.uuid4().int >> 65, uuid.uuid4().hex
    folder = f"{path}/data/{tag}"
    df.select(*typed).write.parquet(folder)
    written = spark.read.parquet(folder).groupBy("_metadata.file_path", "_metadata.file_size").count().collect()  # a row a file
    entries = [{"status": 1, "snapshot_id": snapshot_id, "data_file": {"content": 0, "file_path": r[0], "file_format": "PARQUET", "partition": {}, "record_count": r[2], "file_size_in_bytes": r[1]}} for r in written]
    spec = {"format-version": "2", "schema": json.dumps(schema), "schema-id": str(schema["schema-id"]), "partition-spec": "[]", "partition-spec-id": "0", "content": "data"}
    body, name = container(entries, _ENTRY, spec), f"{path}/metadata/{tag}-m0.avro"
    store.put(name, body)
    mine = dict.fromkeys([*_LONGS, *_INTS], 0) | {"manifest_path": name, "manifest_length": len(body), "sequence_number": seq, "min_sequence_number": seq, "added_snapshot_id": snapshot_id, "added_files_count": len(entries), "added_rows_count": sum(r[2] for r in written)}
    parent = _snapshot(meta, None)
    kept = [] if overwrite else _manifests(spark, parent)
    listing = f"{path}/metadata/snap-{snapshot_id}-{tag}.avro"
    store.put(listing, container([*kept, mine], _LIST, {"format-version": "2", "snapshot-id": str(snapshot_id), "sequence-number": str(seq)}))
    now = int(time.time() * 1000)
    snapshot = {"snapshot-id": snapshot_id, "sequence-number": seq, "timestamp-ms": now, "manifest-list": listing, "schema-id": schema["schema-id"], "summary": {"operation": "overwrite" if overwrite else "append"}} | ({"parent-snapshot-id": parent["snapshot-id"]} if parent else {})
    meta |= {"last-sequence-number": seq, "last-updated-ms": now, "current-snapshot-id": snapshot_id, "snapshots": [*meta["snapshots"], snapshot], "snapshot-log": [*meta.get("snapshot-log", []), {"snapshot-id": snapshot_id, "timestamp-ms": now}], "refs": {"main": {"snapshot-id": snapshot_id, "type": "branch"}}}
    store.put(f"{path}/metadata/v{number + 1}.metadata.json", json.dumps(meta))
