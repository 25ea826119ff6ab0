"""Iceberg tables by their metadata: appends, snapshots, renamed columns, deletes, stray files."""

import json

import pytest

from tessera.catalog import Files
from tessera.sources import avro, iceberg


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/t"


def test_appends_snapshots_and_stray_files(spark, path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    iceberg.append(df, path)
    iceberg.append(spark.createDataFrame([(3, "c")], "k int, v string"), path)
    df.write.mode("append").parquet(f"{path}/data/stray")  # listed by no manifest
    assert rows(iceberg.scan(spark, path)) == [(1, "a"), (2, None), (3, "c")]
    first = iceberg.snapshots(spark, path).orderBy("sequence_number").first()
    assert rows(iceberg.scan(spark, path, first.snapshot_id)) == [(1, "a"), (2, None)]
    assert iceberg.manifests(spark, path).count() == 2 and iceberg.files(spark, path).agg({"record_count": "sum"}).first()[0] == 3
    iceberg.append(df.where("k = 1"), path, overwrite=True)
    assert rows(iceberg.scan(spark, path)) == [(1, "a")]
    with pytest.raises(ValueError):
        iceberg.append(df.select("k"), path)


def _edit(spark, path, change):
    """A next metadata file."""
    meta = iceberg.metadata(spark, path)
    n = int(meta.pop("__file")[1:].split(".")[0])
    change(meta)
    Files(spark, path).put(f"{path}/metadata/v{n + 1}.metadata.json", json.dumps(meta))


def test_columns_by_field_id(spark, path):
    iceberg.append(spark.createDataFrame([(1, "a")], "k int, v string"), path)

    def change(meta):
        meta["schemas"].append({"type": "struct", "schema-id": 1, "fields": [{"id": 2, "name": "renamed", "required": False, "type": "string"}, {"id": 3, "name": "v", "required": False, "type": "long"}, {"id": 1, "name": "k", "required": False, "type": "int"}]})
        meta["current-schema-id"] = 1

    _edit(spark, path, change)
    assert rows(iceberg.scan(spark, path).select("renamed", "v", "k")) == [("a", None, 1)]


def _with_deletes(spark, path, content, file, ids=None):
    entry = json.loads(json.dumps(iceberg._ENTRY))
    row = {"status": 1, "snapshot_id": 9, "data_file": {"content": content, "file_path": file, "file_format": "PARQUET", "partition": {}, "record_count": 1, "file_size_in_bytes": 1}}
    body = avro.container([row], entry, {})
    meta = iceberg.metadata(spark, path)
    seq, snapshot = meta["last-sequence-number"] + 1, iceberg._snapshot(meta, None)
    Files(spark, path).put(f"{path}/metadata/d{seq}.avro", body)
    mine = dict.fromkeys([*iceberg._LONGS, *iceberg._INTS], 0) | {"manifest_path": f"{path}/metadata/d{seq}.avro", "manifest_length": len(body), "sequence_number": seq, "content": 1}
    Files(spark, path).put(f"{path}/metadata/l{seq}.avro", avro.container([*iceberg._manifests(spark, snapshot), mine], iceberg._LIST, {}))

    def change(m):
        m["snapshots"].append(snapshot | {"snapshot-id": seq, "sequence-number": seq, "manifest-list": f"{path}/metadata/l{seq}.avro"})
        m["current-snapshot-id"], m["last-sequence-number"] = seq, seq

    _edit(spark, path, change)


def test_position_deletes(spark, path):
    iceberg.append(spark.range(5).coalesce(1).selectExpr("cast(id AS int) AS k"), path)
    file = iceberg.files(spark, path).first().file_path
    spark.createDataFrame([(file, 1), (file, 3)], "file_path string, pos long").write.parquet(f"{path}/gone")
    _with_deletes(spark, path, 1, f"{path}/gone")
    assert rows(iceberg.scan(spark, path)) == [(0,), (2,), (4,)]


def test_equality_deletes_reach_older_files_only(spark, path, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    iceberg.append(df, path)
    spark.createDataFrame([(2,), (None,)], "k int").select(iceberg.F.col("k").alias("k", metadata={"parquet.field.id": 1})).write.parquet(f"{path}/gone")
    _with_deletes(spark, path, 2, f"{path}/gone")
    iceberg.append(df.where("k = 2"), path)
    plain = iceberg.files
    ids = iceberg.F.when(iceberg.F.col("content") == 2, iceberg.F.array(iceberg.F.lit(1)))
    monkeypatch.setattr(iceberg, "files", lambda *a: plain(*a).withColumn("equality_ids", ids))
    assert rows(iceberg.scan(spark, path)) == [(1, "a"), (2, "b")]


def test_avro_against_another_reader(spark, path):
    iceberg.append(spark.createDataFrame([(1,)], "k int"), path)
    jvm, name = spark._jvm, iceberg.manifests(spark, path).first().path.replace("file://", "")
    reader = jvm.org.apache.avro.file.DataFileReader(jvm.java.io.File(name), jvm.org.apache.avro.generic.GenericDatumReader())
    got = json.loads(reader.next().toString())
    assert got["data_file"]["record_count"] == 1 and got["status"] == 1 and got["sequence_number"] is None and not reader.hasNext()
