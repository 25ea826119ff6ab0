"""What the operators share: reading tables, written intermediates, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _temporary:
        _temporary[app] = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return _temporary[app]


BATCH, ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


class Scratch:
    """Intermediate tables in the shared folder.

    A written table cuts lineage and survives the loss of executors. Leaving
    the ``with`` block deletes every table but those written with keep=True,
    which lazily evaluated results still read. In the block Arrow batches are
    small, as rows may hold whole texts and arrays.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def table(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = f"{self.root}/{name}"
        self.paths.remove(path)
        self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def __enter__(self) -> Scratch:
        self.batch = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(min(ROWS_A_BATCH, int(self.batch)) if int(self.batch) > 0 else ROWS_A_BATCH))
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(BATCH, self.batch)
        for path in self.paths:
            self._delete(path)
        self.paths = []


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as df's own columns make needed."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def passing(docs: DataFrame, reads: tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """operator(docs), with other columns than it reads under names that it doesn't use; in the result they have their own again."""
    other = {c: f"__other{i}" for i, c in enumerate(docs.columns) if c not in reads}
    out = operator(docs.toDF(*[other.get(c, c) for c in docs.columns]))
    back = {v: k for k, v in other.items()}
    return out.toDF(*[back.get(c, c) for c in out.columns])


#: Rows of a table of 64-bit keys that may be broadcast: 16 MB.
BROADCAST_KEYS = 1 << 20


def only(df: DataFrame, keys: DataFrame, *on: str, how: str = "left_semi") -> DataFrame:
    """df's rows whose key is (left_semi) or isn't (left_anti) in keys, of a written table: keys are broadcast if they are few, else both sides are shuffled."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.distinct(), list(on), how)


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df in no more tasks than so many rows need, 2 at least; a df of fewer tasks stays as it is. A small table is few files."""
    return df.coalesce(max(2, -(-rows // each)))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function of batches, which gives its memory back when a task ends: workers outlive their tasks."""

    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # of the GNU library alone
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def content_key(*columns: str) -> list:
    """Two 64-bit hashes of the columns, as __k1 and __k2: a 128-bit key of what a row holds."""
    return [
        F.xxhash64(*columns).alias("__k1"),
        F.xxhash64(F.lit(7919), *columns, F.lit("k2")).alias("__k2"),
    ]
