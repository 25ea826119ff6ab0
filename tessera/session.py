"""Sessions with the settings that the dialect's semantics need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: NULL for bad casts and zero divisors, zone-less times, last key wins, NULL size of NULL.
SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.legacy.sizeOfNull": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.cbo.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def open_session(app: str = "tessera", **settings: str) -> SparkSession:
    """A configured session; the number of shuffle partitions is left to the cluster's default and AQE."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


_temporary: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path that all machines see: below spark.checkpoint.dir, or a temporary one where the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if app not in _temporary:
            _temporary[app] = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        root = _temporary[app]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
