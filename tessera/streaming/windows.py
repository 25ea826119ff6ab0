"""Structured Streaming forms of the time functions; each also takes a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], aggs: list, late: str | None = "1 hour") -> DataFrame:
    return _timed(df, ts, late).groupBy(F.window(ts, width), *keys).agg(*aggs).select(F.col("window.start").alias("start"), *keys, *[F.col(n) for n in _names(aggs)])


def sliding(df: DataFrame, ts: str, width: str, slide: str, keys: list[str], aggs: list, late: str | None = "1 hour") -> DataFrame:
    return _timed(df, ts, late).groupBy(F.window(ts, width, slide), *keys).agg(*aggs).select(F.col("window.start").alias("start"), *keys, *[F.col(n) for n in _names(aggs)])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list, late: str | None = "1 hour") -> DataFrame:
    return _timed(df, ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*aggs).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *[F.col(n) for n in _names(aggs)])


def first_by_key(df: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One row a key within the watermark."""
    timed = _timed(df, ts, late)
    return timed.dropDuplicatesWithinWatermark(keys) if df.isStreaming else timed.dropDuplicates(keys)


def _names(aggs: list) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggs]


def load_stream(spark: SparkSession, path: str, schema, sink, checkpoint: str, fmt: str = "parquet", where=None) -> None:
    """Files of a folder as labelled micro-batches: sink(df, batch_id) gets each once more after a failure, under the same label."""
    stream = spark.readStream.schema(schema).format(fmt).load(path)
    stream = stream.where(where) if where is not None else stream
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
