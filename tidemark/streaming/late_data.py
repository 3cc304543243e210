"""Late and repeated events as streams: upserts, windows, sessions, deduplication, stream-static joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.sizes import small
from tidemark.session import shared_dir
from tidemark.sources.tables import upsert


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table's Parquet files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream into a Parquet table in the shared folder.

    Each batch is a folder of its own that a repeated batch overwrites; of complete results the last
    batch counts. So nothing passes through the driver, and a restart changes nothing.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={version}")

    writer = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True)
    writer.start().awaitTermination()
    rows = spark.read.schema(f"{_schema(stream)}, batch int").parquet(path)
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")
    return rows.drop("batch")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return windows.select(F.col("window.start").alias("start"), "event_type", "events", F.col("total").cast("double").alias("total"))


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), "events")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return found.select("user_id", F.col("session_window.start").alias("start"), "events")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """Idempotent intake: a key that came within the watermark isn't let through again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def with_registry(events: DataFrame, registry: DataFrame, on: str) -> DataFrame:
    """Stream-static join to a small dimension."""
    return events.join(small(registry), on, "left")


def upsert_batches(events: DataFrame, path: str, keys: list[str], newest: str = "ts"):
    """A stream writer that keeps each key's newest row in versioned Parquet folders under path.

    A repeated batch writes the same version again, so a restart after a lost executor changes nothing.
    """

    def merge(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        rows = upsert(batch.limit(0), batch, keys, newest)
        if version:
            rows = upsert(spark.read.parquet(f"{path}/v={version - 1}"), batch, keys, newest)
        rows.write.mode("overwrite").parquet(f"{path}/v={version}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True)


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """What upsert_batches holds after its last batch."""
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.join(F.broadcast(rows.agg(F.max("v").alias("v"))), "v").drop("v")


def _count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    events, last = state.get if state.exists else (0, None)
    for frame in frames:
        events += len(frame)
        newest = frame["ts"].max()
        last = newest if last is None or newest > last else last
    state.update((events, last))
    yield pd.DataFrame({"user_id": [key[0]], "events": [events], "last_at": [last]})


def running(events: DataFrame) -> DataFrame:
    """(user_id, events, last_at) as state of an operator of our own, updated with every batch."""
    kind = events.schema["user_id"].dataType.simpleString()
    grouped = events.select("user_id", "ts").groupBy("user_id")
    return grouped.applyInPandasWithState(_count, f"user_id {kind}, events long, last_at timestamp", "events long, last_at timestamp", "update", GroupStateTimeout.NoTimeout)
