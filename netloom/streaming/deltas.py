"""Structured Streaming: delta upserts, activity windows, leaderboards and split sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.session import shared_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 1, names: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder, of the given names, as a stream; ts becomes a TIMESTAMP, as watermarks need one."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str) -> DataFrame:
    """Events by window and type; events later than the watermark are dropped."""
    w = F.window("ts", size).alias("w")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, size: str, step: str, late: str) -> DataFrame:
    w = F.window("ts", size, step).alias("w")
    return events.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    w = F.session_window("ts", gap).alias("w")
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def latest_state(deltas: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key (complete mode): state is one row a key, whatever comes in."""
    rest = [c for c in deltas.columns if c != key]
    return deltas.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(key, "_s.*")


def upsert(deltas: DataFrame, key: str, order: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps folder/<batch> as the newest row of each key: each batch is merged with the version before.

    Versions are written beside each other and named by batch, so a repeated batch overwrites its own version only,
    and a reader takes the largest number.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = batch
        if number:
            new = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/{number - 1}").unionByName(batch)
        latest_state(new, key, order).select(batch.columns).write.mode("overwrite").parquet(f"{folder}/{number}")

    return deltas.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tee(stream: DataFrame, sinks: list[tuple[str, list[Callable[[DataFrame], DataFrame]]]], checkpoint: str) -> StreamingQuery:
    """Writes each batch to several folders, each behind its own filters (DataFrame to DataFrame)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for folder, filters in sinks:
            out = batch
            for f in filters:
                out = f(out)
            out.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def leaderboard(results: DataFrame, cost: Column) -> DataFrame:
    """Best result so far of each design, of equal costs the smallest run: complete-mode state of one row a design."""
    return results.withColumn("cost", cost).groupBy("design").agg(F.min(F.struct("cost", "run")).alias("b"), F.count("*").alias("runs")).select("design", "b.run", "b.cost", "runs")


def run_to_files(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is and returns its result, which executors write into the shared folder: a table for each batch,
    of which the last one holds the result in complete mode and all together in append mode."""
    folder, seen = f"{shared_dir(stream.sparkSession)}/netloom/{uuid.uuid4().hex}", []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/{number}")
        seen.append(number)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query.start().awaitTermination()
    kept = sorted(set(seen))[-1:] if mode == "complete" else sorted(set(seen))
    if not kept:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(*[f"{folder}/batches/{n}" for n in kept])


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns the result table, which the driver holds: for tests."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    w.start().awaitTermination()
    return stream.sparkSession.table(name)
