"""Append-only logs: a checkpointed cursor over files, the fold of a run's status, and an idempotent index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, folder: str, pattern: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """The Parquet files of a folder that match a pattern as a stream: what earlier batches read, the checkpoint
    remembers."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(folder)


def run_status(events: DataFrame, completed: tuple[str, ...], failed: tuple[str, ...]) -> DataFrame:
    """Last completion or failure of each run(run, event_id, kind) by the kinds that mean either, in batch and in streaming
    alike."""
    status = F.when(F.col("kind").isin(*completed), "completed").when(F.col("kind").isin(*failed), "failed")
    return events.groupBy("run").agg(
        F.max(F.when(status.isNotNull(), F.struct("event_id", status.alias("s"))))["s"].alias("status"), F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("events")
    )


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events(at timestamp, kind) by window; rows later than the watermark are left out."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "kind").agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there and stop. sink(batch, batch_id) must be idempotent by batch id: after a crash a
    batch comes again with the same id."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserting(path: str, key: str):
    """A sink that keeps one file set a batch, replaced if the batch comes again; `latest` reads the last row by key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    rows = spark.read.parquet(path)
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"]).drop("batch")
