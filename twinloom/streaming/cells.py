"""Incremental upkeep of windowed event cells (an extension: all other plans are batch plans)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.runtime import shared_dir


def windowed(events: DataFrame, window: str, lateness: str) -> DataFrame:
    """Count and mean value of each event type in tumbling windows; later events than ``lateness`` are dropped by a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def run_cells(spark: SparkSession, path: str, window: str = "1 day", lateness: str = "3650 days") -> DataFrame:
    """All files at ``path`` through the stream once; each cell as its last update left it.

    Every micro-batch appends its updated cells with its number, so a batch that
    runs again after a failure overwrites only itself.
    """
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    one = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(files).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    # a stream watches folders: a single file is the one of its name in its folder
    stream = reader.option("pathGlobFilter", files.getName()).parquet(files.getParent().toString()) if one else reader.parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/cells/batch_no={number}")

    query = windowed(stream, window, lateness).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    updates = spark.read.parquet(f"{root}/cells")
    last = updates.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "mean_value"), "batch").alias("c"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "c.n", F.round("c.mean_value", 6).alias("mean_value"))


def stream_event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cells of the events table, kept by a stream."""
    return run_cells(spark, f"{sf_dir}/events.parquet")


QUERIES = {"stream_event_cells": stream_event_cells}
ORACLE = {"stream_event_cells": "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(avg(value), 6) as mean_value from events where ts is not null group by 1, 2"}
