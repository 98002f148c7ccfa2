"""Structured Streaming over files of events: deduplicated content and windowed counts.

Extensions: what they compute over a whole input equals the batch plans of the same name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.runtime import shared_dir


def source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over a folder of files, or over one file by its name in its folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/rows")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows")


def instant(wall: str):
    """A wall-clock column as the instant at which UTC shows it, whatever the session's zone."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', cast({wall} as timestamp_ntz))"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    counts = events.withColumn("at", instant("ts")).withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_contents(events: DataFrame, late: str = "400 days") -> DataFrame:
    """Distinct (user, type) as they arrive; the state of a key is dropped ``late`` after its
    event, so the state holds what that time brings. Choose it no shorter than repeats take."""
    return events.withColumn("at", instant("ts")).withWatermark("at", late).dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")
