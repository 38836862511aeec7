"""Structured Streaming forms of ingest dedup and weekly counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import shared_dir


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet table's files: the file or folder itself is matched in its parent folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/[{name[0]}]{name[1:]}")


def folder_of(spark: SparkSession) -> str:
    """A new folder in the shared one, for a job that runs once."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def drained(df: DataFrame, base: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into a table in the folder `base`, and read it.

    A job that is given the same folder again goes on from its checkpoint: files that it has seen are not read again, and
    a batch that was broken off is written once. In complete mode the table is the last batch's.
    """
    spark = df.sparkSession
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/_batch={number}")

        query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(f"{base}/out")
    got = spark.read.parquet(f"{base}/out")
    last = got.agg(F.max("_batch")).first()[0]
    return got.where(F.col("_batch") == last).drop("_batch")


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Each key's first row within the watermark; state older than it goes, and so do rows that come later still."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def best(events: DataFrame, keys: list[str], score: Column, order: Column, keep: list[str]) -> DataFrame:
    """The best row of each key so far (ties by the least order), as state; for complete mode."""
    top = F.struct((-F.coalesce(score, F.lit(0))).alias("s"), order.alias("o"), F.struct(*keep).alias("r"))
    return events.groupBy(*keys).agg(F.min(top).alias("b")).select(*keys, "b.r.*")


def weekly(events: DataFrame, series: str, time: str, late: str = "7 days") -> DataFrame:
    """Counts by week from Monday; the epoch was a Thursday."""
    w = F.window(time, "7 days", startTime="4 days")
    return events.withWatermark(time, late).groupBy(w.alias("w"), series).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("week_start"), series, "n")
