"""Running sums and positions over a total order without one task for all rows; tables written to the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session may be without one (as in tests): it gets a new folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile go when it is done: what follows reads the table that was written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        if before is not None:
            spark.conf.set(key, "true")
        yield
    finally:
        if before is not None:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again: lineage ends there, and every executor sees it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more: all that was made of them has been written."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if re.search(r"-[0-9a-f]{32}$", path):
                where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of some numbers each that make 16 MiB.
FEW_ROWS = 2**19


def few(df: DataFrame) -> DataFrame:
    """A narrow table, to be broadcast if a count says that it is small; beyond that the same join shuffles."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with running sums (name: column) in an order; rows that tie are summed in any order, so give a total one.

    Rows are dealt by ranges of the order. Each range is summed on its own and begins with the sums of the ranges before it;
    these are one row a range. The dealt table is written, so that both passes see the same ranges.
    """
    ranged = written(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_range")), "ranges")
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.select("*", *(F.sum(c).over(inside).alias(k) for k, c in sums.items())).join(F.broadcast(starts), "_range")  # as many rows as ranges
    return rows.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_range", *(f"_{k}" for k in sums))


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with the place (1 ..) of each row in a total order."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}).drop("_one")
