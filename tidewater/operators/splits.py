"""Splits that respect time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered


def time_split(df: DataFrame, day: Column, holdout_days: int) -> DataFrame:
    """df with `part`: train up to the last day less the holdout, test after it; rows without a day are left out."""
    last = df.agg(F.max(day).alias("_last"))  # one row
    rows = df.withColumn("_day", day).where("_day is not null").crossJoin(F.broadcast(last))
    return rows.withColumn("part", F.when(F.col("_day") <= F.date_sub("_last", holdout_days), "train").otherwise("test")).drop("_day", "_last")


def rolling_windows(df: DataFrame, day: Column, train_days: int = 90, test_days: int = 30) -> DataFrame:
    """cutoff, n_train, n_test of each window that has both: its rows are counted by day before they meet windows."""
    per_day = df.where(day.isNotNull()).groupBy(day.alias("d")).agg(F.count("*").alias("n"))
    ends = per_day.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    # A day lies in the windows of cutoffs d + 1 .. d + train_days on the grid that starts train_days after the first.
    off = F.datediff("d", "a")
    first = F.greatest(F.lit(0), F.ceil((off + 1 - train_days) / test_days).cast("int"))
    last = F.least(F.floor(off / test_days).cast("int"), F.floor((F.datediff("b", "a") - train_days) / test_days).cast("int"))
    in_windows = per_day.crossJoin(F.broadcast(ends)).where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    cutoff = F.date_add("a", F.col("k") * test_days + train_days)
    tested = F.col("d") >= F.date_sub(cutoff, test_days)
    counts = in_windows.groupBy(cutoff.alias("cutoff")).agg(F.coalesce(F.sum(F.when(~tested, F.col("n"))), F.lit(0)).alias("n_train"), F.coalesce(F.sum(F.when(tested, F.col("n"))), F.lit(0)).alias("n_test"))
    return counts.where("n_train > 0 and n_test > 0")


def fraction_split(df: DataFrame, order: list[str], part: Column | None = None, fraction: float = 0.75) -> DataFrame:
    """df with `split` train / test: the first fraction of all rows in a total order, or of each part's.

    Rows are numbered by ranges of (part, order), so a part of a third of all rows is dealt over many tasks.
    """
    rows = df.withColumn("_part", F.lit(0) if part is None else part)
    placed = numbered(rows, [F.col("_part"), *(F.col(c) for c in order)], "_rn")
    ends = placed.groupBy("_part").agg(F.min("_rn").alias("_first"), F.count("*").alias("_n"))
    out = placed.join(ends.withColumnRenamed("_part", "_of"), F.col("_part").eqNullSafe(F.col("_of")))
    return out.withColumn("split", F.when(F.col("_rn") - F.col("_first") < F.floor(F.col("_n") * fraction), "train").otherwise("test")).drop("_part", "_of", "_rn", "_first", "_n")


def stratified(df: DataFrame, stratum: Column, quota: DataFrame, order: list[Column]) -> DataFrame:
    """The newest rows of each stratum up to its quota (stratum, quota); strata without one have no rows.

    The largest quota is a number in the plan, by which each task keeps so many rows of a stratum before they are shuffled.
    """
    most = quota.agg(F.max("quota")).first()[0] or 0
    ranked = df.withColumn("stratum", stratum).withColumn("_rn", F.row_number().over(Window.partitionBy("stratum").orderBy(*order))).where(F.col("_rn") <= int(most))
    return ranked.join(quota, "stratum").where("_rn <= quota").drop("_rn", "quota")
