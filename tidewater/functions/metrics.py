"""Ranking and calibration metrics as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import running_sums
from .fixed import BIN_EDGES


def rounded(c: Column, digits: int) -> Column:
    """A number to so many decimals as SQL engines in binary do it: scaled, rounded, scaled back.

    Spark's own round goes by the shortest decimal that a number prints as, so that 0.145 becomes 0.15; 0.145 * 100 is less
    than 14.5, which makes 0.14 here. Halves go away from zero.
    """
    scale = F.lit(float(10**digits))
    return F.round(c.cast("double") * scale) / scale


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row `average_precision`: precision summed over recall steps at distinct scores; 0 with one class only.

    Scores are counted before the running sums, which go over ranges of scores, not over all in one task.
    """
    by_score = df.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("hits"), F.count("*").alias("rows"))
    run = running_sums(by_score, [F.col("s").desc()], {"tp": "hits", "seen": "rows"})
    sums = run.agg(F.sum(F.col("hits") * F.col("tp") / F.col("seen")).alias("area"), F.sum("hits").alias("p"), F.max("seen").alias("n"))
    return sums.select(F.when((F.col("p") == 0) | (F.col("p") == F.col("n")) | F.col("p").isNull(), 0.0).otherwise(F.col("area") / F.col("p")).alias("average_precision"))


def bin_of(p: Column) -> Column:
    """Calibration bin [low, high); null for 1.0, which no bin holds."""
    return F.coalesce(*(F.when((p >= lo) & (p < hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(BIN_EDGES, BIN_EDGES[1:], strict=False))), F.lit(None).cast("int"))


def calibration_bins(df: DataFrame, label: str, score: str) -> DataFrame:
    """bin, n, mean score, rate of positives and weighted gap; gaps sum to the expected calibration error."""
    total = Window.partitionBy()
    bins = df.groupBy(bin_of(F.col(score)).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(label).alias("accuracy"))
    return bins.withColumn("all_n", F.sum("n").over(total)).where("bin is not null").select("bin", "n", "confidence", "accuracy", (F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n") / F.col("all_n")).alias("gap"))


def top_k_accuracy(df: DataFrame, label: str, score: str, k: int) -> DataFrame:
    """Positives among the k best scores over the most there could be."""
    top = df.orderBy(F.col(score).desc(), F.col(label).desc()).limit(k).agg(F.sum(label).alias("hits"))
    return top.crossJoin(df.agg(F.sum(label).alias("p"))).select((F.col("hits") / F.greatest(F.lit(1), F.least(F.lit(k), F.col("p")))).alias("top_k_accuracy"))  # one row each


def mean_absolute_error(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row; 0 without rows."""
    return df.agg(F.coalesce(F.avg(F.abs(F.col(actual) - F.col(predicted))), F.lit(0.0)).alias("mae"))


def ranking(predicted: DataFrame, actual: DataFrame, group: str, item: str, gain: str, k: int) -> DataFrame:
    """Per group: hits, precision, recall, f1, average precision and NDCG of the predictions.

    predicted: group, item, rank (1 ..); actual: group, item, gain (count). Groups without actual items have no row.
    """
    sizes = actual.groupBy(group).agg(F.count("*").alias("n_actual"))
    ideal = actual.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.col(gain).desc(), item)))
    lengths = predicted.where(F.col("rank") <= k).groupBy(group).agg(F.count("*").alias("n_predicted"))
    best = ideal.join(lengths, group).where("r <= n_predicted").groupBy(group).agg(F.sum(F.col(gain) / F.log2(F.col("r") + 1)).alias("ideal"))
    hit = predicted.where(F.col("rank") <= k).join(actual.withColumnRenamed(gain, "_gain"), [group, item], "left")
    run = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = hit.withColumn("hits", F.count("_gain").over(run)).withColumn("ok", F.col("_gain").isNotNull().cast("int"))
    sums = hit.groupBy(group).agg(F.sum("ok").alias("hits"), F.sum(F.col("ok") * F.col("hits") / F.col("rank")).alias("ap"), F.sum(F.coalesce("_gain", F.lit(0)) / F.log2(F.col("rank") + 1)).alias("dcg"))
    all_ = sums.join(sizes, group).join(lengths, group).join(best, group)
    p, r = F.col("hits") / F.col("n_predicted"), F.col("hits") / F.col("n_actual")
    return all_.select(
        group, "hits", "n_predicted", "n_actual", p.alias("precision"), r.alias("recall"), F.when(F.col("hits") == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"),
        (F.col("ap") / F.col("n_actual")).alias("average_precision"), F.when(F.col("ideal") == 0, 0.0).otherwise(F.col("dcg") / F.col("ideal")).alias("ndcg"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row `roc_auc`: the chance that a positive has the higher score of a positive and a negative, ties counting half; null with one class only.

    By mid-ranks: scores are counted first, then summed over ranges of scores. Rows without score or label do not count.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    by_score = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    run = running_sums(by_score, [F.col("s")], {"below": "neg"})
    sums = run.agg(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("area") / (F.col("p") * F.col("n"))).alias("roc_auc"))


def calibrated(df: DataFrame, label: str, score: str, out: str = "calibrated", fitted: DataFrame | None = None) -> DataFrame:
    """df with `out`: the score as a probability, by isotonic regression of the labels on the scores of `fitted` (df itself by default).

    Rows are counted by distinct score first. Blocks are pooled within ranges of scores and then at their seams; scores
    between two blocks are interpolated. Null without a score, or without a labelled row.
    """
    from pyspark.ml.regression import IsotonicRegression

    rows = (df if fitted is None else fitted).where(F.col(score).isNotNull() & F.col(label).isNotNull())
    by_score = rows.groupBy(F.col(score).cast("double").alias("_score")).agg(F.avg(F.col(label).cast("double")).alias("_rate"), F.count("*").cast("double").alias("_weight"))
    if by_score.isEmpty():
        return df.withColumn(out, F.lit(None).cast("double"))
    model = IsotonicRegression(featuresCol="_score", labelCol="_rate", weightCol="_weight", predictionCol="_calibrated").fit(by_score)
    asked = df.select("*", F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_score"))
    return model.transform(asked).withColumn(out, F.when(F.col(score).isNotNull(), F.col("_calibrated"))).drop("_score", "_calibrated")
