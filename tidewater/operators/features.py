"""Feature tables: co-occurrence, TF-IDF, labels, weekly counts, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import EXPLOIT_SCORE, EXPLOIT_TAGS, TIERS
from ..functions.text import truthy, week


def tier_filter(df: DataFrame, accepted: list[str], tier: str = "tier") -> DataFrame:
    """Rows of accepted tiers; a missing tier is OBSERVED. Unknown tiers asked for are an error."""
    if unknown := set(accepted) - set(TIERS):
        raise ValueError(f"unknown tiers: {sorted(unknown)}")
    return df.where(F.coalesce(F.col(tier), F.lit("OBSERVED")).isin(accepted))


def cross_explode(df: DataFrame, sectors: str, tools: str) -> DataFrame:
    """A row for each sector with each tool of a record; no tools: one row with an empty tool; no sector: none."""
    one = F.when(F.size(tools) > 0, F.col(tools)).otherwise(F.array(F.lit("")))
    return df.withColumn("sector", F.explode(sectors)).withColumn("tool", F.explode(one))


def cooccurrence(df: DataFrame, sector: str, tool: str) -> DataFrame:
    """How many rows have each (sector, tool)."""
    return df.where(truthy(F.col(sector).cast("string")) & truthy(F.col(tool).cast("string"))).groupBy(sector, tool).agg(F.count("*").alias("tf"))


def tfidf(df: DataFrame, sector: str, tool: str) -> DataFrame:
    """sector, tool, tf, df and tfidf = tf * ln(sectors / df): 0 for a tool of all sectors.

    The counts are far smaller than the rows; df is a window over them, the number of sectors one broadcast row.
    """
    tf = cooccurrence(df, sector, tool)
    n = tf.agg(F.count_distinct(sector).alias("n_sectors"))
    own = tf.withColumn("df", F.count("*").over(Window.partitionBy(tool)))
    return own.crossJoin(F.broadcast(n)).select(sector, tool, "tf", "df", (F.col("tf") * F.log(F.col("n_sectors") / F.col("df"))).alias("tfidf"))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def label(tags: Column, score: Column) -> Column:
    """1 if the tags, joined in lower case, hold one of EXPLOIT_TAGS, else if the score is over 0.1, else 0."""
    text = F.lower(F.array_join(tags, " "))
    said = F.reduce(F.array(*(F.lit(t) for t in EXPLOIT_TAGS)), F.lit(False), lambda a, t: a | F.contains(text, t))
    return F.when(said, 1).when(score > EXPLOIT_SCORE, 1).otherwise(0)


def first_nonzero(*cols: Column) -> Column:
    """The first value that is neither null nor 0; 0.0 if there is none."""
    return F.coalesce(*(F.nullif(c.cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))


def weekly_counts(df: DataFrame, series: str, day: Column) -> DataFrame:
    """series, week_start (Monday) and n; rows without a date are left out."""
    return df.where(day.isNotNull()).groupBy(series, week(day).alias("week_start")).agg(F.count("*").alias("n"))


def densified(weekly: DataFrame, series: str, k: int) -> DataFrame:
    """Every observed week for each of the k largest series, 0 where it has none; k rows meet the weeks, not all series."""
    top = weekly.groupBy(series).agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), series).limit(k).select(series)
    weeks = weekly.select("week_start").distinct()
    return weeks.crossJoin(F.broadcast(top)).join(weekly, [series, "week_start"], "left").na.fill(0, ["n"])


def sector_trends(df: DataFrame, sector: str, series: str, day: Column, k: int) -> DataFrame:
    """Weekly counts of each sector's k largest series, 0 in weeks of the sector where one has none; rows without sector, series or date are left out."""
    full = df.where(truthy(F.col(sector).cast("string")) & truthy(F.col(series).cast("string")) & day.isNotNull())
    weekly = full.groupBy(sector, series, week(day).alias("week_start")).agg(F.count("*").alias("n"))
    top = top_k(weekly.groupBy(sector, series).agg(F.sum("n").alias("total")), [sector], [F.col("total").desc(), F.col(series)], k).select(sector, series)
    return top.join(weekly.select(sector, "week_start").distinct(), sector).join(weekly, [sector, series, "week_start"], "left").na.fill(0, ["n"])


def slopes(weekly: DataFrame, series: str) -> DataFrame:
    """Per series of two weeks or more: points, total, first, last and slope between its ends."""
    ends = weekly.groupBy(series).agg(F.count("*").alias("n_points"), F.sum("n").alias("total"), F.min_by("n", "week_start").alias("first_n"), F.max_by("n", "week_start").alias("last_n"))
    slope = (F.col("last_n") - F.col("first_n")) / F.greatest(F.col("n_points") - 1, F.lit(1))
    return ends.where("n_points >= 2").select("*", slope.alias("slope"), (slope > 0).alias("trending_up"))


def persistence(weekly: DataFrame, series: str, least: int = 8, holdout: int = 4) -> DataFrame:
    """Per series of `least` points: mean absolute error of its last value before the holdout, carried flat."""
    w = Window.partitionBy(series)
    rows = weekly.withColumn("rn", F.row_number().over(w.orderBy("week_start"))).withColumn("points", F.count("*").over(w)).where(F.col("points") >= least)
    carried = F.max(F.when(F.col("rn") == F.col("points") - holdout, F.col("n"))).over(w)
    return rows.withColumn("carried", carried).where(F.col("rn") > F.col("points") - holdout).groupBy(series).agg(F.avg(F.abs(F.col("n") - F.col("carried"))).alias("mae"))


def quarantine(df: DataFrame, ok: Column, reason: Column, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and (record_id, reason) of those that do not; a null check does not pass."""
    passed = F.coalesce(ok, F.lit(False))
    return df.where(passed), df.where(~passed).select(F.col(id_col).cast("string").alias("record_id"), reason.alias("reason"))
