"""Trust of feeds where they conflict: weights of feeds and beliefs in values, each from the other, over fixed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import written

ROUNDS, START = 5, 0.8


def settled(claims: DataFrame, keys: list[str], value: str, feed: str, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Winners (keys, value, belief, n_feeds, first_feed) and feeds (feed, trust, n_claims), from what feeds claim of keys.

    A value's support is the sum of its feeds' trusts; its belief is its share of the support of all values of its keys. A
    feed's trust is the mean belief in what it claims. Every feed begins with START. Each round is a written table of feeds;
    claims are grouped with sums in each task first, so a key or a feed of very many claims is a row a task. The winner has
    the highest belief, of two that tie (to nine places) the smaller value. Claims without value or feed do not count; a
    claim that is repeated counts once.
    """
    said = claims.where(F.col(value).isNotNull() & F.col(feed).isNotNull()).select(*keys, F.col(value).alias("_value"), F.col(feed).alias("_feed")).distinct()
    said = written(said, "claims")
    trust = written(said.groupBy("_feed").agg(F.lit(START).alias("trust"), F.count("*").alias("n_claims")), "trust")

    def beliefs(trust: DataFrame) -> DataFrame:
        support = said.join(trust, "_feed").groupBy(*keys, "_value").agg(F.sum("trust").alias("support"), F.count("*").alias("n_feeds"), F.min("_feed").alias("first_feed"))
        return support.withColumn("belief", F.col("support") / F.sum("support").over(Window.partitionBy(*keys)))

    for _ in range(rounds):
        held = beliefs(trust).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_value").alias("_v"), "belief")
        same = said["_value"] == held["_v"]
        for i, k in enumerate(keys):
            same &= said[k].eqNullSafe(held[f"_k{i}"])
        trust = written(said.join(held, same).groupBy("_feed").agg(F.avg("belief").alias("trust"), F.count("*").alias("n_claims")), "trust")
    best = beliefs(trust).groupBy(*keys).agg(F.min(F.struct((-F.round("belief", 9)).alias("b"), F.col("_value").alias("v"), F.struct("belief", "n_feeds", "first_feed").alias("r"))).alias("w"))
    winners = best.select(*keys, F.col("w.v").alias(value), "w.r.belief", "w.r.n_feeds", "w.r.first_feed")
    return winners, trust.select(F.col("_feed").alias(feed), "trust", "n_claims")
