"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit.

One pass encodes the texts; grouping by length shrinks the corpus to one row per distinct length before any
shuffle. Suffix sums go over blocks of lengths first (few rows) and then inside each block, so no task sees the
whole histogram. A limit between two lengths has the answers of the next lower length, moved by `n_longer` tokens
for each step.

Null text counts as empty: a document of 0 tokens. A very long text is encoded whole, as a piece of its own. Repeated
rows count each. An empty table gives an empty
histogram. Extra columns are ignored unless named in `by`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import token_counts

BLOCK = 256


def length_histogram(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens and n_docs: how many documents have each encoded length."""
    return token_counts(docs, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: documents and tokens up to it and beyond it, and totals if texts are cut there.

    Columns: n_tokens, n_docs, n_at_most, n_longer, tokens_at_most, tokens_longer, truncated_total (tokens left if
    every document is cut at this limit), truncated_loss, quantile (share of documents at most this long).
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = blocks.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t")).select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(whole).alias("docs_all"), F.sum("t").over(whole).alias("tokens_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)

    def after(each: Column, rest: str) -> Column:
        return F.coalesce(F.sum(each).over(inside), F.lit(0)) + F.col(rest)

    longer, more = F.col("n_longer"), F.col("tokens_longer")
    out = blocks.join(sums, "block").withColumns({"n_longer": after(F.col("n_docs"), "docs_after"), "tokens_longer": after(tokens, "tokens_after")})
    return out.select(
        "n_tokens", "n_docs", (F.col("docs_all") - longer).alias("n_at_most"), longer, (F.col("tokens_all") - more).alias("tokens_at_most"), more,
        (F.col("tokens_all") - more + longer * F.col("n_tokens")).alias("truncated_total"), (more - longer * F.col("n_tokens")).alias("truncated_loss"),
        ((F.col("docs_all") - longer) / F.col("docs_all")).alias("quantile"),
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row: n_longer, truncated_total and truncated_loss at any context limit, from the histogram's suffix sums."""
    below = sums.where(F.col("n_tokens") <= limit).agg(F.max(F.struct("n_tokens", "n_longer", "tokens_at_most", "tokens_longer")).alias("b"))
    whole = sums.agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t"))
    longer = F.coalesce(F.col("b.n_longer"), F.col("d"), F.lit(0))
    more = F.coalesce(F.col("b.tokens_longer"), F.col("t"), F.lit(0))
    one = below.withColumn("k", F.lit(1)).join(whole.withColumn("k", F.lit(1)), "k")  # one row each
    return one.select(F.lit(limit).cast("long").alias("n_limit"), longer.alias("n_longer"), (F.coalesce("t", F.lit(0)) - more + longer * limit).alias("truncated_total"), (more - longer * limit).alias("truncated_loss"))


def at_quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of the documents does not exceed (null for no documents)."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
