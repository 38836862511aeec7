"""Preference formatting: pairs of conversations with their common turns rendered once.

`format_pairs` takes turns of a chosen and a rejected conversation per pair, finds the longest common prefix of
turns (equal role and text), renders it as the prompt, and renders the rest of each side as a completion with a
mask: the spans of assistant text, in characters of the completion, that a loss may see.

`neighbours` makes pairs from a table of conversations: each one against the next that opens with the same turn.
The order is total (opening, id) and is dealt by ranges of it, so an opening that a third of the conversations share
is spread over many tasks.

Turns are ordered by (turn, role, text), null turn numbers first; ties and repeated turns stay, and the text of a turn
is taken whole, however long. A conversation is one row, so that its turns together must fit an executor's memory, as they
must in any form that a trainer reads. Null roles and texts count as empty. Empty tables give no rows. A side
without turns has an empty completion; equal sides have all turns in the prompt and two empty completions. Rows without a pair id are left out. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_TURN = "struct<turn: bigint, role: string, text: string>"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: its id and its turns in order (array of turn, role, text)."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def opening(turns: Column) -> Column:
    """Hash of the first turn's role and text."""
    first = F.try_element_at(turns, F.lit(1))
    return F.sha2(F.concat_ws("\n", first["role"], first["text"]), 256)


def neighbours(turns: DataFrame) -> DataFrame:
    """pair_id (the chosen conversation's), rejected_id, chosen and rejected turns: each conversation with the next of its opening.

    A conversation without a later one of the same opening is in no pair as chosen one. The larger id counts as the
    rejected answer; with real preferences join the two sides yourself and call `format_pairs`.
    """
    convs = conversations(turns)
    key = ["opening", "conv_id"]
    # Only hashes and ids are sorted over the whole corpus; the written table keeps the part that each row was dealt to.
    light = materialize(convs.select(opening(F.col("turns")).alias("opening"), "conv_id").repartitionByRange(*key).select("*", F.spark_partition_id().alias("part")), "openings")
    heads = light.groupBy("part").agg(F.min(F.struct(*key)).alias("head"))  # one row per part
    ahead = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("ahead"))
    inside = Window.partitionBy("part").orderBy(*key)
    pairs = light.withColumn("next", F.lead(F.struct(*key)).over(inside)).join(ahead, "part").select("conv_id", "opening", F.coalesce("next", "ahead").alias("next"))
    pairs = pairs.where(F.col("next.opening") == F.col("opening")).select(F.col("conv_id").alias("pair_id"), F.col("next.conv_id").alias("rejected_id"))
    chosen = convs.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"))
    rejected = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    return pairs.join(chosen, "pair_id").join(rejected, "rejected_id").select("pair_id", "rejected_id", "chosen", "rejected")


def swapped(turns: DataFrame) -> DataFrame:
    """pair_id, chosen and rejected turns: each conversation against itself without its last assistant turn's answer.

    The rejected side answers the last assistant turn with that conversation's first assistant turn, a known way to
    get a wrong but fluent answer; a conversation with fewer than two assistant turns is answered with nothing: its
    last turn of the assistant is left out. Other turns stay, also empty ones.
    """
    convs = conversations(turns)
    said = F.filter("turns", lambda t: t["role"] == "assistant")
    last = F.array_max(F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == "assistant", i)))
    other = F.when(F.size(said) > 1, F.try_element_at(said, F.lit(1))["text"]).otherwise("")
    wrong = F.transform(F.col("turns"), lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == last, other).otherwise(t["text"]).alias("text")))
    rejected = F.filter(wrong, lambda t, i: ~F.coalesce((i == last) & (t["text"] == ""), F.lit(False)))
    return convs.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<"), turn["role"], F.lit(">\n"), turn["text"], F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _spans(turns: Column) -> Column:
    """Begin and end of each assistant text in the rendered turns, in characters."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin: int, end: int>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        begin = acc["at"] + F.length(turn["role"]) + 3
        end = begin + F.length(turn["text"])
        one = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(turn["role"] == "assistant", F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair's prompt (the common turns, rendered once), completions and their masks.

    Input: pair_id, chosen, rejected (arrays of turn, role, text). Output: pair_id, n_common, prompt,
    chosen_completion, rejected_completion (strings), chosen_mask, rejected_mask (arrays of begin, end).
    """
    both = F.arrays_zip(F.col("chosen").alias("a"), F.col("rejected").alias("b"))
    differs = F.transform(both, lambda z, i: F.when(~(z["a"]["role"].eqNullSafe(z["b"]["role"]) & z["a"]["text"].eqNullSafe(z["b"]["text"])), i))
    common = F.coalesce(F.array_min(differs), F.least(F.size("chosen"), F.size("rejected")))
    with_common = pairs.select("pair_id", "chosen", "rejected", common.alias("n_common"))
    cut = with_common.select("pair_id", "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("shared"), *(F.slice(k, F.col("n_common") + 1, F.greatest(F.size(k), F.lit(1))).alias(k) for k in ("chosen", "rejected")))
    return cut.select(
        "pair_id", "n_common", _rendered(F.col("shared")).alias("prompt"), _rendered(F.col("chosen")).alias("chosen_completion"), _rendered(F.col("rejected")).alias("rejected_completion"),
        _spans(F.col("chosen")).alias("chosen_mask"), _spans(F.col("rejected")).alias("rejected_mask"),
    )
