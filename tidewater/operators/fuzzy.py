"""Fuzzy names: all pairs of names within an edit distance that grows with their length, and their clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import FUZZY_AT
from .graph import components
from .ranges import written

GRAM = 3


def _one_edit(names: DataFrame, percent: int) -> DataFrame:
    """a and b of all pairs of names (name, len) whose longer one is allowed one edit, each pair once and without comparing others.

    Names that differ in one letter are equal without it, at one place only; a name with a letter more is the other without
    one, of a run of equal letters without the last. So they meet by a hash of what is left, with the place beside it.
    """
    allowed = lambda c: (c * (100 - percent) >= 100) & (c * (100 - percent) < 200)
    last = "i = len - 1 or substring(name, i + 1, 1) <> substring(name, i + 2, 1)"
    without = F.expr(f"transform(sequence(0, len - 1), i -> struct(xxhash64(concat(substring(name, 1, i), substring(name, i + 2))) as key, i as place, {last} as last))")
    cut = names.where(allowed(F.col("len"))).select(F.explode(without).alias("k"), "name").select("k.key", "k.place", "k.last", "name")
    whole = names.where(allowed(F.col("len") + 1)).select(F.xxhash64("name").alias("key"), F.lit(-1).alias("place"), F.lit(False).alias("last"), "name")
    rows = cut.unionByName(whole)
    x, y = (rows.select("key", F.col("place").alias(f"{k}_place"), F.col("last").alias(f"{k}_last"), F.col("name").alias(k)) for k in ("a", "b"))
    changed = (F.col("a_place") == F.col("b_place")) & (F.col("b_place") >= 0) & (F.col("a") < F.col("b")) & (F.length("a") == F.length("b"))
    added = (F.col("a_place") < 0) & F.col("b_last")
    return x.join(y, "key").where((changed | added) & (F.expr("levenshtein(a, b, 1)") >= 0)).select("a", "b")


def _more_edits(names: DataFrame, percent: int) -> DataFrame:
    """a and b of all pairs of names (name, len) whose longer one is allowed two edits or more.

    With k edits two names share all but k * GRAM of their grams (runs of GRAM characters with two marks at either end,
    repeats counted apart), so that they meet in one of the k * GRAM + 1 rarest of each. Only names of lengths that allow a
    link meet there, and the join itself compares them, by the banded edit distance.
    """
    second = -(-200 // (100 - percent)) if percent < 100 else 2**31 - 1  # the least length that is allowed two edits
    names = names.where(F.col("len") >= (percent * second + 99) // 100)
    padded = F.concat(F.lit("\x01" * (GRAM - 1)), "name", F.lit("\x02" * (GRAM - 1)))
    grams = names.withColumn("padded", padded).withColumn("grams", F.expr(f"transform(sequence(1, len + {GRAM - 1}), i -> substring(padded, i, {GRAM}))"))
    numbered = F.expr("transform(grams, (g, i) -> xxhash64(g, size(filter(slice(grams, 1, i + 1), h -> h = g))))")
    rows = written(grams.select("name", "len", F.explode(numbered).alias("token")), "grams")
    counts = rows.groupBy("token").agg(F.count("*").alias("df"))
    most = F.expr(f"(({100 - percent} * (100 * len div {percent})) div 100) * {GRAM} + 1")  # edits to the longest name that can be linked
    ranked = rows.join(counts, "token").groupBy("name", "len").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))  # a name's own grams
    prefix = ranked.select("name", "len", F.explode(F.slice("ranked", F.lit(1), most.cast("int"))).alias("g")).where("g.df > 1").select("name", "len", "g.token")
    prefix = written(prefix, "gram-prefixes")
    short = prefix.select("token", "len", F.col("name").alias("a"))
    shortest = F.expr(f"cast(({percent} * len + 99) div 100 as int)")
    long = prefix.where(F.col("len") >= second).select("token", F.explode(F.sequence(shortest, F.col("len"))).alias("len"), F.col("name").alias("b"), F.expr(f"cast(({100 - percent} * len) div 100 as int)").alias("k"), F.col("len").alias("longer"))
    once = F.when(F.col("longer") == short["len"], F.col("a") < F.col("b")).otherwise(True)
    met = short.join(long, (short["token"] == long["token"]) & (short["len"] == long["len"]) & once & (F.expr("levenshtein(a, b, k)") >= 0))
    return met.select("a", "b").distinct()


def name_links(names: DataFrame, name: str, percent: int = round(100 * FUZZY_AT)) -> DataFrame:
    """left_name < right_name and distance of all pairs of distinct names with 1 - distance / length of the longer >= percent / 100.

    Exact for percent >= 80, without a cap. Null and empty names have no links.
    """
    if percent < 80:
        raise ValueError("under 80 percent short names need not share a gram")
    distinct = written(names.select(F.col(name).cast("string").alias("name")).where("name <> ''").distinct().withColumn("len", F.length("name")), "names")
    one = _one_edit(distinct, percent).withColumn("distance", F.lit(1))
    more = _more_edits(distinct, percent).withColumn("distance", F.levenshtein("a", "b"))
    return one.unionByName(more).select(F.least("a", "b").alias("left_name"), F.greatest("a", "b").alias("right_name"), "distance")


def name_clusters(names: DataFrame, name: str, percent: int = round(100 * FUZZY_AT)) -> DataFrame:
    """name and cluster (its least name) of every distinct name; what names are made of is read once."""
    distinct = written(names.select(F.col(name).cast("string").alias("name")).where("name is not null").distinct(), "all-names")
    links = name_links(distinct, "name", percent).select(F.col("left_name").alias("a"), F.col("right_name").alias("b"))
    of = components(links).select(F.col("node").alias("name"), "component")
    return distinct.join(of, "name", "left").select("name", F.coalesce("component", "name").alias("cluster"))
