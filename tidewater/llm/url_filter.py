"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

Each distinct (host, path) is expanded into the expressions that some rule could have: host suffixes with as many
labels as a rule's host, joined with path prefixes as long as a rule's path (both sets of numbers come from the
rules). Expressions meet rules in an equi-join on four bytes of SHA-256; the full digest confirms a hit, and the
longest rule wins. A tie goes to the longer host, then to "block", then to the smaller text. Without a rule the
verdict is "allow".

A null url, or one without "://", has an empty host and path and fits no rule; such pages go no further. All others
are judged once for each host and path, which are counted before they are shuffled, and joined back by them: a hot url
is one large key of that join, which adaptive execution splits. Very long urls are expanded only to the lengths of
rules. Repeated rows each have a verdict. Empty tables give no rows; no rules: all "allow". Only the named columns of the input are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def expressions(hosts: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """host, path and each expression: a host suffix of so many labels with a path prefix of so many characters."""
    parts = F.size(F.split("host", r"\.", -1))
    suffixes = F.array(*(F.when(parts >= n, F.substring_index("host", ".", -n)) for n in labels))
    prefixes = F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths))
    return (
        hosts.select("host", "path", F.explode(F.array_compact(suffixes)).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode(F.array_compact("prefixes")).alias("prefix"))
        .select("host", "path", F.concat("suffix", F.lit("\n"), "prefix").alias("expression"))
    )


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages` (page_id, url) by `rules` (host, path, verdict)."""
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict is not null")
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\.", -1))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count("*").alias("rows")).first()
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shape["rows"]:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    digest = _digest(F.concat("host", F.lit("\n"), "path"))
    known = rules.select(
        F.substring(digest, 1, 8).alias("short"), digest.alias("digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "block").cast("int").alias("blocks"),
            F.concat("host", "path").alias("rule"), F.col("verdict").alias("said"),
        ).alias("found"),
    )
    if shape["rows"] <= BROADCAST_ROWS // 10:  # counted; more rules are shuffled by their short hashes
        known = F.broadcast(known)
    none = pages.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    pages = pages.where("host <> ''")
    hosts = pages.select("host", "path").distinct()
    asked = expressions(hosts, sorted(shape["labels"]), sorted(shape["lengths"])).withColumn("sha", _digest(F.col("expression")))
    hits = asked.withColumn("short", F.substring("sha", 1, 8)).join(known, "short").where(F.col("sha") == F.col("digest"))
    best = hits.groupBy("host", "path").agg(F.max("found").alias("best"))
    judged = pages.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.said", F.lit("allow")).alias("verdict"))
    return judged.unionByName(none)
