"""From raw records to entities and feature rows: selection, cleaning, lookups and explodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fixed import MALWARE_ALIASES
from .features import first_nonzero, label, quarantine


def in_window(df: DataFrame, day: Column, first: str, last: str, status: Column, wanted: str = "active") -> DataFrame:
    """Rows of a status whose day lies in the window, both ends in it; plain comparisons, so that files are skipped by them."""
    return df.where((day >= F.lit(first)) & (day <= F.lit(last)) & (status == F.lit(wanted)))


def of_types(df: DataFrame, kind: str, types: list[str], body: str | None = None) -> DataFrame:
    """Rows of some entity types, with a body if one is asked for."""
    rows = df.where(F.lower(kind).isin(types))
    return rows.where(F.col(body).isNotNull()) if body else rows


def clean_observables(raw: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Entities of raw observables, and (record_id, reason) of those without an id or a value.

    raw: id, value, itype, source, source_feed, confidence, created_ts, tags (array of text, or of structs with a name), and
    if there are such columns modified_ts, first_seen, last_seen and severity. Values are made whole again, the workflow's
    tags go, and aliases become names.
    """
    ok = F.col("id").isNotNull() & F.col("value").isNotNull()
    reason = F.when(F.col("id").isNull(), "no id").otherwise("no value")
    good, bad = quarantine(raw, ok, reason, "id")
    named = F.transform("tags", lambda t: F.coalesce(t["name"], F.lit(""))) if "struct" in raw.schema["tags"].dataType.simpleString() else F.col("tags")
    tags = F.filter(X.normalise_tags(F.coalesce(named, F.array().cast("array<string>")), MALWARE_ALIASES), lambda t: t != "")
    given = lambda c: (F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(c)
    value = X.refang(F.col("value"))
    entities = good.select(
        F.col("id").cast("string").alias("entity_id"), F.coalesce("itype", F.lit("observable")).alias("entity_type"), F.coalesce(F.nullif("source", F.lit("")), "source_feed", F.lit("")).alias("source_feed"),
        F.col("confidence").alias("source_confidence"), F.col("created_ts").alias("observed_ts"), value.alias("value"), tags.alias("tags"), F.lit("ok").alias("validation_status"),
        "created_ts", given("modified_ts"), given("first_seen"), given("last_seen"), F.struct(value.alias("value"), F.coalesce("itype", F.lit("")).alias("type")).alias("observable"),
        F.col("itype").alias("indicator_type"), given("severity"), "confidence",
        F.struct(F.lit(run_id).alias("run_id"), F.lit("OBSERVED").alias("tier")).alias("provenance"),
    )
    return entities, bad.withColumn("record_id", F.coalesce("record_id", F.lit("?")))


def described(df: DataFrame, kind: str, id_col: str, body: str, most: int | None = None) -> DataFrame:
    """Records with something to read: id (else kind-number), kind and description, whole or its first `most` characters."""
    full = df.where(F.coalesce(X.strip(F.col(body)), F.lit("")) != "")
    made = F.concat(F.lit(f"{kind}-"), F.monotonically_increasing_id().cast("string"))
    return full.select(F.coalesce(F.col(id_col).cast("string"), made).alias("id"), F.lit(kind).alias("entity_type"), (F.substring(body, 1, most) if most else F.col(body)).alias("description"))


def candidates(df: DataFrame, body: str, words: list[str], over: int = 500, under: int = 3000) -> DataFrame:
    """Records of middle length that hold one of the words, in lower case."""
    low = F.lower(body)
    said = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    return df.where((F.length(body) > over) & (F.length(body) < under) & said)


def day_lookup(frames: list[DataFrame], id_col: str, ts: str) -> DataFrame:
    """entity_id and created_ts (a date as text): of an id in several tables the last table's, of several rows the latest."""
    rows = [f.select(F.col(id_col).cast("string").alias("entity_id"), F.substring(F.col(ts).cast("string"), 1, 10).alias("day"), F.lit(k).alias("rank")) for k, f in enumerate(frames)]
    full = reduce(DataFrame.unionByName, rows).where(X.truthy(F.col("entity_id")) & X.truthy(F.col("day")))
    return full.groupBy("entity_id").agg(F.max_by("day", F.struct("rank", "day")).alias("created_ts"))


def with_day(df: DataFrame, lookup: DataFrame, id_col: str) -> DataFrame:
    """df with created_ts; empty where the lookup has none."""
    found = lookup.withColumnRenamed("entity_id", "_looked")
    return df.join(found, F.col(id_col).cast("string") == F.col("_looked"), "left").drop("_looked").withColumn("created_ts", F.coalesce("created_ts", F.lit("")))


def vulnerability_features(entities: DataFrame, raw: DataFrame, lookup: DataFrame) -> DataFrame:
    """Labelled rows of entities of type cve or vulnerability.

    entities: entity_id, entity_type; raw: id, epss_score, epss_percentile, cvss3_score, cvss2_score, tags. An entity
    without a raw record has zeros, no tags and the label 0.
    """
    rows = of_types(entities, "entity_type", ["cve", "vulnerability"]).join(raw.withColumnRenamed("id", "_raw"), F.col("entity_id") == F.col("_raw"), "left").drop("_raw")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    built = rows.select(
        "entity_id", zero("epss_score"), first_nonzero(F.col("cvss3_score"), F.col("cvss2_score")).alias("cvss_score"), zero("epss_percentile"), F.size(tags).alias("tag_count"),
        label(tags, F.coalesce(F.col("epss_score"), F.lit(0.0))).alias("exploited"), F.lit("OBSERVED").alias("tier"),
    )
    return with_day(built, lookup, "entity_id")


def company_rows(df: DataFrame, companies: str) -> DataFrame:
    """A row for each company that has a name: company_name, company_stix_id and extraction_confidence (the record's where the company has none)."""
    each = df.withColumn("_c", F.explode(companies)).where(X.truthy(F.col("_c.name")))
    own = F.coalesce(F.nullif(F.col("_c.extraction_confidence"), F.lit(0.0)), F.nullif("confidence", F.lit(0.0)), F.lit(0.0))
    return each.select(*(c for c in df.columns if c not in (companies, "confidence")), F.col("_c.name").alias("company_name"), F.coalesce("_c.stix_id", F.lit("")).alias("company_stix_id"), own.alias("extraction_confidence"))


def first_of_each(df: DataFrame, group: Column, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with `feed` and `place`: a sample to look at."""
    from pyspark.sql import Window

    return df.withColumn("feed", group).withColumn("place", F.row_number().over(Window.partitionBy("feed").orderBy(*order))).where(F.col("place") <= k)


def described_tools(names: DataFrame, tool: str, known: list[tuple[str, str]], other: str) -> DataFrame:
    """names with `description`: that of the tool, else of the first known one that it holds or that holds it, else `other`."""
    key = F.lower(X.strip(F.col(tool)))
    exact = [F.when(key == k, F.lit(v)) for k, v in known]
    inside = [F.when(F.contains(key, F.lit(k)) | F.contains(F.lit(k), key), F.lit(v)) for k, v in known]
    return names.withColumn("description", F.coalesce(*exact, *inside, F.lit(other)))
