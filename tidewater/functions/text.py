"""Column functions for indicator text, tags, labels and small HTML."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import CASELESS_TYPES, DATE_PATTERN, IP_PATTERN, SCOPES, TECHNIQUE_PATTERN, WORKFLOW_PREFIXES


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def truthy(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


def refang(c: Column) -> Column:
    """Undo defanging: [.] and [dot] become a dot, a leading hxxp becomes http."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\[\.\]", "."), r"(?i)\[dot\]", "."), r"(?i)^hxxp", "http")


def observable_key(value: Column, kind: Column) -> Column:
    """value::type, the type in lower case, the value without white space around it and in lower case if its type has none."""
    kind = F.lower(F.coalesce(kind, F.lit("")))
    bare = strip(F.coalesce(value, F.lit("")))
    return F.concat(F.when(kind.isin(CASELESS_TYPES), F.lower(bare)).otherwise(bare), F.lit("::"), kind)


def alias(c: Column, names: dict[str, str]) -> Column:
    """The canonical name of a lower-cased, stripped alias; a name without one stays."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else None
    return F.coalesce(F.try_element_at(table, F.lower(strip(c))), c) if names else c


def normalise_tags(tags: Column, names: dict[str, str]) -> Column:
    """Tags without the workflow's, aliases mapped."""
    kept = F.filter(tags, lambda t: ~F.coalesce(F.reduce(F.array(*(F.lit(p) for p in WORKFLOW_PREFIXES)), F.lit(False), lambda a, p: a | t.startswith(p)), F.lit(True)))
    return F.transform(kept, lambda t: alias(t, names))


def taxonomy(c: Column, entries: list[tuple[str, str]], least: int = 8) -> Column:
    """Exact label, else the first entry longer than `least` that the label contains, else the label stripped.

    entries: (pattern, name) in order; of a repeated pattern the last name counts, at the first place.
    """
    names = dict(entries)
    key = F.lower(strip(c))
    inside = F.coalesce(*(F.when(key.contains(p), F.lit(n)) for p, n in names.items() if len(p) > least), F.lit(None).cast("string"))
    exact = F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key)
    return F.coalesce(exact, inside, strip(c))


def list_of(c: Column) -> Column:
    """A JSON array of strings as an array; malformed or plain text as one element; null and empty as none."""
    parsed = F.from_json(c, "array<string>")
    return F.when(~truthy(c), F.array().cast("array<string>")).when(c.startswith("["), F.coalesce(parsed, F.array(c))).otherwise(F.array(c))


def extract_all(c: Column, pattern: str) -> Column:
    """All matches of a pattern, as an array."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def day(c: Column) -> Column:
    """Date at the head of a timestamp string; null if there is none."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def week(c: Column) -> Column:
    """Monday of a date's week."""
    return F.date_trunc("week", c).cast("date")


def shingles(c: Column, n: int = 1, head: int | None = None) -> Column:
    """Distinct word n-grams, lower case, of the whole text or its first `head` characters."""
    words = F.filter(F.split(F.lower(F.substring(c, 1, head) if head else c), r"\s+"), lambda w: w != "")
    if n == 1:
        return F.array_distinct(words)
    # The words are bound once: inside a lambda they would be split again for every n-gram.
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(grams(w))))[0]


def confidence(extracted: Column, attempted: Column, finish: Column) -> Column:
    """Share of attempted fields that were extracted, less 0.1 for an unfinished answer, within 0 and 1."""
    share = F.size(extracted) / F.size(attempted) - F.when(finish == "end_turn", 0.0).otherwise(0.1)
    return F.when(F.size(attempted) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def _plain(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def timeline_events(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per <div class="...event..."> block: text, first date, techniques and first address of each."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<div[^>]*class=[\"'][^\"']*event[^\"']*[\"'][^>]*>(.*?)</div>"), F.lit(1))
    rows = pages.select("*", F.posexplode(blocks).alias("event_no", "block"))
    text = _plain(F.col("block"))
    return rows.select(
        *pages.columns, "event_no", F.substring(text, 1, 500).alias("raw_text"), F.try_element_at(extract_all(text, DATE_PATTERN), F.lit(1)).alias("event_date"),
        extract_all(text, TECHNIQUE_PATTERN).alias("techniques"), refang(F.try_element_at(extract_all(text, IP_PATTERN), F.lit(1))).alias("ioc"),
    )


def table_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Associations from table rows of four cells or more after the first row: source, relation, target, scope."""
    lines = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    rows = pages.select("*", F.posexplode(lines).alias("row_no", "line")).where("row_no > 0")
    cells = F.transform(F.regexp_extract_all(F.col("line"), F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), _plain)
    rows = rows.withColumn("cells", cells).where("size(cells) >= 4")
    cell = lambda i: F.try_element_at("cells", F.lit(i))
    scope = F.lower(cell(4))
    return rows.select(*pages.columns, "row_no", cell(1).alias("source_ref"), cell(2).alias("relationship_type"), cell(3).alias("target_ref"), F.when(scope.isin(SCOPES), scope).otherwise("unknown").alias("attribution_scope"))


#: Parsers of HTML by feed: DataFrame of pages to DataFrame of rows.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def parser(feed: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register the parser of a feed; a later one takes its place."""

    def put(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        PARSERS[feed] = f
        return f

    return put


parser("timeline")(timeline_events)
parser("associations")(table_edges)


def parse(pages: DataFrame, feed: str) -> DataFrame:
    """Rows that the feed's parser finds."""
    if feed not in PARSERS:
        raise KeyError(f"no parser for feed {feed!r}; known: {sorted(PARSERS)}")
    return PARSERS[feed](pages)
