"""Registered queries over records, feature tables and forecasts, each beside its SQL.

As in `queries`, the tables stand in for records: users are sectors, event types or parts are tools, documents are
records with text, labels and pages give their raw fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..operators import dedup as D
from ..operators import features as A
from ..operators import records as R
from ..operators import splits as S
from ..operators import tasks as T
from ..sources.tables import row_counts, table
from .registry import STAR, query, star

_KINDS = ["URL", "C2_Domain", "md5", "ip", "Mal_URL"]
_CASELESS = ", ".join(f"'{k}'" for k in fixed.CASELESS_TYPES)


def _observables(spark: SparkSession, d: str) -> DataFrame:
    """Pages as raw observables, with types, spaces and cases made up from the id."""
    kind = F.array(*(F.lit(k) for k in _KINDS))[(F.col("page_id") % 5).cast("int")]
    value = F.concat(F.lit("  "), F.when(F.col("page_id") % 2 == 0, F.upper("url")).otherwise(F.col("url")), F.lit("\t"))
    return table(spark, d, "pages").select("page_id", value.alias("value"), kind.alias("itype"))


OBSERVABLES = f"SELECT page_id, '  ' || CASE WHEN page_id % 2 = 0 THEN upper(url) ELSE url END || chr(9) AS value, {_KINDS}[page_id % 5 + 1] AS itype FROM pages"
KEYED = f"SELECT page_id, CASE WHEN lower(itype) IN ({_CASELESS}) THEN lower(trim(value, ' ' || chr(9))) ELSE trim(value, ' ' || chr(9)) END || '::' || lower(itype) AS key FROM ({OBSERVABLES})"


@query(KEYED)
def observable_key(spark: SparkSession, d: str) -> DataFrame:
    """The dedup key of every observable."""
    return _observables(spark, d).select("page_id", X.observable_key(F.col("value"), F.col("itype")).alias("key"))


SITES = f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN upper(site) ELSE site || ' ' END AS value, {_KINDS}[page_id % 5 + 1] AS itype FROM (SELECT page_id, regexp_extract(url, '(example\\.[a-z]+)', 1) AS site FROM pages)"


@query(f"SELECT key AS dedup_key, min(page_id) AS page_id, count(*) AS distinct_event_count, CASE WHEN count(*) > 1 THEN 'merged' ELSE 'singleton' END AS dedup_status FROM ({KEYED.replace(OBSERVABLES, SITES)}) GROUP BY 1")
def observable_merge(spark: SparkSession, d: str) -> DataFrame:
    """Observables of one key are one record: sites in either case, of types with case and without."""
    site = F.regexp_extract("url", r"(example\.[a-z]+)", 1)
    rows = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.upper(site)).otherwise(F.concat(site, F.lit(" "))).alias("value"), F.array(*(F.lit(k) for k in _KINDS))[(F.col("page_id") % 5).cast("int")].alias("itype"))
    out = D.canonical(rows, X.observable_key(F.col("value"), F.col("itype")), "page_id", "itype", F.lit(0), "page_id", ["page_id"])
    return out.select("dedup_key", "page_id", "distinct_event_count", "dedup_status")


_TAGS = ["PIR-7", "beacon", "CoBeacon", "apt", "pirate", "x"]
RAW = f"""SELECT CASE WHEN page_id % 7 = 3 THEN NULL ELSE page_id END AS id, CASE WHEN page_id % 11 = 5 THEN NULL ELSE replace(replace(url, '.', '[.]'), 'http', 'hxxp') END AS value, {_KINDS}[page_id % 5 + 1] AS itype,
CASE WHEN page_id % 4 = 0 THEN '' ELSE 'feed' || page_id % 4 END AS source, 'other' AS source_feed, page_id % 100 AS confidence, [{_TAGS}[page_id % 6 + 1], {_TAGS}[(page_id + 1) % 6 + 1]] AS tags FROM pages"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Pages as raw observables of which some lack an id, a value or a source."""
    k, tags = F.col("page_id"), F.array(*(F.lit(t) for t in _TAGS))
    return table(spark, d, "pages").select(
        F.when(k % 7 != 3, k).alias("id"), F.when(k % 11 != 5, F.replace(F.replace("url", F.lit("."), F.lit("[.]")), F.lit("http"), F.lit("hxxp"))).alias("value"), F.array(*(F.lit(t) for t in _KINDS))[(k % 5).cast("int")].alias("itype"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("feed"), (k % 4).cast("string"))).alias("source"), F.lit("other").alias("source_feed"), (k % 100).alias("confidence"), F.lit(None).cast("string").alias("created_ts"),
        F.array(tags[(k % 6).cast("int")], tags[((k + 1) % 6).cast("int")]).alias("tags"),
    )


@query(f"""SELECT id::VARCHAR AS entity_id, itype AS entity_type, coalesce(nullif(source, ''), source_feed, '') AS source_feed, confidence AS source_confidence, regexp_replace(replace(value, '[.]', '.'), '^hxxp', 'http') AS value,
array_to_string(list_transform(list_filter(tags, lambda t: NOT (starts_with(t, 'Ilamona_') OR starts_with(t, 'PIR') OR starts_with(t, 'ilamona_') OR starts_with(t, 'pir'))), lambda t: CASE WHEN lower(t) IN ('beacon', 'cobeacon') THEN 'Cobalt Strike' ELSE t END), ',') AS tags
FROM ({RAW}) WHERE id IS NOT NULL AND value IS NOT NULL""")
def tier1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Raw observables as entities."""
    rows = R.clean_observables(_raw(spark, d), "run")[0]
    return rows.select("entity_id", "entity_type", "source_feed", "source_confidence", "value", F.array_join("tags", ",").alias("tags"))


@query(f"SELECT coalesce(id::VARCHAR, '?') AS record_id, CASE WHEN id IS NULL THEN 'no id' ELSE 'no value' END AS reason FROM ({RAW}) WHERE id IS NULL OR value IS NULL")
def tier1_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Raw observables that are no entities, and why."""
    return R.clean_observables(_raw(spark, d), "run")[1]


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate >= '1996-03-01' AND o_orderdate <= '1997-03-01' AND o_orderstatus = 'F'", days=("day",))
def window_status_filter(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a status in a window, both ends in it; the filter goes to the scan."""
    rows = R.in_window(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), F.col("o_orderdate"), "1996-03-01", "1997-03-01", F.col("o_orderstatus"), "F")
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("day"))


_TYPES = ["signup", "click", "view", "purchase"]
LOOKUP = f"""SELECT entity_id, max_by(day, k || day) AS created_ts FROM (SELECT user_id::VARCHAR AS entity_id, ts::DATE::VARCHAR AS day, list_position({_TYPES}, event_type) AS k FROM events WHERE event_type IN {tuple(_TYPES)}) GROUP BY 1"""


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    """Dates of users, from a table for each kind of event; users without an event have none."""
    events = table(spark, d, "events").select("user_id", "event_type", "ts")
    return R.day_lookup([events.where(F.col("event_type") == k) for k in _TYPES], "user_id", "ts")


@query(f"SELECT c_custkey, coalesce(created_ts, '') AS created_ts FROM customer LEFT JOIN ({LOOKUP}) ON entity_id = c_custkey::VARCHAR")
def ts_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Entities with their date, the last table's that has one; no date: empty."""
    return R.with_day(table(spark, d, "customer").select("c_custkey"), _lookup(spark, d), "c_custkey")


_SIGNS = ["Observed-In-The-Wild:Yes", "observed-in-the-wild:no", "was-zero-day:Yes", "exploitation-state:anticipated", "exploitation-state:Weaponized"]
VULN = f"""WITH e AS (SELECT doc_id::VARCHAR AS entity_id, doc_id, ['cve', 'actor', 'vulnerability', 'CVE'][doc_id % 4 + 1] AS entity_type FROM documents),
r AS (SELECT doc_id::VARCHAR AS id, toxic * 0.4 AS epss_score, quality * 0.25 AS epss_percentile, quality * 7.5 AS cvss3_score, 5.0 AS cvss2_score, [{_SIGNS}[doc_id % 5 + 1], 'other'] AS tags FROM labels)
SELECT e.entity_id, coalesce(epss_score, 0)::DOUBLE AS epss_score, coalesce(nullif(cvss3_score, 0), cvss2_score, 0)::DOUBLE AS cvss_score, coalesce(epss_percentile, 0)::DOUBLE AS epss_percentile, coalesce(len(tags), 0)::INT AS tag_count,
CASE WHEN len(list_intersect(list_transform(tags, lambda t: lower(t)), ['observed-in-the-wild:yes', 'was-zero-day:yes', 'exploitation-state:weaponized', 'exploitation-state:exploited'])) > 0 THEN 1 WHEN epss_score > 0.1 THEN 1 ELSE 0 END AS exploited,
'OBSERVED' AS tier, coalesce(l.created_ts, '') AS created_ts FROM e LEFT JOIN r ON e.entity_id = r.id LEFT JOIN ({LOOKUP}) l ON l.entity_id = e.entity_id WHERE lower(entity_type) IN ('cve', 'vulnerability')"""


def _vulnerabilities(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entities, their labels as raw vulnerabilities."""
    k = F.col("doc_id")
    entities = table(spark, d, "documents").select(k.cast("string").alias("entity_id"), F.array(*(F.lit(t) for t in ("cve", "actor", "vulnerability", "CVE")))[(k % 4).cast("int")].alias("entity_type"))
    raw = table(spark, d, "labels").select(
        k.cast("string").alias("id"), (F.col("toxic") * 0.4).alias("epss_score"), (F.col("quality") * 0.25).alias("epss_percentile"), (F.col("quality") * 7.5).alias("cvss3_score"), F.lit(5.0).alias("cvss2_score"),
        F.array(F.array(*(F.lit(t) for t in _SIGNS))[(k % 5).cast("int")], F.lit("other")).alias("tags"),
    )
    return R.vulnerability_features(entities, raw, _lookup(spark, d))


@query(VULN)
def vulnerability_features(spark: SparkSession, d: str) -> DataFrame:
    """Labelled feature rows of vulnerabilities: scores, number of tags, label and date."""
    return _vulnerabilities(spark, d).drop("entity_type")


@query()
def exploit_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """A forest of 100 trees on three scores, the last 30 days held out, against the plain score.

    Trees are no deeper than 12, for bounded models; SQL has no forests.
    """
    rows = _vulnerabilities(spark, d).withColumn("first_seen", F.nullif("created_ts", F.lit(""))).withColumn("ord", F.col("entity_id").cast("bigint"))
    return T.task("t1", rows).evaluate()


@query()
def label_forest(spark: SparkSession, d: str) -> DataFrame:
    """The same evaluation with features of texts and the label of good quality; texts have no date, so the last fifth by id is held out."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("epss_score"), F.length(F.regexp_replace("text", r"[^#*$%&|!]", "")).cast("double").alias("cvss_score"), F.size(F.split("text", "\n")).cast("double").alias("tag_count"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("exploited")), "doc_id")
    most = rows.agg(F.max("epss_score").alias("most"))
    rows = rows.crossJoin(F.broadcast(most)).withColumn("epss_score", F.col("epss_score") / F.col("most")).drop("most")  # one row
    return T.task("t1", rows.withColumn("first_seen", F.lit(None).cast("string")).withColumn("ord", F.col("doc_id"))).evaluate()


@query("""SELECT p_partkey, s AS sector, t AS tool FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS s, tools FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN ['A' || p_size, p_brand] WHEN 1 THEN [p_brand] ELSE [''] END AS tools FROM part)), unnest(tools) AS u(t)""")
def sector_tool_explode(spark: SparkSession, d: str) -> DataFrame:
    """A row for each sector with each tool; tools are JSON arrays, plain text or nothing."""
    size = F.col("p_size") % 3
    raw = F.when(size == 0, F.to_json(F.array(F.concat(F.lit("A"), F.col("p_size").cast("string")), "p_brand"))).when(size == 1, F.col("p_brand"))
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("sectors"), X.list_of(raw).alias("tools"))
    return A.cross_explode(rows, "sectors", "tools").select("p_partkey", "sector", "tool")


@query("""SELECT o_orderkey, c.name AS company_name, coalesce(c.stix_id, '') AS company_stix_id, coalesce(nullif(c.conf, 0), nullif(confidence, 0), 0)::DOUBLE AS extraction_confidence
FROM (SELECT o_orderkey, (o_orderkey % 4) / 4 AS confidence, [{'name': 'C' || o_custkey, 'stix_id': CASE WHEN o_custkey % 2 = 0 THEN 'id' || o_custkey END, 'conf': (o_custkey % 3) / 4}, {'name': CASE WHEN o_custkey % 5 = 0 THEN '' ELSE o_orderpriority END, 'stix_id': NULL, 'conf': 0.0}] AS cs FROM orders), unnest(cs) AS u(c) WHERE c.name <> ''""")
def company_explode(spark: SparkSession, d: str) -> DataFrame:
    """A row for each named company of a record."""
    k = F.col("o_custkey")
    one = lambda name, stix, conf: F.struct(name.alias("name"), stix.alias("stix_id"), conf.alias("extraction_confidence"))
    first = one(F.concat(F.lit("C"), k.cast("string")), F.when(k % 2 == 0, F.concat(F.lit("id"), k.cast("string"))), (k % 3) / 4)
    second = one(F.when(k % 5 == 0, "").otherwise(F.col("o_orderpriority")), F.lit(None).cast("string"), F.lit(0.0))
    rows = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 4) / 4).alias("confidence"), F.array(first, second).alias("companies"))
    return R.company_rows(rows, "companies")


@query("SELECT doc_id::VARCHAR AS id, 'report' AS entity_type, md5(text) AS digest FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def described_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents with something to read, whole."""
    rows = R.described(table(spark, d, "documents"), "report", "doc_id", "text")
    return rows.select("id", "entity_type", F.md5(F.col("description").cast("binary")).alias("digest"))


_WORDS = ["license", "copyright", "infrastructure", "bank", "@", "http"]


@query(f"SELECT doc_id FROM documents WHERE length(text) > 500 AND length(text) < 3000 AND ({' OR '.join(f'''contains(lower(text), '{w}')''' for w in _WORDS)})")
def candidate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of middle length that hold one of some words."""
    return R.candidates(table(spark, d, "documents").select("doc_id", "text"), "text", _WORDS).select("doc_id")


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS feed, row_number() OVER (PARTITION BY coalesce(nullif(source, ''), 'unknown') ORDER BY doc_id) AS place, doc_id, md5(text) AS digest FROM documents QUALIFY place <= 50")
def blobs_per_feed(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty texts of every feed: the sample that discovery looks at."""
    rows = R.first_of_each(table(spark, d, "documents").select("doc_id", "text", "source"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")), [F.col("doc_id")], 50)
    return rows.select("feed", F.col("place").cast("long").alias("place"), "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


SUMMED = f"""WITH star AS ({STAR}), tf AS (SELECT n_name, p_partkey, count(*) AS tf FROM star GROUP BY ALL), n AS (SELECT count(DISTINCT n_name) AS n FROM tf),
w AS (SELECT n_name, p_partkey, tf, round(tf * ln(n / count(*) OVER (PARTITION BY p_partkey)), 4) AS each FROM tf, n), s AS (SELECT *, CASE WHEN (SELECT max(each) FROM w) > 0 THEN tf * each ELSE tf END AS score FROM w)"""


@query(f"{SUMMED} SELECT n_name, p_partkey, round(score, 4) AS score, row_number() OVER (PARTITION BY n_name ORDER BY round(score, 4) DESC, p_partkey) AS rank FROM s QUALIFY rank <= 3")
def summed_tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three best tools of each sector where every row carries its pair's score."""
    scores = T.summed_scores(star(spark, d), "n_name", "p_partkey").withColumn("score", F.round("score", 4))
    return A.top_k(scores, ["n_name"], [F.col("score").desc(), F.col("p_partkey")], 3).select("n_name", "p_partkey", "score", "rank")


@query(f"{SUMMED} SELECT n_name, each AS score, row_number() OVER (PARTITION BY n_name ORDER BY each DESC) AS rank FROM (SELECT DISTINCT n_name, each FROM w) QUALIFY rank <= 3")
def distinct_top_scores(spark: SparkSession, d: str) -> DataFrame:
    """The three largest different scores of each sector."""
    scores = A.tfidf(star(spark, d), "n_name", "p_partkey").select("n_name", F.round("tfidf", 4).alias("score")).distinct()
    return A.top_k(scores, ["n_name"], [F.col("score").desc()], 3)


@query(f"{SUMMED} SELECT n_name, p_partkey, each AS score, row_number() OVER (PARTITION BY n_name ORDER BY each DESC, p_partkey) AS rank FROM (SELECT DISTINCT n_name, p_partkey, each FROM w) QUALIFY rank <= 3")
def distinct_top_tools(spark: SparkSession, d: str) -> DataFrame:
    """The three tools of largest score of each sector, of different pairs of tool and score."""
    scores = A.tfidf(star(spark, d), "n_name", "p_partkey").select("n_name", "p_partkey", F.round("tfidf", 4).alias("score")).distinct()
    return A.top_k(scores, ["n_name"], [F.col("score").desc(), F.col("p_partkey")], 3)


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS feed, count(*) AS n, sum(strlen(text))::BIGINT AS n_bytes, min(doc_id) AS first_id, max(doc_id) AS last_id, count(DISTINCT md5(text)) AS n_different FROM documents GROUP BY 1")
def feed_blobs(spark: SparkSession, d: str) -> DataFrame:
    """All texts of every feed summed up: how many, how many different ones, their bytes; no feed is one row of its texts."""
    feed = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("feed")
    rows = table(spark, d, "documents").select(feed, "doc_id", F.octet_length("text").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("digest"))
    each = rows.groupBy("feed", "digest").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return each.groupBy("feed").agg(F.sum("n").alias("n"), F.sum("bytes").alias("n_bytes"), F.min("low").alias("first_id"), F.max("high").alias("last_id"), F.count("digest").alias("n_different"))


@query("SELECT event_type AS tool, 0.0::DOUBLE AS slope, count(*) AS last_n, count(*) AS total, 1 AS n_points, false AS trending_up FROM events WHERE event_type <> '' GROUP BY 1")
def flat_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Totals of tools in the form of trends."""
    return T.flat_totals(table(spark, d, "events").withColumnRenamed("event_type", "tool"), "tool")


@query("""WITH w AS (SELECT event_type, date_trunc('week', ts)::DATE AS week_start, count(*) AS n FROM events GROUP BY ALL)
SELECT a.event_type, a.week_start, a.n, coalesce(b.n, 0) AS previous FROM w a LEFT JOIN w b ON a.event_type = b.event_type AND b.week_start = a.week_start - 7""", days=("week_start",))
def previous_period(spark: SparkSession, d: str) -> DataFrame:
    """Each week's count beside that of the week before, the plainest forecast."""
    return T.previous_period(A.weekly_counts(table(spark, d, "events"), "event_type", F.to_date("ts")), "event_type")


@query("SELECT event_type AS model, round(avg(value), 6) AS mean_value, round(avg(user_id), 6) AS mean_user, count(*) AS n FROM events GROUP BY 1")
def comparison_means(spark: SparkSession, d: str) -> DataFrame:
    """Means by what is compared."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg("user_id"), 6).alias("mean_user"), F.count("*").alias("n"))


@query(r"""WITH f AS (SELECT doc_id, lower(text) AS t, text, lang, source FROM documents), g AS (SELECT doc_id, (CASE WHEN lang <> '' THEN 1 ELSE 0 END + CASE WHEN source <> '' THEN 1 ELSE 0 END + regexp_matches(text, '\d{4}-\d{2}-\d{2}')::INT + regexp_matches(text, 'T\d{4}')::INT + contains(text, '@')::INT + contains(text, 'http')::INT) / 6 AS field_coverage,
((contains(lower(lang), 'en') OR contains(lower(lang), 'fr'))::INT + (contains(t, 'license') OR contains(t, 'the '))::INT) / 2 AS inference_score FROM f)
SELECT doc_id, round(field_coverage, 2) AS field_coverage, round(inference_score, 2) AS inference_score, round((field_coverage + inference_score) / 2, 4) AS total FROM g""")
def extraction_scores(spark: SparkSession, d: str) -> DataFrame:
    """How many of six facets are there, whether one of some expected words is, and the mean of both."""
    t, low, flag = F.col("text"), F.lower("text"), lambda c: F.coalesce(c.cast("int"), F.lit(0))
    fields = [X.truthy(F.col("lang")), X.truthy(F.col("source")), t.rlike(fixed.DATE_PATTERN), t.rlike(r"T\d{4}"), t.contains("@"), t.contains("http")]
    coverage = sum((flag(c) for c in fields), F.lit(0)) / 6
    hits = (flag(F.lower("lang").contains("en") | F.lower("lang").contains("fr")) + flag(low.contains("license") | low.contains("the "))) / 2
    return table(spark, d, "documents").select("doc_id", F.round(coverage, 2).alias("field_coverage"), F.round(hits, 2).alias("inference_score"), F.round((coverage + hits) / 2, 4).alias("total"))


_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM {k}" for k in _NAMES))
def metadata_row_count(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each table has; no column is read."""
    return row_counts(spark, d, _NAMES)


_ABOUT = [("cold widget", "Keeps."), ("widget", "Does."), ("gear", "Turns.")]


@query("""SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'cold widget' THEN 'Keeps.' WHEN lower(p_name) = 'widget' THEN 'Does.' WHEN lower(p_name) = 'gear' THEN 'Turns.'
WHEN contains(lower(p_name), 'cold widget') OR contains('cold widget', lower(p_name)) THEN 'Keeps.' WHEN contains(lower(p_name), 'widget') OR contains('widget', lower(p_name)) THEN 'Does.'
WHEN contains(lower(p_name), 'gear') OR contains('gear', lower(p_name)) THEN 'Turns.' ELSE 'Unknown.' END AS description FROM part""")
def tool_info(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each tool, by its name or the first known name that it holds or that holds it."""
    return R.described_tools(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", _ABOUT, "Unknown.")


def _metrics(train: str, test: str) -> str:
    """SQL of `held_out` over events, from conditions on x (events with day, last day and place)."""
    return f"""WITH x AS (SELECT user_id, event_type, ts::DATE AS day, (max(ts) OVER ())::DATE - 7 AS start, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS c FROM events),
tr AS (SELECT user_id, event_type, count(*) AS n FROM x WHERE {train} GROUP BY ALL), ho AS (SELECT user_id, event_type, count(*) AS gain FROM x WHERE {test} GROUP BY ALL),
pr AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM tr WHERE user_id IN (SELECT user_id FROM ho) QUALIFY rank <= 3), gl AS (SELECT event_type FROM tr GROUP BY 1 ORDER BY sum(n) DESC, event_type LIMIT 3),
hit AS (SELECT p.user_id, p.rank, h.gain, count(h.gain) OVER (PARTITION BY p.user_id ORDER BY p.rank) AS run FROM pr p LEFT JOIN ho h USING (user_id, event_type)),
s AS (SELECT user_id, count(gain) AS hits, count(*) AS np, coalesce(sum(run / rank) FILTER (gain IS NOT NULL), 0) AS ap, sum(coalesce(gain, 0) / log2(rank + 1)) AS dcg FROM hit GROUP BY 1),
i AS (SELECT user_id, gain, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, event_type) AS r FROM ho), a AS (SELECT user_id, count(*) AS na FROM ho GROUP BY 1), b AS (SELECT user_id, count(*) AS base FROM ho JOIN gl USING (event_type) GROUP BY 1),
e AS (SELECT s.*, na, coalesce(base, 0) AS base, dcg / (SELECT sum(gain / log2(r + 1)) FROM i WHERE i.user_id = s.user_id AND r <= np) AS ndcg FROM s JOIN a USING (user_id) LEFT JOIN b USING (user_id)),
m AS (SELECT (SELECT count(*) FROM x WHERE {train}) AS train_rows, (SELECT count(*) FROM x WHERE {test}) AS holdout_rows, count(*) AS sectors, sum(hits) / sum(np) AS accuracy, sum(base) / (3 * count(*)) AS baseline, avg(hits / np) AS precision, avg(hits / na) AS recall,
avg(CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits / np) * (hits / na) / (hits / np + hits / na) END) AS f1, avg(ap / na) AS map_score, avg(ndcg) AS ndcg FROM e)
SELECT train_rows, holdout_rows, sectors, round(accuracy, 6) AS accuracy, round(baseline, 6) AS baseline, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(map_score, 6) AS map_score, round(ndcg, 6) AS ndcg, accuracy > baseline AS passes_gate FROM m"""


_ROUNDED = ("accuracy", "baseline", "precision", "recall", "f1", "map_score", "ndcg")
TIMED = f"SELECT 'ok' AS status, 'time' AS split, (SELECT max(ts)::DATE - 7 FROM events)::VARCHAR AS holdout_start, * FROM ({_metrics('day < start', 'day >= start')})"


@query(TIMED)
def sector_report(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of the sectors' three most frequent tools, with the last week held out, and the gate."""
    out = T.sector_report(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", "event_type", F.to_date("ts"), ["event_id"])
    return out.withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query(f"SELECT 'ok' AS status, 'fraction' AS split, NULL::VARCHAR AS holdout_start, * FROM ({_metrics('rn <= floor(c * 0.75)', 'rn > floor(c * 0.75)')})")
def sector_report_undated(spark: SparkSession, d: str) -> DataFrame:
    """The same without dates: the last quarter in order of id is held out."""
    out = T.sector_report(table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_type", F.lit(None).cast("date"), ["event_id"])
    return out.withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query(f"""WITH r AS ({TIMED}), tf AS (SELECT user_id, event_type, count(*) AS tf FROM events GROUP BY ALL), n AS (SELECT count(DISTINCT user_id) AS n FROM tf), w AS (SELECT user_id, event_type, tf, round(tf * ln(n / count(*) OVER (PARTITION BY event_type)), 4) AS each FROM tf, n),
s AS (SELECT user_id, event_type, CASE WHEN (SELECT max(each) FROM w) > 0 THEN tf * each ELSE tf END AS score FROM w), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS rank FROM s QUALIFY rank <= 3)
SELECT user_id, 'ok' AS status, string_agg(event_type, ',' ORDER BY rank) AS prediction, any_value(accuracy) AS confidence, bool_or(passes_gate) AS passes_gate, any_value(holdout_start) AS holdout_start FROM t, r GROUP BY 1""")
def sector_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The forecast of every sector with what the report says of it; the day of the split is read from its note."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    report = T.sector_report(rows, "user_id", "event_type", F.to_date("ts"), ["event_id"]).withColumn("accuracy", F.round("accuracy", 6))
    note = F.concat(F.lit("time-split: holdout_start="), "holdout_start", F.lit(", sectors"))
    out = T.forecast(T.summed_scores(rows, "user_id", "event_type"), report.withColumn("holdout_start", T.note_start(note)), "user_id", "event_type")
    return out.withColumn("prediction", F.array_join(F.transform("prediction", lambda p: p["event_type"]), ","))


@query(f"""WITH r AS ({TIMED}), tf AS (SELECT user_id, event_type, count(*) AS tf FROM events WHERE event_type <> '' AND user_id IS NOT NULL GROUP BY ALL), n AS (SELECT count(DISTINCT user_id) AS n FROM tf), w AS (SELECT user_id, event_type, tf, round(tf * ln(n / count(*) OVER (PARTITION BY event_type)), 4) AS each FROM tf, n),
s AS (SELECT user_id, event_type, tf, CASE WHEN (SELECT max(each) FROM w) > 0 THEN tf * each ELSE tf END AS score FROM w),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS rank, sum(score) OVER (PARTITION BY user_id) AS whole, sum(tf) OVER (PARTITION BY user_id) AS evidence, sum(tf) OVER () AS all_rows FROM s)
SELECT user_id, CASE WHEN any_value(evidence) < 5 THEN 'sparse' ELSE 'ok' END AS status, any_value(evidence)::BIGINT AS evidence, round(any_value(evidence) / any_value(all_rows), 6) AS coverage, string_agg(event_type, ',' ORDER BY rank) FILTER (rank <= 3) AS prediction,
string_agg(event_type || ':' || printf('%.4f', round(score / CASE WHEN whole = 0 THEN 1 ELSE whole END, 4)), ',' ORDER BY rank) FILTER (rank <= 5) AS contributions, any_value(accuracy) AS confidence, any_value(baseline) AS baseline, round(any_value(accuracy) - any_value(baseline), 6) AS lift, bool_or(passes_gate) AS passes_gate FROM t, r GROUP BY 1""")
def whole_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Every sector's forecast with contributions, coverage, baseline and lift, and the state that it is in."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    report = T.sector_report(rows, "user_id", "event_type", F.to_date("ts"), ["event_id"]).withColumns({c: F.round(c, 6) for c in ("accuracy", "baseline")})
    out = T.whole_forecast(rows, report, "user_id", "event_type").withColumns({"coverage": F.round("coverage", 6), "lift": F.round("lift", 6)})
    return out.withColumns({
        "prediction": F.array_join(F.transform("prediction", lambda p: p["event_type"]), ","), "contributions": F.array_join(F.transform("contributions", lambda p: F.concat(p["event_type"], F.lit(":"), F.format_string("%.4f", F.round(p["normalised"], 4)))), ","),
    })


@query("SELECT CASE WHEN row_number() OVER (ORDER BY source, doc_id) <= floor(count(*) OVER () * 0.75) THEN 'train' ELSE 'test' END AS split, doc_id FROM documents")
def fraction_split_global(spark: SparkSession, d: str) -> DataFrame:
    """The first three quarters of all documents in order of source and id."""
    return S.fraction_split(table(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"]).select("split", "doc_id")


@query(f"""WITH n AS (SELECT CASE WHEN page_id % 4 = 0 THEN 'actor' WHEN page_id % 4 = 1 THEN 'tool' WHEN page_id % 4 = 2 THEN 'malware' ELSE 'campaign' END AS t, ['Cozy Bear ', 'apt29', 'Beacon', 'Lazarus', 'Other'][page_id % 5 + 1] AS name, page_id FROM pages),
k AS (SELECT CASE WHEN t = 'actor' THEN coalesce(({{{', '.join(f"'{a}': '{b}'" for a, b in fixed.ACTOR_ALIASES.items())}}}::MAP(VARCHAR, VARCHAR))[lower(trim(name))], name) WHEN t IN ('tool', 'malware') THEN coalesce(({{{', '.join(f"'{a}': '{b}'" for a, b in fixed.MALWARE_ALIASES.items())}}}::MAP(VARCHAR, VARCHAR))[lower(trim(name))], name) ELSE name END AS bucket, page_id FROM n)
SELECT bucket, min(page_id) AS first_id, count(*) AS n FROM k GROUP BY 1""".replace("({'", "(MAP {'").replace("::MAP(VARCHAR, VARCHAR)", ""))
def entity_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Entities of one name after aliases of their type; types of one name share a bucket."""
    k = F.col("page_id")
    kind = F.when(k % 4 == 0, "actor").when(k % 4 == 1, "tool").when(k % 4 == 2, "malware").otherwise("campaign")
    names = F.array(*(F.lit(x) for x in ("Cozy Bear ", "apt29", "Beacon", "Lazarus", "Other")))[(k % 5).cast("int")]
    rows = table(spark, d, "pages").select("page_id", D.entity_bucket(names, kind).alias("bucket"))
    return rows.groupBy("bucket").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
