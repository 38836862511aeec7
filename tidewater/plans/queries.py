"""Registered queries over the supplied tables, each beside the SQL that must give the same rows.

The operators are those of an intelligence pipeline; the tables stand in for its records: nations are sectors, parts
are tools, documents are observables and stories, events are dated sightings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import metrics as M
from ..functions import text as X
from ..operators import dedup as D
from ..operators import features as A
from ..operators import splits as S
from ..operators.ranges import numbered
from ..sources.tables import by_name, table
from ..streaming import jobs
from .registry import STAR, query, star

TFIDF = f"""star AS ({STAR}), tf AS (SELECT n_name, p_partkey, count(*) AS tf FROM star GROUP BY ALL), n AS (SELECT count(DISTINCT n_name) AS n FROM tf),
w AS (SELECT n_name, p_partkey, tf, count(*) OVER (PARTITION BY p_partkey) AS df, tf * ln(n / count(*) OVER (PARTITION BY p_partkey)) AS tfidf FROM tf, n)"""


@query(f"WITH {TFIDF} SELECT n_name, p_partkey, rank, round(tfidf, 6) AS tfidf FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY round(tfidf, 6) DESC, p_partkey) AS rank FROM w) WHERE rank <= 3")
def tfidf_sector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three most telling tools of each sector."""
    scores = A.tfidf(star(spark, d), "n_name", "p_partkey").withColumn("tfidf", F.round("tfidf", 6))
    return A.top_k(scores, ["n_name"], [F.col("tfidf").desc(), F.col("p_partkey")], 3).select("n_name", "p_partkey", "rank", "tfidf")


@query(f"SELECT n_name, p_partkey, count(*) AS tf FROM ({STAR}) GROUP BY ALL")
def cooccurrence_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.cooccurrence(star(spark, d), "n_name", "p_partkey")


@query(f"WITH {TFIDF} SELECT n_name, p_partkey, tf, df, round(tfidf, 6) AS tfidf FROM w")
def tfidf_scores(spark: SparkSession, d: str) -> DataFrame:
    return A.tfidf(star(spark, d), "n_name", "p_partkey").withColumn("tfidf", F.round("tfidf", 6))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


DEDUP_KEY = "md5(coalesce(text, '')) || '::' || coalesce(lang, '')"


def _dedup_key() -> F.Column:
    return F.concat(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.lit("::"), F.coalesce("lang", F.lit("")))


@query(f"""WITH g AS (SELECT {DEDUP_KEY} AS dedup_key, count(*) AS n, count(DISTINCT coalesce(source, '')) AS feeds,
min(n_chars) AS lo, max(n_chars) AS hi, arg_max(doc_id, {{'c': coalesce(n_chars, 0), 'o': -doc_id}}) AS doc_id, arg_max(source, {{'c': coalesce(n_chars, 0), 'o': -doc_id}}) AS source FROM documents GROUP BY 1)
SELECT dedup_key, CASE WHEN n > 1 THEN 'canonical-' || doc_id END AS canonical_id, doc_id, source, CASE WHEN n > 1 THEN feeds ELSE 1 END AS source_feed_count, n AS distinct_event_count,
round(CASE WHEN n > 1 THEN least(1.0, ln(feeds + 1) / ln(10)) ELSE 0 END, 6) AS corroboration_score, CASE WHEN n > 1 THEN 'merged' ELSE 'singleton' END AS dedup_status, lo AS source_confidence_min, hi AS source_confidence_max FROM g""")
def l1_dedup_canonical(spark: SparkSession, d: str) -> DataFrame:
    """One record for each text; what it was merged from is in l1_dedup_members."""
    out = D.canonical(_documents(spark, d).select("doc_id", "source", "n_chars", "lang", "text"), _dedup_key(), "doc_id", "source", F.col("n_chars"), "doc_id", ["doc_id", "source"])
    return out.withColumn("corroboration_score", F.round("corroboration_score", 6))


@query(f"SELECT {DEDUP_KEY} AS dedup_key, doc_id::VARCHAR AS id FROM documents")
def l1_dedup_members(spark: SparkSession, d: str) -> DataFrame:
    """What each record was merged from, a row for each."""
    return D.members(_documents(spark, d).select("doc_id", "lang", "text"), _dedup_key(), "doc_id")


@query("SELECT doc_id, source, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS rn FROM documents WHERE source <> '' AND lang <> '') WHERE rn = 1")
def best_per_key_rownum(spark: SparkSession, d: str) -> DataFrame:
    return D.best_per_key(_documents(spark, d).select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], F.col("n_chars"), F.col("doc_id"))


ALIASES = {"click": "engage", "view": "engage", "purchase": "buy"}


@query("""SELECT CASE lower(event_type) WHEN 'click' THEN 'engage' WHEN 'view' THEN 'engage' WHEN 'purchase' THEN 'buy' ELSE event_type END AS name,
count(*) AS distinct_event_count, count(DISTINCT user_id) AS source_feed_count, round(least(1.0, ln(count(DISTINCT user_id) + 1) / ln(10)), 6) AS corroboration_score, min(event_id) AS first_id FROM events GROUP BY 1""")
def l2_alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "events").groupBy(X.alias(F.col("event_type"), ALIASES).alias("name"))
    return named.agg(F.count("*").alias("distinct_event_count"), F.count_distinct("user_id").alias("source_feed_count"), F.round(D.corroboration(F.count_distinct("user_id")), 6).alias("corroboration_score"), F.min("event_id").alias("first_id"))


@query("SELECT sum(n)::BIGINT AS n_raw, count(*) AS n_unique, (sum(n) - count(*))::BIGINT AS n_duplicates, round(sum(n) / count(*), 6) AS ratio FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    return D.report(_documents(spark, d), F.xxhash64("text")).withColumn("ratio", F.round("ratio", 6))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 THEN 'OBSERVED' ELSE 'UNVALIDATED' END AS tier FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR quality = 1")
def tier_filter_read(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("quality") == 1, "OBSERVED").when(F.col("quality").isNotNull(), "UNVALIDATED")
    rows = _documents(spark, d).select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", tier.alias("tier"))
    return A.tier_filter(rows, ["OBSERVED"])


@query("SELECT s_suppkey AS party, s_name, s_acctbal AS balance, NULL::VARCHAR AS c_mktsegment FROM supplier UNION ALL BY NAME SELECT c_custkey AS party, c_acctbal AS balance, c_mktsegment FROM customer")
def union_by_name_scan(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("party"), "s_name", F.col("s_acctbal").alias("balance"))
    return by_name([s, table(spark, d, "customer").select(F.col("c_custkey").alias("party"), F.col("c_acctbal").alias("balance"), "c_mktsegment")])


def _event_weeks(spark: SparkSession, d: str) -> DataFrame:
    return A.weekly_counts(table(spark, d, "events"), "event_type", F.to_date("ts"))


@query("SELECT event_type, date_trunc('week', ts)::DATE AS week_start, count(*) AS n FROM events GROUP BY ALL", days=('week_start',))
def weekly_counts(spark: SparkSession, d: str) -> DataFrame:
    return _event_weeks(spark, d)


@query("""WITH w AS (SELECT event_type, date_trunc('week', ts)::DATE AS week_start, count(*) AS n FROM events GROUP BY ALL),
top AS (SELECT event_type FROM w GROUP BY 1 ORDER BY sum(n) DESC, event_type LIMIT 3)
SELECT t.event_type, k.week_start, coalesce(w.n, 0) AS n FROM top t CROSS JOIN (SELECT DISTINCT week_start FROM w) k LEFT JOIN w ON w.event_type = t.event_type AND w.week_start = k.week_start""", days=('week_start',))
def weekly_trend_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Zero-filled weekly series of the three largest tools of all events."""
    return A.densified(_event_weeks(spark, d), "event_type", 3).select("event_type", "week_start", "n")


@query("""WITH w AS (SELECT user_id, event_type, date_trunc('week', ts)::DATE AS week_start, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type <> '' AND ts IS NOT NULL GROUP BY ALL),
top AS (SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY sum(n) DESC, event_type) AS r FROM w GROUP BY 1, 2) WHERE r <= 3)
SELECT t.user_id, t.event_type, k.week_start, coalesce(w.n, 0) AS n FROM top t JOIN (SELECT DISTINCT user_id, week_start FROM w) k USING (user_id) LEFT JOIN w ON w.user_id = t.user_id AND w.event_type = t.event_type AND w.week_start = k.week_start""", days=('week_start',))
def weekly_trend_by_sector(spark: SparkSession, d: str) -> DataFrame:
    """Zero-filled weekly series of the three largest tools of every sector (user), over all events."""
    return A.sector_trends(table(spark, d, "events"), "user_id", "event_type", F.to_date("ts"), 3)


BRAND_WEEKS = "SELECT p_brand, date_trunc('week', o_orderdate)::DATE AS week_start, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def _brand_weeks(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    rows = lines.join(table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "o_orderkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    return A.weekly_counts(rows, "p_brand", F.col("day"))


@query(f"""SELECT p_brand, n_points, total::BIGINT AS total, first_n, last_n, round((last_n - first_n) / greatest(n_points - 1, 1), 6) AS slope, last_n > first_n AS trending_up, row_number() OVER (ORDER BY last_n > first_n DESC, (last_n - first_n) / greatest(n_points - 1, 1) DESC, total DESC, p_brand) AS rank
FROM (SELECT p_brand, count(*) AS n_points, sum(n) AS total, arg_min(n, week_start) AS first_n, arg_max(n, week_start) AS last_n FROM ({BRAND_WEEKS}) GROUP BY 1) WHERE n_points >= 2""")
def trend_slope_rank(spark: SparkSession, d: str) -> DataFrame:
    """Series in order of trend, slope and total, numbered by ranges of that order."""
    order = [F.col("trending_up").desc(), F.col("slope").desc(), F.col("total").desc(), F.col("p_brand")]
    return numbered(A.slopes(_brand_weeks(spark, d), "p_brand"), order, "rank").withColumn("slope", F.round("slope", 6))


@query(f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY week_start) AS rn, count(*) OVER (PARTITION BY p_brand) AS c FROM ({BRAND_WEEKS}))
SELECT a.p_brand, round(avg(abs(a.n - b.n)), 6) AS mae FROM w a JOIN w b ON a.p_brand = b.p_brand AND b.rn = b.c - 4 WHERE a.c >= 8 AND a.rn > a.c - 4 GROUP BY 1""")
def persistence_mae(spark: SparkSession, d: str) -> DataFrame:
    return A.persistence(_brand_weeks(spark, d), "p_brand").withColumn("mae", F.round("mae", 6))


@query("SELECT CASE WHEN o_orderdate::DATE <= (SELECT max(o_orderdate)::DATE - 30 FROM orders) THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1", days=('first_day', 'last_day'))
def time_split_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = S.time_split(table(spark, d, "orders").select("o_orderdate"), F.to_date("o_orderdate"), 30)
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day"))


@query("""WITH e AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders), c AS (SELECT unnest(generate_series(a + 90, b, INTERVAL 30 DAY))::DATE AS cutoff FROM e)
SELECT cutoff, count(*) FILTER (o_orderdate::DATE < cutoff - 30) AS n_train, count(*) FILTER (o_orderdate::DATE >= cutoff - 30) AS n_test FROM c JOIN orders ON o_orderdate::DATE >= cutoff - 90 AND o_orderdate::DATE < cutoff GROUP BY 1 HAVING n_train > 0 AND n_test > 0""", days=('cutoff',))
def rolling_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.rolling_windows(table(spark, d, "orders"), F.to_date("o_orderdate"))


@query("SELECT source, sum((rn <= floor(n * 0.75))::INT)::BIGINT AS n_train, sum((rn > floor(n * 0.75))::INT)::BIGINT AS n_test FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY 1")
def fraction_split(spark: SparkSession, d: str) -> DataFrame:
    """Each source's first three quarters in order of id."""
    rows = S.fraction_split(_documents(spark, d).select("doc_id", "source"), ["doc_id"], F.col("source"))
    return rows.groupBy("source").agg(F.sum((F.col("split") == "train").cast("int")).alias("n_train"), F.sum((F.col("split") == "test").cast("int")).alias("n_test"))


EVAL = """e AS (SELECT user_id, event_type, ts::DATE AS day, (SELECT max(ts)::DATE - 7 FROM events) AS cut FROM events),
tr AS (SELECT user_id, event_type, count(*) AS n FROM e WHERE day < cut GROUP BY ALL), ho AS (SELECT user_id, event_type, count(*) AS gain FROM e WHERE day >= cut GROUP BY ALL),
pr AS (SELECT * FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM tr WHERE user_id IN (SELECT user_id FROM ho)) WHERE rank <= 3),
gl AS (SELECT event_type FROM tr GROUP BY 1 ORDER BY sum(n) DESC, event_type LIMIT 3)"""


def _evaluation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training counts, holdout counts (as gain) and the three predicted tools of sectors that are in both."""
    rows = S.time_split(table(spark, d, "events").select("user_id", "event_type", "ts"), F.to_date("ts"), 8)  # the boundary day is tested
    counts = rows.groupBy("part", "user_id", "event_type").agg(F.count("*").alias("n"))
    train, held = counts.where("part = 'train'").drop("part"), counts.where("part = 'test'").select("user_id", "event_type", F.col("n").alias("gain"))
    known = train.join(held.select("user_id").distinct(), "user_id", "left_semi")
    return train, held, A.top_k(known, ["user_id"], [F.col("n").desc(), F.col("event_type")], 3)


@query(f"""WITH {EVAL}, h AS (SELECT count(*) AS hits FROM pr JOIN ho USING (user_id, event_type)), u AS (SELECT count(DISTINCT user_id) AS n FROM pr), b AS (SELECT count(*) AS hits FROM ho JOIN gl USING (event_type) WHERE user_id IN (SELECT user_id FROM pr))
SELECT u.n AS n_sectors, (SELECT count(*) FROM pr) AS n_predicted, h.hits AS n_hits, round(h.hits / (SELECT count(*) FROM pr), 6) AS accuracy, round(b.hits / (3 * u.n), 6) AS baseline, h.hits / (SELECT count(*) FROM pr) > b.hits / (3 * u.n) AS passes_gate FROM h, u, b""")
def sector_eval_topk(spark: SparkSession, d: str) -> DataFrame:
    """Micro accuracy of each sector's top three against the global top three."""
    train, held, predicted = _evaluation(spark, d)
    best = train.groupBy("event_type").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "event_type").limit(3).select("event_type", F.lit(1).alias("is_top"))
    by_sector = predicted.join(held, ["user_id", "event_type"], "left").groupBy("user_id").agg(F.count("*").alias("p"), F.count("gain").alias("h"))
    base = held.join(F.broadcast(best), "event_type").groupBy("user_id").agg(F.count("*").alias("b"))
    sums = by_sector.join(base, "user_id", "left").agg(F.count("*").alias("n_sectors"), F.sum("p").alias("n_predicted"), F.sum("h").alias("n_hits"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    accuracy, baseline = F.col("n_hits") / F.col("n_predicted"), F.col("b") / (3 * F.col("n_sectors"))
    return sums.select("n_sectors", "n_predicted", "n_hits", F.round(accuracy, 6).alias("accuracy"), F.round(baseline, 6).alias("baseline"), (accuracy > baseline).alias("passes_gate"))


@query(f"""WITH {EVAL}, hit AS (SELECT p.user_id, p.rank, h.gain, count(h.gain) OVER (PARTITION BY p.user_id ORDER BY p.rank) AS run FROM pr p LEFT JOIN ho h USING (user_id, event_type)),
s AS (SELECT user_id, count(gain) AS hits, count(*) AS n_predicted, coalesce(sum(run / rank) FILTER (gain IS NOT NULL), 0) AS ap, sum(coalesce(gain, 0) / log2(rank + 1)) AS dcg FROM hit GROUP BY 1),
i AS (SELECT user_id, gain, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, event_type) AS r FROM ho), a AS (SELECT user_id, count(*) AS n_actual FROM ho GROUP BY 1)
SELECT s.user_id, hits, n_predicted, n_actual, round(hits / n_predicted, 6) AS precision, round(hits / n_actual, 6) AS recall, round(CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits / n_predicted) * (hits / n_actual) / (hits / n_predicted + hits / n_actual) END, 6) AS f1,
round(ap / n_actual, 6) AS average_precision, round(dcg / (SELECT sum(gain / log2(r + 1)) FROM i WHERE i.user_id = s.user_id AND r <= n_predicted), 6) AS ndcg FROM s JOIN a USING (user_id)""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    _, held, predicted = _evaluation(spark, d)
    out = M.ranking(predicted, held, "user_id", "event_type", "gain", 3)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "average_precision", "ndcg")})


SCORED = "SELECT doc_id, quality, toxic, n_chars / (SELECT max(n_chars) FROM documents) AS score FROM documents JOIN labels USING (doc_id)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select("doc_id", "n_chars")
    top = docs.agg(F.max("n_chars").alias("top"))
    return docs.join(table(spark, d, "labels"), "doc_id").crossJoin(F.broadcast(top)).select("doc_id", "quality", "toxic", (F.col("n_chars") / F.col("top")).alias("score"))


@query(f"""WITH s AS (SELECT score, sum(quality) AS hits, count(*) AS n FROM ({SCORED}) GROUP BY 1), r AS (SELECT hits, sum(hits) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM s)
SELECT round(sum(hits * tp / seen) / sum(hits), 6) AS average_precision FROM r""")
def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return M.average_precision(_scored(spark, d), "quality", "score").select(F.round("average_precision", 6).alias("average_precision"))


_BIN = " ".join(f"WHEN score >= {lo!r}::DOUBLE AND score < {hi!r}::DOUBLE THEN {i}" for i, (lo, hi) in enumerate(zip(fixed.BIN_EDGES, fixed.BIN_EDGES[1:], strict=False)))


@query(f"""WITH b AS (SELECT CASE {_BIN} END AS bin, count(*) AS n, avg(score) AS c, avg(quality) AS a, sum(count(*)) OVER () AS t FROM ({SCORED}) GROUP BY 1)
SELECT bin, n, round(c, 6) AS confidence, round(a, 6) AS accuracy, round(abs(a - c) * n / t, 6) AS gap FROM b WHERE bin IS NOT NULL""")
def ece_bins(spark: SparkSession, d: str) -> DataFrame:
    out = M.calibration_bins(_scored(spark, d), "quality", "score")
    return out.withColumns({c: F.round(c, 6) for c in ("confidence", "accuracy", "gap")})


@query(f"SELECT round((SELECT sum(quality) FROM (SELECT quality FROM ({SCORED}) ORDER BY score DESC, quality DESC LIMIT 50)) / greatest(1, least(50, (SELECT sum(quality) FROM labels))), 6) AS top_k_accuracy")
def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return M.top_k_accuracy(_scored(spark, d), "quality", "score", 50).select(F.round("top_k_accuracy", 6).alias("top_k_accuracy"))


@query("""SELECT doc_id, CASE WHEN contains(lower(coalesce(source, '') || ' ' || tag), 'observed-in-the-wild:yes') OR contains(lower(tag), 'was-zero-day:yes') OR contains(lower(tag), 'exploitation-state:weaponized') OR contains(lower(tag), 'exploitation-state:exploited') THEN 1 WHEN toxic * 0.5 > 0.1 THEN 1 ELSE 0 END AS exploited,
coalesce(nullif(toxic, 0)::DOUBLE, nullif(quality, 0)::DOUBLE, 0.0) AS first_score FROM (SELECT *, ['Observed-In-The-Wild:Yes', 'observed-in-the-wild:no', 'was-zero-day:Yes', 'exploitation-state:anticipated', 'exploitation-state:Weaponized'][doc_id % 5 + 1] AS tag FROM documents) JOIN labels USING (doc_id)""")
def label_derivation(spark: SparkSession, d: str) -> DataFrame:
    """Labels from tags and a score; the tags of a document are its source and one made up from its id."""
    rows = _documents(spark, d).select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    made = F.array(*(F.lit(t) for t in ("Observed-In-The-Wild:Yes", "observed-in-the-wild:no", "was-zero-day:Yes", "exploitation-state:anticipated", "exploitation-state:Weaponized")))
    tags = F.array(F.coalesce("source", F.lit("")), made[(F.col("doc_id") % 5).cast("int")])
    return rows.select("doc_id", A.label(tags, F.col("toxic") * 0.5).alias("exploited"), A.first_nonzero(F.col("toxic"), F.col("quality")).alias("first_score"))


@query("SELECT p_partkey, p_retailprice AS score, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 20")
def score_baseline_rank(spark: SparkSession, d: str) -> DataFrame:
    """The best twenty by a given score; the limit comes before the rank, so that no task sorts all rows."""
    top = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("score")).orderBy(F.col("score").desc(), "p_partkey").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "p_partkey")))


@query("SELECT l_partkey AS tool, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, tool LIMIT 10")
def frequency_baseline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("tool")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tool").limit(10)


@query("SELECT event_type, round(total, 4) AS total, round(total / sum(total) OVER (), 6) AS share FROM (SELECT event_type, sum(value) AS total FROM events GROUP BY 1) ORDER BY total DESC LIMIT 3")
def feature_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Shares of all contributions, the three largest shown."""
    sums = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("total"))
    shares = sums.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 6))
    return shares.orderBy(F.col("total").desc()).limit(3).withColumn("total", F.round("total", 4))


@query(f"SELECT n_name, count(*) AS n FROM ({STAR}) GROUP BY 1 HAVING n >= 5")
def coverage_by_sector(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d).groupBy("n_name").agg(F.count("*").alias("n")).where("n >= 5").orderBy(F.col("n").desc(), "n_name")


@query("""SELECT page_id, defanged, regexp_replace(regexp_replace(replace(defanged, '[.]', '.'), '\\[dot\\]', '.', 'gi'), '^hxxp', 'http', 'i') AS refanged
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(replace(url, '.', '[.]'), 'http', 'hxxp') WHEN 1 THEN replace(replace(url, '.', '[dot]'), 'http', 'HXXP') ELSE replace(replace(url, '.', '[DOT]'), 'http', 'hXXp') END AS defanged FROM pages)""")
def refang_urls(spark: SparkSession, d: str) -> DataFrame:
    """Urls that were made harmless in three ways, made whole again."""
    ways = [("[.]", "hxxp"), ("[dot]", "HXXP"), ("[DOT]", "hXXp")]
    made = [F.replace(F.replace("url", F.lit("."), F.lit(dot)), F.lit("http"), F.lit(scheme)) for dot, scheme in ways]
    pages = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, made[0]).when(F.col("page_id") % 3 == 1, made[1]).otherwise(made[2]).alias("defanged"))
    return pages.withColumn("refanged", X.refang(F.col("defanged")))


@query("""SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda t: NOT (starts_with(t, 'Ilamona_') OR starts_with(t, 'PIR') OR starts_with(t, 'ilamona_') OR starts_with(t, 'pir'))),
lambda t: CASE WHEN lower(t) = 'part' THEN 'component' ELSE t END), ' ') AS tags FROM part""")
def tag_normalise(spark: SparkSession, d: str) -> DataFrame:
    tags = X.normalise_tags(F.split("p_name", " "), {"part": "component"})
    return table(spark, d, "part").select("p_partkey", F.array_join(tags, " ").alias("tags"))


TAXONOMY = [("building", "Construction"), ("machinery", "Manufacturing"), ("household", "Consumer"), ("automobile", "Transport"), ("furniture & fittings", "Consumer"), ("automobile", "Mobility")]


@query("""SELECT c_mktsegment AS raw, CASE lower(trim(c_mktsegment)) WHEN 'building' THEN 'Construction' WHEN 'machinery' THEN 'Manufacturing' WHEN 'household' THEN 'Consumer' WHEN 'automobile' THEN 'Mobility'
ELSE CASE WHEN contains(lower(c_mktsegment), 'machinery') THEN 'Manufacturing' WHEN contains(lower(c_mktsegment), 'household') THEN 'Consumer' WHEN contains(lower(c_mktsegment), 'automobile') THEN 'Mobility' ELSE trim(c_mktsegment) END END AS sector, count(*) AS n FROM customer GROUP BY ALL""")
def taxonomy_map(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labels are mapped, not rows."""
    raw = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("raw")).agg(F.count("*").alias("n"))
    return raw.withColumn("sector", X.taxonomy(F.col("raw"), TAXONOMY))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\b(?:\d{1,3}[\.\[\]]{1,3}){3}\d{1,3}\b'), ' ') AS ips FROM documents WHERE regexp_matches(text, '\b(?:\d{1,3}[\.\[\]]{1,3}){3}\d{1,3}\b')")
def regex_extract_ips(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.array_join(X.extract_all(F.col("text"), fixed.IP_PATTERN), " ").alias("ips")).where("ips <> ''")


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, len(string_split(regexp_extract(url, '://([^/?#]+)', 1), '.')) AS n_labels FROM pages")
def regex_extract_url_parts(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), host.alias("host"), F.size(F.split(host, r"\.")).cast("long").alias("n_labels"))


@query()
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Event blocks of pages whose div classes are read as events."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("html", r"(?i)<div([^>]*)class=([\"'])", "<div$1class=$2event ").alias("html"))
    return X.parse(pages, "timeline").drop("html").withColumn("techniques", F.array_join("techniques", " "))


WORDS = r"""w AS (SELECT doc_id, coalesce(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''))), []) AS s FROM documents)"""


def _stories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return D.story_classes(_documents(spark, d).select("doc_id", "text"), "doc_id", X.shingles(F.col("text")))


@query(f"WITH {WORDS} SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM w")
def story_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of each story: stories of the same words, by whole texts."""
    return _stories(spark, d)[0].withColumnRenamed("id", "doc_id")


LINKS = f"""{WORDS}, c AS (SELECT min(doc_id) AS id, s FROM w WHERE len(s) > 0 GROUP BY s), k AS (SELECT id, len(s) AS n, unnest(s) AS token FROM c),
p AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS n_shared, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS score FROM k a JOIN k b ON a.token = b.token AND a.id < b.id GROUP BY 1, 2 HAVING score >= 0.82)"""


@query(f"WITH {LINKS} SELECT left_id, right_id, n_shared FROM p")
def story_candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of story classes that are more than distinct, with the number of words that they share; no word is left out."""
    return D.story_links(_stories(spark, d)[1]).select("left_id", "right_id", "n_shared")


@query(f"WITH {LINKS} SELECT left_id, right_id, round(score, 6) AS score, CASE WHEN score >= 0.95 THEN 'merged' ELSE 'possible_duplicate' END AS band FROM p")
def story_bands(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the pairs of story classes, by the Jaccard similarity of all their words."""
    links = D.story_links(_stories(spark, d)[1])
    return links.select("left_id", "right_id", F.round("score", 6).alias("score"), D.story_band(F.col("score")).alias("band"))


@query(f"WITH {LINKS} SELECT left_id, right_id, n_shared, round(score, 6) AS score, CASE WHEN score >= 0.95 THEN 'merged' ELSE 'possible_duplicate' END AS band FROM p")
def story_links(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of classes that are merged or possible duplicates, by all words of whole texts; all others are distinct."""
    links = D.story_links(_stories(spark, d)[1])
    return links.withColumn("band", D.story_band(F.col("score"))).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {LINKS}, m AS (SELECT left_id AS a, right_id AS b FROM p WHERE score >= 0.95 UNION SELECT right_id, left_id FROM p WHERE score >= 0.95),
r AS (SELECT DISTINCT a AS id, a AS seen FROM m UNION SELECT r.id, m.b FROM r JOIN m ON r.seen = m.a),
g AS (SELECT id, min(seen) AS group_id FROM r GROUP BY 1), possible AS (SELECT DISTINCT unnest([left_id, right_id]) AS id FROM p WHERE score < 0.95),
x AS (SELECT w.doc_id, CASE WHEN len(w.s) = 0 THEN w.doc_id ELSE min(w.doc_id) OVER (PARTITION BY w.s) END AS class_id FROM w),
y AS (SELECT d.doc_id, d.source, d.n_chars, coalesce(g.group_id, x.class_id) AS story_id, q.id IS NOT NULL AS possible FROM documents d JOIN x USING (doc_id) LEFT JOIN g ON g.id = x.class_id LEFT JOIN possible q ON q.id = x.class_id)
SELECT story_id, arg_max(doc_id, {{'c': coalesce(n_chars, 0), 'o': -doc_id}}) AS doc_id, count(*) AS distinct_event_count, CASE WHEN count(*) > 1 THEN count(DISTINCT coalesce(source, '')) ELSE 1 END AS source_feed_count,
round(CASE WHEN count(*) > 1 THEN least(1.0, ln(count(DISTINCT coalesce(source, '')) + 1) / ln(10)) ELSE 0 END, 6) AS corroboration_score, CASE WHEN count(*) > 1 THEN 'merged' WHEN bool_or(possible) THEN 'possible_duplicate' ELSE 'singleton' END AS dedup_status FROM y GROUP BY 1""")
def story_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each story: equal and merged classes are one, by components; a possible duplicate stays, marked as such."""
    docs = _documents(spark, d).select("doc_id", "source", "n_chars", "text")
    members, sets = D.story_classes(docs, "doc_id", X.shingles(F.col("text")))
    links = D.written(D.story_links(sets), "story-links")
    groups = D.story_groups(links.where(F.col("score") >= fixed.MERGE_AT))
    unsure = links.where(F.col("score") < fixed.MERGE_AT).select(F.explode(F.array("left_id", "right_id")).alias("class_id")).distinct().withColumn("possible", F.lit(True))
    story = members.join(groups, "class_id", "left").join(unsure, "class_id", "left").select(F.col("id").alias("doc_id"), F.coalesce("group_id", "class_id").alias("story_id"), F.coalesce("possible", F.lit(False)).alias("possible"))
    rows = D.written(docs.drop("text").join(story, "doc_id"), "stories")
    out = D.canonical(rows, F.col("story_id"), "doc_id", "source", F.col("n_chars"), "doc_id", ["doc_id"])
    marked = rows.groupBy("story_id").agg(F.max("possible").alias("possible")).withColumnRenamed("story_id", "dedup_key")
    status = F.when((F.col("dedup_status") == "singleton") & F.col("possible"), "possible_duplicate").otherwise(F.col("dedup_status"))
    return out.join(marked, "dedup_key").select(F.col("dedup_key").alias("story_id"), "doc_id", "distinct_event_count", "source_feed_count", F.round("corroboration_score", 6).alias("corroboration_score"), status.alias("dedup_status"))


@query("SELECT o_orderkey FROM orders ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """What is still to do: ids without a result; orders of which a line came back are done."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT c_mktsegment, count(*) AS n FROM customer SEMI JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def overlap_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT quarter, o_orderkey FROM (SELECT date_trunc('quarter', o_orderdate)::DATE AS quarter, o_orderkey, row_number() OVER (PARTITION BY date_trunc('quarter', o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 40 + 10 * (extract(year FROM quarter) - 1995)", days=('quarter',))
def stratified_quota(spark: SparkSession, d: str) -> DataFrame:
    """The newest orders of each quarter up to its quota, which rises by year."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    quarter = F.date_trunc("quarter", "o_orderdate").cast("date")
    quota = orders.select(quarter.alias("stratum")).distinct().withColumn("quota", 40 + 10 * (F.year("stratum") - 1995))
    return S.stratified(orders, quarter, quota, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select(F.col("stratum").alias("quarter"), "o_orderkey")


@query("SELECT event_id::VARCHAR AS record_id, 'k too small' AS reason FROM events WHERE coalesce((props::JSON->>'k')::INT, 0) < 10")
def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return A.quarantine(table(spark, d, "events").select("event_id", "props"), k >= 10, F.lit("k too small"), "event_id")[1]


@query("SELECT count(*) FILTER (coalesce((props::JSON->>'k')::INT, 0) < 10) AS n_quarantined, count(*) AS n, round(count(*) FILTER (coalesce((props::JSON->>'k')::INT, 0) < 10) / count(*), 6) AS rate FROM events")
def quarantine_rate(spark: SparkSession, d: str) -> DataFrame:
    bad = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)) < 10
    return table(spark, d, "events").agg(F.count_if(bad).alias("n_quarantined"), F.count("*").alias("n")).withColumn("rate", F.round(F.coalesce(F.col("n_quarantined") / F.nullif("n", F.lit(0)), F.lit(0.0)), 6))


@query(r"SELECT source, count(*) AS n, round(avg(regexp_matches(text, '\d')::INT), 6) AS has_digit, round(avg(contains(text, '@')::INT), 6) AS has_mail, round(avg((n_chars > 500)::INT), 6) AS is_long FROM documents GROUP BY 1")
def coverage_presence(spark: SparkSession, d: str) -> DataFrame:
    """How often each facet is there, by feed."""
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return _documents(spark, d).groupBy("source").agg(F.count("*").alias("n"), share(F.col("text").rlike(r"\d")).alias("has_digit"), share(F.contains("text", F.lit("@"))).alias("has_mail"), share(F.col("n_chars") > 500).alias("is_long"))


@query("SELECT role, sum(length(text) // 4)::BIGINT AS tokens, round(sum(length(text) // 4) / 1e6 * CASE role WHEN 'assistant' THEN 15.0 ELSE 3.0 END, 4) AS cost FROM conversations GROUP BY 1")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Tokens (a quarter of the characters) and their price by role."""
    tokens = F.sum(F.floor(F.length("text") / 4))
    return table(spark, d, "conversations").groupBy("role").agg(tokens.alias("tokens")).withColumn("cost", F.round(F.col("tokens") / 1e6 * F.when(F.col("role") == "assistant", 15.0).otherwise(3.0), 4))


@query("SELECT doc_id, source, lang, n_chars FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")
def evidence_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The records of a set of ids: of all that are labelled toxic."""
    return _documents(spark, d).select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT year(o_orderdate)::INT AS batch, count(*) AS n, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1", days=('first_day', 'last_day'))
def batch_catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("batch")).agg(F.count("*").alias("n"), F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day")).orderBy(F.col("batch").desc())


@query("SELECT count(*) FILTER (s_name <> '') AS n_companies, CASE WHEN count(*) FILTER (s_name <> '') >= 20 THEN 'sufficient' ELSE 'sparse' END AS coverage FROM supplier")
def company_flag(spark: SparkSession, d: str) -> DataFrame:
    named = F.count_if(X.truthy(F.col("s_name")))
    return table(spark, d, "supplier").agg(named.alias("n_companies"), F.when(named >= 20, "sufficient").otherwise("sparse").alias("coverage"))


@query()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the clusters of the embeddings."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=5, seed=7, maxIter=10).fit(rows).transform(rows).groupBy("prediction").agg(F.count("*").alias("n"))


@query("SELECT event_type, round(regr_slope(n, x), 6) AS slope, round(regr_intercept(n, x), 6) AS intercept FROM (SELECT event_type, ts::DATE - DATE '2024-01-01' AS x, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def linear_trend(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("x")).agg(F.count("*").alias("n"))
    return daily.groupBy("event_type").agg(F.round(F.regr_slope("n", "x"), 6).alias("slope"), F.round(F.regr_intercept("n", "x"), 6).alias("intercept"))


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, each id once."""
    events = jobs.stream_of(spark, f"{d}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.drained(jobs.deduplicated(events, ["event_id"], "ts", "60 days"), jobs.folder_of(spark)).select("event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0) DESC, event_id) AS rn FROM events) WHERE rn = 1")
def stream_best_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, the one of largest value of each user as running state."""
    events = jobs.stream_of(spark, f"{d}/events.parquet").select("event_id", "event_type", "user_id", "value")
    return jobs.drained(jobs.best(events, ["user_id"], F.col("value"), F.col("event_id"), ["event_id", "event_type"]), jobs.folder_of(spark), "complete").select("user_id", "event_id", "event_type")


@query("SELECT event_type, date_trunc('week', ts)::DATE AS week_start, count(*) AS n FROM events GROUP BY ALL", days=('week_start',))
def stream_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, counted by week; the last state is the result."""
    events = jobs.stream_of(spark, f"{d}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.drained(jobs.weekly(events, "event_type", "ts"), jobs.folder_of(spark), "complete").select("event_type", "week_start", "n")


@query(r"""WITH f AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '\d') THEN 'digit' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL) AS got, n_chars FROM documents)
SELECT doc_id, len(got) AS n_extracted, round(greatest(0, least(1, len(got) / 3 - CASE WHEN n_chars < 4000 THEN 0 ELSE 0.1 END)), 6) AS confidence, round(len(got) / 6, 6) AS score FROM f""")
def extraction_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Facets found in each text, how sure the extraction is and how full."""
    t = F.col("text")
    got = F.array_compact(F.array(F.when(t.rlike(r"\d"), "digit"), F.when(t.contains("@"), "mail"), F.when(t.contains("|"), "table")))
    rows = _documents(spark, d).select("doc_id", "n_chars", got.alias("got"))
    finish = F.when(F.col("n_chars") < 4000, "end_turn").otherwise("length")
    return rows.select("doc_id", F.size("got").cast("long").alias("n_extracted"), F.round(X.confidence(F.col("got"), F.array(*(F.lit(k) for k in ("digit", "mail", "table"))), finish), 6).alias("confidence"), F.round(F.size("got") / 6, 6).alias("score"))


@query("""SELECT event_id, unnest(CASE WHEN k % 3 = 0 THEN [k::VARCHAR, event_type] WHEN k % 3 = 1 THEN [event_type] ELSE ['[broken'] END) AS tool FROM (SELECT event_id, event_type, (props::JSON->>'k')::INT AS k FROM events)""")
def json_tool_list_explode(spark: SparkSession, d: str) -> DataFrame:
    """Tools kept as JSON arrays, plain or malformed text, one row each."""
    k = F.get_json_object("props", "$.k").cast("int")
    raw = F.when(k % 3 == 0, F.to_json(F.array(k.cast("string"), "event_type"))).when(k % 3 == 1, F.col("event_type")).otherwise("[broken")
    return table(spark, d, "events").select("event_id", F.explode(X.list_of(raw)).alias("tool"))
