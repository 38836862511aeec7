"""Registered queries over fuzzy names, vectors, clusters, series, trust and patterns, each beside its SQL if it has any."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import metrics as M
from ..operators import dedup, density, fuzzy, isolation, patterns, ranges, series, shortlist, trust
from ..sources.tables import table
from ..streaming import best, jobs
from .registry import query

#: Words of so many letters or more are taken as names: below, no edit is allowed at this likeness.
NAME_LETTERS = 9
_PERCENT = round(100 * fixed.FUZZY_AT)
NAMES = f"SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS name FROM documents) WHERE length(name) >= {NAME_LETTERS}"


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Long words of all texts, as names."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all(low, F.lit("([a-z]+)"))).alias("name")).where(F.length("name") >= NAME_LETTERS).distinct()


@query(f"""WITH n AS MATERIALIZED ({NAMES}), l AS (SELECT name, length(name) AS len, unnest(range(({_PERCENT} * length(name) + 99) // 100, length(name) + 1)) AS other FROM n)
SELECT least(a.name, b.name) AS left_name, greatest(a.name, b.name) AS right_name, levenshtein(a.name, b.name)::INT AS distance FROM l b JOIN n a ON length(a.name) = b.other
WHERE (b.len > b.other OR a.name < b.name) AND 100 * levenshtein(a.name, b.name) <= {100 - _PERCENT} * b.len""")
def fuzzy_name_links(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of names of a likeness of 0.88 or more by edit distance."""
    return fuzzy.name_links(_names(spark, d), "name")


@query()
def fuzzy_name_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every name with the least name that it is linked with, directly or not."""
    return fuzzy.name_clusters(_names(spark, d), "name")


@query()
def cosine_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """The ten most like vectors of every vector whose id is divisible by 50, by a coarse quantiser."""
    vectors = table(spark, d, "embeddings")
    return shortlist.shortlist(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding")


@query("""WITH v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
c AS (SELECT q.id AS query_id, v.id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS cosine FROM v JOIN v q ON q.id % 50 = 0 AND q.id <> v.id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank, id, round(cosine, 6) AS cosine FROM c QUALIFY rank <= 10""")
def cosine_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The same shortlist without loss: every cell is probed, in blocks."""
    vectors = table(spark, d, "embeddings")
    return shortlist.shortlist(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", probes=shortlist.MOST_CELLS).withColumn("cosine", F.round("cosine", 6))


def _hours(spark: SparkSession, d: str) -> DataFrame:
    """Events as points: hours since the epoch and value."""
    return table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("hour"), "value")


@query("""WITH RECURSIVE p AS MATERIALIZED (SELECT event_id AS id, epoch_us(ts) / 3.6e9 AS x, value AS y FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND isfinite(value)),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON b.x >= a.x - 2.0 AND b.x <= a.x + 2.0 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 4), links AS MATERIALIZED (SELECT a, b FROM near SEMI JOIN core c ON a = c.id SEMI JOIN core d ON b = d.id),
r AS (SELECT id, id AS seen FROM core UNION SELECT r.id, l.b FROM r JOIN links l ON r.seen = l.a), k AS MATERIALIZED (SELECT id, min(seen) AS cluster FROM r GROUP BY 1)
SELECT p.id, bool_or(p.id = k.id) IS TRUE AS core, coalesce(min(k.cluster) FILTER (p.id = k.id), min(k.cluster)) AS cluster FROM p LEFT JOIN near ON near.a = p.id LEFT JOIN k ON k.id = near.b GROUP BY 1""")
def event_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Density-based clusters of events that are near in time (hours) and value."""
    return density.dbscan(_hours(spark, d), "event_id", ["hour", "value"], 2.0, 4)


@query()
def event_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """How isolated each line's quantity, price, discount and tax are."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    keyed = lines.withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey"))
    forest = isolation.fit(keyed, "key", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return forest.judge(keyed).select("l_orderkey", "l_linenumber", "l_partkey", "anomaly")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return series.daily(table(spark, d, "events"), "event_type", F.to_date("ts"))


DAILY = """SELECT s.event_type, s.day, count(e.event_id) AS n FROM (SELECT event_type, unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events WHERE event_type IS NOT NULL GROUP BY 1) s
LEFT JOIN events e ON e.event_type = s.event_type AND e.ts::DATE = s.day GROUP BY 1, 2"""


@query(f"SELECT * FROM ({DAILY})", days=("day",))
def daily_series(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each event type and day, with days of none."""
    return _daily(spark, d)


@query(f"""WITH w AS (SELECT event_type, day, n, n - lag(n) OVER o AS w FROM ({DAILY}) WINDOW o AS (PARTITION BY event_type ORDER BY day)),
f AS (SELECT event_type, regr_slope(w, before) AS phi, regr_intercept(w, before) AS c, count(*) + 2 AS n_points FROM (SELECT *, lag(w) OVER (PARTITION BY event_type ORDER BY day) AS before FROM w) WHERE before IS NOT NULL GROUP BY 1),
z AS (SELECT event_type, arg_max(n, day) AS y, arg_max(w, day) AS w FROM w GROUP BY 1),
s AS (SELECT event_type, n_points, y, c + phi * w AS w1, c + phi * (c + phi * w) AS w2, c + phi * (c + phi * (c + phi * w)) AS w3 FROM f JOIN z USING (event_type))
SELECT event_type, n_points, round(y + w1, 4) AS next_1, round(y + w1 + w2, 4) AS next_2, round(y + w1 + w2 + w3, 4) AS next_3 FROM s""")
def arima_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The next three days of each event type by ARIMA(1, 1, 0)."""
    steps = series.arima(_daily(spark, d), "event_type", "day", "n", 1, 1, 0, 3)
    return steps.groupBy("event_type", "n_points").agg(*(F.round(F.max(F.when(F.col("step") == k, F.col("forecast"))), 4).alias(f"next_{k}") for k in (1, 2, 3)))


@query()
def arima_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Errors of ARIMA(1, 1, 1) and of persistence over the last five days of each event type."""
    return series.arima_backtest(_daily(spark, d), "event_type", "day", "n")


@query("""WITH b AS (SELECT event_type, quantile_disc(value, 0.01) AS low, quantile_disc(value, 0.99) AS high FROM events GROUP BY 1)
SELECT event_id, e.event_type, low, high, value < low OR value > high AS outlier FROM events e LEFT JOIN b ON e.event_type IS NOT DISTINCT FROM b.event_type""")
def density_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Events whose value is among the outer hundredths of their type."""
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    return series.density_outliers(rows, "event_type", "value").drop("value")


LABELLED = "SELECT least(1.0, round(n_chars / 5000.0, 2))::DOUBLE AS score, quality FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents, their length as a score of quality."""
    score = F.least(F.lit(1.0), M.rounded(F.col("n_chars") / 5000.0, 2))
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", score.alias("score"), "quality").where("score is not null and quality is not null")


@query(f"""WITH r AS ({LABELLED}), s AS (SELECT score, sum(quality)::DOUBLE AS p, sum(1 - quality)::DOUBLE AS n FROM r GROUP BY 1)
SELECT round((SELECT sum(a.p * (b.n + 0.0)) FROM s a JOIN s b ON b.score < a.score) / (sum(p) * sum(n)) + sum(p * n) / 2 / (sum(p) * sum(n)), 6) AS roc_auc FROM s""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    """How well length tells labelled quality."""
    return M.roc_auc(_labelled(spark, d), "quality", "score").withColumn("roc_auc", F.round("roc_auc", 6))


@query(f"""WITH s AS MATERIALIZED (SELECT score, sum(quality)::DOUBLE AS p, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY score) AS i FROM ({LABELLED}) GROUP BY 1),
c AS MATERIALIZED (SELECT i, sum(p) OVER (ORDER BY i) AS p, sum(n) OVER (ORDER BY i) AS n FROM s UNION ALL SELECT 0, 0, 0),
m AS MATERIALIZED (SELECT a.i + 1 AS j, b.i AS k, (b.p - a.p) / (b.n - a.n) AS rate FROM c a JOIN c b ON b.i > a.i),
least_of AS (SELECT s.i, m.j, min(m.rate) AS rate FROM s JOIN m ON m.j <= s.i AND m.k >= s.i GROUP BY 1, 2)
SELECT score, n::BIGINT AS n, round(max(rate), 6) AS calibrated FROM least_of JOIN s USING (i) GROUP BY 1, 2""")
def isotonic_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Scores as probabilities that never fall as the score rises; in SQL as the largest of smallest means."""
    rows = M.calibrated(_labelled(spark, d), "quality", "score")
    return rows.groupBy("score").agg(F.count("*").alias("n"), M.rounded(F.max("calibrated"), 6).alias("calibrated"))


CLAIMS = "SELECT DISTINCT l_partkey, 'returnflag' AS field, l_returnflag AS value, l_suppkey FROM lineitem WHERE l_returnflag IS NOT NULL AND l_suppkey IS NOT NULL UNION SELECT DISTINCT l_partkey, 'linestatus', l_linestatus, l_suppkey FROM lineitem WHERE l_linestatus IS NOT NULL AND l_suppkey IS NOT NULL"
_TRUST = f"WITH said AS MATERIALIZED ({CLAIMS}), t0 AS (SELECT l_suppkey, {trust.START}::DOUBLE AS trust FROM said GROUP BY 1)" + "".join(
    f""", b{k} AS MATERIALIZED (SELECT l_partkey, field, value, sum(trust) / sum(sum(trust)) OVER (PARTITION BY l_partkey, field) AS belief, count(*) AS n_feeds, min(l_suppkey) AS first_feed FROM said JOIN t{k} USING (l_suppkey) GROUP BY 1, 2, 3)
, t{k + 1} AS MATERIALIZED (SELECT l_suppkey, avg(belief) AS trust, count(*) AS n_claims FROM said JOIN b{k} USING (l_partkey, field, value) GROUP BY 1)""" for k in range(trust.ROUNDS + 1)
)


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """What suppliers say of parts: a supplier is a feed, a part's field has conflicting values."""
    lines = table(spark, d, "lineitem")
    said = lambda name, c: lines.select("l_partkey", F.lit(name).alias("field"), F.col(c).alias("value"), "l_suppkey")
    return said("returnflag", "l_returnflag").unionByName(said("linestatus", "l_linestatus"))


@query(_TRUST + f" SELECT l_partkey, field, value, round(belief, 6) AS belief, n_feeds, first_feed FROM b{trust.ROUNDS} QUALIFY row_number() OVER (PARTITION BY l_partkey, field ORDER BY round(belief, 9) DESC, value) = 1")
def trusted_values(spark: SparkSession, d: str) -> DataFrame:
    """The value of each field that feeds support best by their trust, and how many do."""
    return trust.settled(_claims(spark, d), ["l_partkey", "field"], "value", "l_suppkey")[0].withColumn("belief", F.round("belief", 6))


@query(_TRUST + f" SELECT l_suppkey, round(trust, 6) AS trust, n_claims FROM t{trust.ROUNDS}")
def feed_trust(spark: SparkSession, d: str) -> DataFrame:
    """Each feed's trust after all rounds."""
    return trust.settled(_claims(spark, d), ["l_partkey", "field"], "value", "l_suppkey")[1].withColumn("trust", F.round("trust", 6))


@query("""WITH c AS (SELECT p_brand AS key, (o_orderdate::DATE - DATE '1995-01-01') AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL AND o_orderdate IS NOT NULL),
o AS (SELECT unnest(range(0, ((DATE '1998-08-01' - DATE '1995-01-01') // 30) + 1)) AS origin),
s AS (SELECT origin, key, count(*) FILTER (x < origin * 30) AS train, count(*) FILTER (x >= origin * 30) AS test, count(*) FILTER (x < origin * 30 AND x >= origin * 30 - 30) AS recent FROM c JOIN o ON x >= origin * 30 - 60 AND x < origin * 30 + 30 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY train DESC, key) AS a, row_number() OVER (PARTITION BY origin ORDER BY test DESC, key) AS b FROM s)
SELECT DATE '1995-01-01' + (origin * 30)::INT AS origin, sum(train)::BIGINT AS n_train, sum(test)::BIGINT AS n_test, count(*) AS n_keys, round(avg(abs(train * 30 / 60 - test)), 6) AS mae, round(avg(abs(recent - test)), 6) AS persistence_mae, count(*) FILTER (a <= 3 AND b <= 3 AND train > 0 AND test > 0) AS hits
FROM r GROUP BY r.origin HAVING n_train > 0 AND n_test > 0""", days=("origin",))
def rolling_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Forecast errors and hits of brands' sales at every origin, all origins in one plan."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    rows = lines.join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    out = series.rolling_origin(rows, "p_brand", F.to_date("o_orderdate"), "1995-01-01", "1998-08-01")
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "persistence_mae")})


#: Patterns made by a rule: consonant, vowel, consonant.
SYLLABLES = ["".join(x) for x in itertools.product("zxqvkjw", "aeiou", "bcdfgklmnprstvwz")]
_SYLLABLES = "[" + ", ".join(f"'{s}'" for s in SYLLABLES) + "]"


@query(f"SELECT doc_id, (list_min(list_filter(range(1, {len(SYLLABLES)} + 1), lambda i: contains(lower(text), {_SYLLABLES}[i]))) - 1)::INT AS place FROM documents")
def pattern_first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first of many patterns that each text holds, by one pass over the text."""
    return table(spark, d, "documents").select("doc_id", patterns.first_match(F.lower("text"), SYLLABLES).alias("place"))


@query("SELECT coalesce(source, '') AS sector, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(source, '')) AS rank FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN '' ELSE source END AS source FROM documents) GROUP BY 1")
def sector_volume_all(spark: SparkSession, d: str) -> DataFrame:
    """Volume of every sector, that without a name kept, the largest first; a tenth of the records are made nameless."""
    named = table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.coalesce("source", F.lit(""))).alias("sector"))
    return ranges.numbered(named.groupBy("sector").agg(F.count("*").alias("n")), [F.col("n").desc(), F.col("sector")], "rank")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id IS NOT NULL ORDER BY event_id LIMIT 1000")
def row_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand events by id: a reader's cap on rows, the same ones each time."""
    return table(spark, d, "events").where("event_id is not null").orderBy("event_id").limit(1000).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0) DESC, event_id) AS rn FROM events) WHERE rn = 1 AND user_id IS NOT NULL")
def stream_best_changes(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream that says when a user's largest value changes, its state cleared in time; the best of what went out."""
    events = jobs.stream_of(spark, f"{d}/events.parquet").select("event_id", "event_type", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    changes = jobs.drained(best.best_changes(events, ["user_id"], "value", "event_id", ["event_type"], "ts", "60 days"), jobs.folder_of(spark))
    return dedup.best_per_key(changes, ["user_id"], F.col("value"), F.col("event_id")).select("user_id", "event_id", "event_type")
