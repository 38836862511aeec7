"""One query per numbered operator, over its whole table; SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import shared_dir
from . import bpe, chat_format, fingerprints, line_dedup, ngram_join, packing, phrases, quality_classifier, quality_rules, token_counts, token_files, url_filter, vector_codes
from .common import materialize

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The rules of op5: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every encoded length with its suffix sums."""
    histogram = token_counts.length_histogram(table(spark, sf_dir, "documents"), BYTE_RANKS)
    return token_counts.with_suffix_sums(ngram_join.materialize(histogram, "lengths"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document."""
    return quality_classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness."""
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted pairs: each conversation against a worse answer, and against the next of its opening."""
    turns = table(spark, sf_dir, "conversations")
    pairs = chat_format.swapped(turns).select(F.concat(F.lit("swapped:"), "pair_id").alias("pair_id"), "chosen", "rejected").unionByName(
        chat_format.neighbours(turns).select(F.concat(F.lit("neighbour:"), "pair_id").alias("pair_id"), "chosen", "rejected")
    )
    masked = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return chat_format.format_pairs(pairs).select(
        "pair_id", F.col("n_common").cast("long").alias("n_common"), F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("chosen_completion", 256).alias("chosen_sha256"), F.sha2("rejected_completion", 256).alias("rejected_sha256"),
        masked("chosen_mask").alias("chosen_masked"), masked("rejected_mask").alias("rejected_masked"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of every text's ids and of what they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_RANKS)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece of a sequence that each part of every document fills."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document: lines before, lines that went, and the hash of the text left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_lines", F.expr("octet_length(text) - octet_length(replace(text, '\\n', '')) + 1").cast("long"))
    return line_dedup.deduped(docs).select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document among those whose shingle sets overlap."""
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the files of all ids."""
    out = f"{shared_dir(spark)}/tidewater/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER, out, end_id=2)
    return token_files.read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector by codebooks trained on all of them."""
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.train(vectors)
    coded = materialize(vector_codes.encode(vectors, books), "codes")
    return vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first collocations over all texts."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_quality_classifier, op3_fingerprints, op4_chat_format, op5_url_filter, op6_byte_bpe, op7_packing, op8_line_dedup, op9_ngram_join, op10_quality_rules, op11_token_files, op12_vector_codes, op13_phrases)}

#: One round of op12 in SQL: every distinct part to its nearest entry, every entry to the mean of its parts.
_CODES_ROUND_SQL = """
near{k} AS MATERIALIZED (
  SELECT d.p, d.part, d.n, arg_min(e, dist * 16 + e) AS e, min(dist) AS dist
  FROM (SELECT d.*, b.e, list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - entry[i]) * (part[i] - entry[i])))::HUGEINT AS dist FROM parts d JOIN book{k} b ON d.p = b.p) d
  GROUP BY d.p, d.part, d.n),"""
_CODES_BOOK_SQL = """
book{next} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM book{k} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS entry
    FROM (SELECT p, e, i, sum(part[i] * n) AS s, sum(n) AS n FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(part)) FROM parts) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e) m
  ON b.p = m.p AND b.e = m.e),"""
_CODES_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // {vector_codes.PARTS}) + 1 : (p + 1) * (len(v) // {vector_codes.PARTS})] AS part FROM kept, (SELECT unnest(range({vector_codes.PARTS})) AS p)),
parts AS MATERIALIZED (SELECT p, part, count(*) AS n FROM cut GROUP BY p, part),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {vector_codes.ENTRIES})),""" + "".join(
    _CODES_ROUND_SQL.format(k=k) + _CODES_BOOK_SQL.format(k=k, next=k + 1) for k in range(vector_codes.ROUNDS)
) + _CODES_ROUND_SQL.format(k=vector_codes.ROUNDS) + f"""
books AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{vector_codes.ROUNDS}),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', near.e), '' ORDER BY c.p) AS code, sum(dist)::BIGINT AS error
  FROM cut c JOIN near{vector_codes.ROUNDS} near ON c.p = near.p AND c.part = near.part GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, books"""

_PHRASES_SQL = f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
said AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM said, (SELECT unnest(range(1, {phrases.MOST_WORDS + 1})) AS k))
  GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= {phrases.MIN_COUNT}),
inside AS (SELECT DISTINCT s.lang, s.phrase FROM often s JOIN often b ON s.lang = b.lang AND b.k > s.k AND 100 * b.f >= 100 * s.f AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.w, unnest(range(1, c.k)) AS cut FROM often c ANTI JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase WHERE c.k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ') JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {phrases.TOP}"""

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES: dict[str, str] = {
    "op13_phrases": _PHRASES_SQL,
    "op12_vector_codes": _CODES_SQL,
    "op4_chat_format": """
WITH convs AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
said AS (
  SELECT *, list_filter(turns, lambda t: t.role = 'assistant') AS answers,
    list_max(list_transform(range(1, len(turns) + 1), lambda i: CASE WHEN turns[i].role = 'assistant' THEN i END)) AS last FROM convs),
worse AS (
  SELECT conv_id, turns AS chosen,
    list_transform(list_filter(range(1, len(turns) + 1), lambda i: last IS NULL OR i <> last OR (len(answers) > 1 AND answers[1].text <> '')),
      lambda i: {'role': turns[i].role, 'text': CASE WHEN i = last THEN answers[1].text ELSE turns[i].text END}) AS rejected FROM said),
following AS (
  SELECT conv_id, turns, lead(conv_id) OVER (PARTITION BY turns[1].role, turns[1].text ORDER BY conv_id) AS other FROM convs),
pairs AS (
  SELECT 'swapped:' || conv_id AS pair_id, chosen, rejected FROM worse
  UNION ALL SELECT 'neighbour:' || f.conv_id, f.turns, c.turns FROM following f JOIN convs c ON f.other = c.conv_id),
common AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] <> rejected[i])) - 1, least(len(chosen), len(rejected))) AS n FROM pairs)
SELECT pair_id, n AS n_common,
  sha256(array_to_string(list_transform(chosen[1:n], lambda t: '<' || t.role || '>' || chr(10) || t.text || chr(10)), '')) AS prompt_sha256,
  sha256(array_to_string(list_transform(chosen[n + 1:], lambda t: '<' || t.role || '>' || chr(10) || t.text || chr(10)), '')) AS chosen_sha256,
  sha256(array_to_string(list_transform(rejected[n + 1:], lambda t: '<' || t.role || '>' || chr(10) || t.text || chr(10)), '')) AS rejected_sha256,
  coalesce(list_sum(list_transform(chosen[n + 1:], lambda t: CASE WHEN t.role = 'assistant' THEN length(t.text) ELSE 0 END)), 0)::BIGINT AS chosen_masked,
  coalesce(list_sum(list_transform(rejected[n + 1:], lambda t: CASE WHEN t.role = 'assistant' THEN length(t.text) ELSE 0 END)), 0)::BIGINT AS rejected_masked
FROM common""",
    "op5_url_filter": f"""
WITH rules(host, path, verdict) AS (VALUES {_RULES_SQL}),
parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
found AS (
  SELECT s.host, s.path, max_by({{'rule': r.host || r.path, 'verdict': r.verdict}}, length(r.host) + length(r.path)) AS best
  FROM (SELECT DISTINCT host, path FROM split) s JOIN rules r
    ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY s.host, s.path)
SELECT page_id, s.host, s.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM split s LEFT JOIN found f ON s.host = f.host AND s.path = f.path""",
}
