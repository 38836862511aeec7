"""A training corpus from raw documents: five stages, each on all that the one before it kept.

Null and empty texts have no words and fall to the quality rules; very long texts are judged and cut whole. Rows that repeat
an id are judged each on its own by rules and classifier; line dedup and the n-gram join take rows of one id as their own
docstrings say, and ties go to the smaller id, then to the earlier line. Rows without an id pass line dedup and the join as
they are. Extra columns go along through the first four stages, whatever their names; packing returns its own columns.
Empty documents or labels give no rows and no failure: without labels all that passes the base rules is kept. No option
of the session is changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import line_dedup, ngram_join, packing, quality_classifier, quality_rules
from tidewater.llm.common import materialize
from tidewater.llm.queries import WORD_TOKENIZER


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep."""
    return quality_rules.filter_documents(docs, quality_rules.fit(docs, _labels(spark, sf_dir)))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is 1/2 or more."""
    return quality_classifier.filter_documents(docs, _labels(spark, sf_dir))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one line of each component of like lines; emptied documents go."""
    return line_dedup.filter_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each component of near duplicates."""
    return ngram_join.keep_first(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES = [("quality_rules", rules_stage), ("quality_classifier", classifier_stage), ("line_dedup", lines_stage), ("ngram_join", near_stage), ("packing", packing_stage)]

#: Trained models and tokenizers stand in the way of SQL. tests/llm has each operator against brute force, and `run` end to end on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
