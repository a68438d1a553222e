"""From raw documents to packed token windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept; ``run`` writes every stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm import language, ngram_join, packing, pii, quality
from clausemill.llm.common import materialise, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no text, no letters, or of no language that a filter knows); a missing lang is filled with the prediction.

    A document whose own lang has no filter is not for the others to judge and needs letters only.
    """
    filters, letters = language.fit(docs), F.col("text").rlike(r"\p{L}")
    if not filters.learnt:  # no labels to learn from
        return docs.where(letters)
    name, score = (next(x for x in (f"{y}{'_' * k}" for k in range(len(docs.columns) + 1)) if x not in docs.columns) for y in ("lang_pred", "score"))
    found = language.identify(docs, filters, True, (name, score)).where((F.col(name) != "und") | ~F.col("lang").isin(filters.learnt) & letters)
    return found.withColumn("lang", F.coalesce("lang", name)).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects, null and empty texts among them; rows that repeat are judged each for itself."""
    return quality.keep(docs, quality.plan(docs, quality.rules()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows the text. Null texts stay null, rows that repeat stay repeated."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens; a null text is its end id alone, rows that repeat are packed each for itself."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language_id), ("quality", quality_rules), ("near_duplicates", near_duplicates), ("pii", personal_data), ("packing", pack)]

#: Language filters, the random field and packing are not for SQL to express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
