"""Clause scoring on a stream of documents, with a frozen vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions.lexicon import POLICY, Lexicon
from clausemill.functions.text import strip
from clausemill.operators import clean, score, segment


def scored_stream(docs: DataFrame, lexicon: Lexicon = POLICY, phrases: dict[str, float] | None = None, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Labelled clauses of documents (domain, source_doc, text) as they arrive.

    Segmentation, filters and scores are row-local.  With a time column, repeated
    clauses are dropped within the watermark.  Works on batch tables alike.
    """
    found = F.transform(segment.by_domain(F.coalesce("text", F.lit("")), F.coalesce("domain", F.lit(""))), lambda c: segment.clean_clause(c["text"]))
    keep = [c for c in (time, "domain", "source_doc") if c]
    rows = docs.select(*keep, F.posexplode(found).alias("pos", "raw_text"))
    rows = rows.where(segment.word_count(F.col("raw_text")).between(segment.MIN_WORDS, segment.MAX_WORDS)).where(clean.is_clean(F.col("raw_text")))
    if time:
        rows = rows.withColumn("_key", F.lower(strip(F.col("raw_text"))))
        rows = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]) if rows.isStreaming else rows.dropDuplicates(["_key"])
        rows = rows.drop("_key")
    return score.scored(rows, "raw_text", lexicon, phrases)


def label_counts(scored: DataFrame, time: str, window: str = "10 minutes", delay: str | None = None) -> DataFrame:
    """Counts of labels in tumbling windows."""
    rows = scored.withWatermark(time, delay) if delay else scored
    return rows.groupBy(F.window(time, window), "risk_label").agg(F.count("*").alias("n"), F.avg("risk_score").alias("mean_score"))
