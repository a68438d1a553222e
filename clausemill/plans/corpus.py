"""The dataflows: documents to labelled clauses, and online analysis of pasted text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import lemmas as L
from clausemill.functions import text as T
from clausemill.functions.lexicon import FEATURES, KEEP_WORDS, POLICY, Lexicon
from clausemill.operators import clean, ngrams, rank, report, sample, score, segment
from clausemill.plans.stages import cut, exploded

MASTER = ("clause_id", "source_doc", "domain", "raw_text", "clean_text", "word_count", "token_count", "pattern_label", "risk_score", "risk_label", "modal_score", "consequence_score", "conditional_score", "has_negation", "obligation_count", "penalty_flag")


def cleaned(clauses: DataFrame) -> DataFrame:
    """Clauses without exact duplicates, noise and near duplicates, with ids in (domain, source_doc, pos) order."""
    order = ["domain", "source_doc", "pos"]
    clauses = cut(clauses, "segments")  # read twice
    unique = clean.drop_exact_duplicates(clauses, "raw_text", order).where(clean.is_clean(F.col("raw_text")))
    placed = rank.with_rank(unique, [F.col(c).asc() for c in order], "place")
    kept = clean.drop_near_duplicates(placed, "domain", "place", "raw_text", rare=True).drop("place")
    return segment.numbered_ids(kept, order, 5)


def preprocessed(clauses: DataFrame, lemmas: dict[str, str] | Callable | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """Adds clean_text and token_count; code snippets and clauses without content words leave.

    Without lemmas these follow the rules, with exceptions learnt from the clauses; without
    stop words the English ones of Spark's remover leave.
    """
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    if lemmas is None:
        words = F.split(T.preprocess(F.col("raw_text")), " ")
        clauses = L.with_exceptions(clauses, words, L.exceptions(exploded(clauses, [], words, "word")), "_learnt")
        lemmas = lambda w: L.lemma(w, F.col("_learnt"))
    rows = clauses.where(~clean.has_code(F.col("raw_text"))).withColumn("clean_text", F.array_join(T.content_tokens(F.col("raw_text"), stop, KEEP_WORDS, lemmas), " "))
    return rows.where("clean_text <> ''").withColumn("token_count", T.word_count(F.col("clean_text"))).drop("_learnt")


def labelled(clauses: DataFrame, lexicon: Lexicon = POLICY, text: str = "raw_text") -> DataFrame:
    """Adds risk_score and risk_label by both passes; the vocabulary pass comes first. Each row is one document of it."""
    grams = ngrams.ngrams(ngrams.tokens(F.col(text), ngrams.COUNT_TOKEN), 1, 3)
    vocab = ngrams.top_terms(clauses, grams)
    # only phrases of the lexicon matter, and those are at most as many as it has
    known = [*lexicon.consequences, *lexicon.conditionals]
    found = {r.term for r in vocab.where(F.col("term").isin(known)).collect()}
    return score.scored(clauses, text, lexicon, score.eligible(lexicon, found))


def master(docs: DataFrame, lexicon: Lexicon = POLICY, features: Lexicon = FEATURES, balanced: int | None = 1000, stop_words: list[str] | None = None) -> DataFrame:
    """The master table (16 columns) from documents (domain, source_doc, text)."""
    clauses = cut(preprocessed(cut(cleaned(segment.clauses(docs)), "cleaned"), None, stop_words), "clauses")
    rows = cut(labelled(clauses, lexicon), "labelled")
    if balanced:
        rows = sample.balance(rows, "risk_label", "risk_score", ["clause_id"], balanced).withColumn("key", sample.hash_order(["clause_id", "copy"], 42))
        rows = segment.numbered_ids(rows.drop("pos").withColumnRenamed("clause_id", "old_id"), ["key", "old_id", "copy"], 5)
    return score.features(rows, "raw_text", features).select(*MASTER)


def analyze(spark: SparkSession, text: str | None = None, documents: DataFrame | None = None, model=None, lexicon: Lexicon = POLICY, features: Lexicon = FEATURES) -> DataFrame:
    """Ranked clauses of pasted text, or of a table (doc, text); exactly one of the two.

    With a fitted ensemble its label and confidence rank the clauses, else the score's
    label and the score itself.
    """
    if (text is None) == (documents is None):
        raise ValueError("give either text or documents")
    docs = spark.createDataFrame([(0, text)], "doc long, text string") if documents is None else documents.select("doc", "text")
    rows = exploded(docs, ["doc"], segment.online(F.coalesce("text", F.lit(""))), "clause", "pos")
    if model is None:
        rows = score.scored(rows, "clause", lexicon).select("doc", "pos", "clause", F.col("risk_label").alias("label"), F.round(F.col("risk_score") * 100, 1).alias("confidence"))
    else:
        f = score.features(rows, "clause", features, tokens=T.plain_tokens).withColumnRenamed("word_count_f", "word_count").withColumn(model.text, T.preprocess(F.col("clause")))
        rows = model.transform(f).select("doc", "pos", "clause", F.col("predicted_risk_label").alias("label"), F.round(F.col("confidence") * 100, 1).alias("confidence"))
    return rank.ranked_online(rows, ["doc"], "pos")


def predictions(model, rows: DataFrame) -> DataFrame:
    """CSV mode: predicted_risk_label and the confidence as text, such as 87.3%."""
    return model.transform(rows).withColumn("confidence", F.format_string("%.1f%%", F.col("confidence") * 100)).drop("probabilities")


def error_analysis(model, rows: DataFrame, key: list[str]) -> dict[str, DataFrame]:
    """Wrong rows, the most confident of them, their breakdown and the metrics; rows need risk_label."""
    if "risk_label" not in rows.columns:
        raise ValueError("rows need risk_label")
    out = cut(model.transform(rows).drop("probabilities").withColumn("confidence", F.round("confidence", 3)).withColumn("correct", F.col("risk_label") == F.col("predicted_risk_label")), "errors")
    pair = ("risk_label", "predicted_risk_label")
    return {"errors": out.where("not correct"), "top": rank.confident_mistakes(out, *pair, "confidence", key), "breakdown": report.mistakes_by_class(out, *pair), "metrics": report.class_metrics(out, *pair)}
