"""Risk scores, labels and lexical features as Column expressions over a Lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import phrases as P
from clausemill.functions.lexicon import LABELS, Lexicon
from clausemill.functions.text import modal_tokens, word_count

W_MODAL, W_CONSEQUENCE, W_CONDITIONAL = 0.25, 0.5, 0.25
#: Lexicons of more phrases are matched by an automaton, in one pass over the text; fewer cost less inside the JVM. Results are the same.
FEW = 24


def _by_weight(words: dict[str, float], descending: bool = True) -> list[tuple[float, list[str]]]:
    groups: dict[float, list[str]] = {}
    for phrase, weight in words.items():
        groups.setdefault(weight, []).append(phrase)
    return sorted(groups.items(), reverse=descending)


class Found:
    """The phrases of some lexicon tables in a text, and what follows from them."""

    def __init__(self, text: Column, *tables):
        self.text, self.phrases = text, list(dict.fromkeys(p for t in tables for p in t))
        self.hits = None

    def over(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the numbers of the phrases found in the column ``name``, if an automaton finds them."""
        if len(self.phrases) <= FEW:
            return rows
        self.hits = F.col(name)
        return rows.withColumn(name, P.hits(self.text, self.phrases))

    def any(self, phrases) -> Column:
        if self.hits is not None:
            return F.arrays_overlap(self.hits, F.array(*(F.lit(self.phrases.index(p)) for p in phrases)).cast("array<int>"))
        out = F.lit(False)
        for p in phrases:
            out = out | self.text.contains(p)
        return out

    def best(self, words: dict[str, float]) -> Column:
        """Largest weight over all phrases that the text contains, else 0."""
        if not words:
            return F.lit(0.0)
        if self.hits is not None:
            return F.coalesce(P.largest(self.hits, self.phrases, words), F.lit(0.0))
        out = F
        for weight, own in _by_weight(words):
            out = out.when(self.any(own), F.lit(float(weight)))
        return out.otherwise(F.lit(0.0))

    def longest(self, words: dict[str, float]) -> Column:
        """Weight of the longest phrase that the text contains (of equals the first listed), else 0."""
        ranked = sorted(words, key=lambda p: -len(p))
        if not words:
            return F.lit(0.0)
        if self.hits is not None:
            place = P.smallest(self.hits, self.phrases, {p: i for i, p in enumerate(ranked)})
            return F.coalesce(F.get(F.array(*(F.lit(float(words[p])) for p in ranked)), place.cast("int")), F.lit(0.0))
        out = F
        for phrase in ranked:
            out = out.when(self.text.contains(phrase), F.lit(float(words[phrase])))
        return out.otherwise(F.lit(0.0))

    def amplifier(self, lexicon: Lexicon) -> Column:
        """1, raised to the largest factor up; any factor down overrides it by the smallest."""
        up = F.greatest(F.lit(1.0), self.best(lexicon.up))
        if not lexicon.down:
            return up
        if self.hits is not None:
            return F.least(up, P.smallest(self.hits, self.phrases, lexicon.down))  # least leaves nulls out
        out = F
        for factor, own in _by_weight(lexicon.down, descending=False):
            out = out.when(self.any(own), F.least(up, F.lit(float(factor))))
        return out.otherwise(up)


def any_token(tokens: Column, words) -> Column:
    return F.arrays_overlap(tokens, F.array(*(F.lit(w) for w in words)))


def best_token(tokens: Column, words: dict[str, float]) -> Column:
    """Largest weight of a token in the text, else 0."""
    out = F
    for weight, own in _by_weight(words):
        out = out.when(any_token(tokens, own), F.lit(float(weight)))
    return out.otherwise(F.lit(0.0)) if words else F.lit(0.0)


def first_pass(rows: DataFrame, text: str, lexicon: Lexicon, tokens: Column | None = None) -> DataFrame:
    """Adds modal (undamped), cons, cond, amp and p1; the text is lower-cased once."""
    low = rows.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    low = low.withColumn("_tokens", modal_tokens(F.col("_low")) if tokens is None else tokens)
    found = Found(F.col("_low"), lexicon.consequences, lexicon.conditionals, lexicon.up, lexicon.down)
    low = found.over(low, "_hits")
    parts = low.withColumns({"modal": best_token(F.col("_tokens"), lexicon.modals), "cons": found.best(lexicon.consequences), "cond": found.best(lexicon.conditionals), "amp": found.amplifier(lexicon)})
    return parts.withColumn("p1", combine(F.col("modal"), F.col("cons"), F.col("cond"), F.col("amp"))).drop("_low", "_tokens", "_hits")


def damped(modal: Column, cons: Column, cond: Column) -> Column:
    """A modal without consequence or condition counts 0.15 of its weight."""
    return F.when((cons == 0) & (cond == 0), modal * 0.15).otherwise(modal)


def combine(modal: Column, cons: Column, cond: Column, amp: Column) -> Column:
    """Weighted sum, critical floor, then amplifier and clamp."""
    total = damped(modal, cons, cond) * W_MODAL + cons * W_CONSEQUENCE + cond * W_CONDITIONAL
    floored = F.when(cons >= 0.95, F.greatest(total, F.lit(0.75))).otherwise(total)
    return F.least(floored * amp, F.lit(1.0))


def rounded(score: Column) -> Column:
    """Four decimals of the shortest decimal form, half up."""
    return F.round(score, 4)


def label(score: Column) -> Column:
    """Label of a rounded score."""
    return F.when(score >= 0.75, LABELS[0]).when(score >= 0.5, LABELS[1]).when(score >= 0.1, LABELS[2]).otherwise(LABELS[3])


def eligible(lexicon: Lexicon, vocabulary: set[str]) -> dict[str, float]:
    """Phrases of the second pass with their scores: in the vocabulary, and heavy or akin to a seed."""

    def akin(phrase: str) -> bool:
        return any(phrase in seed or seed in phrase for seed in lexicon.seeds)

    out: dict[str, float] = {}
    for words, factor in ((lexicon.consequences, 1.0), (lexicon.conditionals, 0.8)):
        for phrase, weight in words.items():
            if phrase in vocabulary and phrase not in out and (weight >= 0.7 or akin(phrase)):
                out[phrase] = weight * factor
    return out


def second_pass(text: Column, p1: Column, phrases: dict[str, float]) -> Column:
    """Raises a score half-way to the best eligible phrase where that lies more than 0.15 above it."""
    found = Found(F.lower(F.coalesce(text, F.lit(""))), phrases)
    if len(found.phrases) > FEW:
        found.hits = P.hits(found.text, found.phrases)
    best = found.best(phrases)
    return F.when(p1 == 0, F.lit(0.0)).when(best > p1 + 0.15, (p1 + best) / 2).otherwise(p1)


def scored(rows: DataFrame, text: str, lexicon: Lexicon, phrases: dict[str, float] | None = None, tokens: Column | None = None) -> DataFrame:
    """Adds risk_score and risk_label."""
    p = first_pass(rows, text, lexicon, tokens)
    final = second_pass(F.col(text), F.col("p1"), phrases) if phrases else F.col("p1")
    out = p.withColumn("risk_score", rounded(final)).withColumn("risk_label", label(F.col("risk_score")))
    return out.drop("modal", "cons", "cond", "amp", "p1")


def features(rows: DataFrame, text: str, lexicon: Lexicon, tokens=modal_tokens) -> DataFrame:
    """Adds modal_score, consequence_score, conditional_score, has_negation, word_count_f, obligation_count, penalty_flag."""
    low = rows.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    low = low.withColumn("_tokens", tokens(F.col("_low")))
    found = Found(F.col("_low"), lexicon.consequences, lexicon.conditionals, lexicon.negations)
    low = found.over(low, "_hits")
    wanted = F.array(*(F.lit(w) for w in lexicon.obligations)) if lexicon.obligations else F.array().cast("array<string>")
    out = low.withColumns(
        {
            "modal_score": best_token(F.col("_tokens"), lexicon.modals),
            "consequence_score": found.longest(lexicon.consequences),
            "conditional_score": found.longest(lexicon.conditionals),
            "has_negation": found.any(lexicon.negations).cast("int"),
            "word_count_f": word_count(F.col(text)),
            "obligation_count": F.size(F.filter(F.col("_tokens"), lambda w: F.array_contains(wanted, w))),
        }
    )
    return out.withColumn("penalty_flag", (F.col("consequence_score") >= 0.7).cast("int")).drop("_low", "_tokens", "_hits")


def lexicon_table(spark, lexicon: Lexicon) -> DataFrame:
    return spark.createDataFrame(lexicon.rows(), "kind string, ord int, phrase string, weight double")


def phrase_hits(rows: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """Join form of phrase matching: key, kind and the largest weight of its phrases.

    For lexicons that arrive as a table of at most 10,000 phrases, which goes into one automaton;
    rows meet the phrases that they contain and no others.
    """
    held = table.select("kind", "phrase", F.col("weight").cast("double")).where("phrase IS NOT NULL").limit(10_001).collect()
    if len(held) > 10_000:
        raise ValueError("a lexicon of more than 10,000 phrases is too large for an automaton in every task")
    phrases = list(dict.fromkeys(r.phrase for r in held))
    place = {p: i for i, p in enumerate(phrases)}
    wide = table.sparkSession.createDataFrame([(place[r.phrase], r.kind, r.weight) for r in held], "_place int, kind string, weight double")
    found = rows.select(key, P.hits(F.lower(F.coalesce(F.col(text), F.lit(""))), phrases).alias("_hits")).select(key, F.explode("_hits").alias("_place"))
    return found.join(F.broadcast(wide), "_place").groupBy(key, "kind").agg(F.max("weight").alias("weight"))
