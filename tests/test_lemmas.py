"""Lemmas by rule, irregular forms, and exceptions learnt from counts."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clausemill.functions import lemmas, text
from clausemill.plans import built, corpus

CASES = {
    "policies": "policy", "penalties": "penalty", "breaches": "breach", "taxes": "tax", "losses": "loss", "clauses": "clause", "notices": "notice", "fines": "fine",
    "class": "class", "status": "status", "basis": "basis", "dies": "die", "bus": "bus", "as": "as", "applied": "apply", "agreed": "agree", "hopping": "hop", "permitted": "permit",
    "received": "receive", "terminated": "terminate", "authorizing": "authorize", "disclosed": "disclos", "amended": "amend", "walking": "walk", "treated": "treat", "stated": "state", "red": "red", "thing": "thing", "string": "string", "feed": "feed", "exceed": "exceed", "guaranteed": "guarantee",
    "was": "be", "held": "hold", "children": "child", "": "", "ed": "ed", "sss": "sss",
}


def test_rules(spark):
    df = spark.createDataFrame([(w,) for w in CASES], "w string")
    assert {r.w: r.x for r in df.select("w", lemmas.lemma(F.col("w")).alias("x")).collect()} == CASES
    assert spark.range(1).select(lemmas.lemma(F.lit(None).cast("string")).alias("x")).first().x is None


def words(spark, **counts):
    return spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string").repartition(4)


def test_exceptions_follow_the_counts(spark):
    own = words(spark, disclosed=3, disclose=9, closing=2, close=6, clos=1, filling=4, fill=7, fil=6, rated=1, rate=4, walking=2, walke=5, walk=5, held=3, hel=9)
    # fill and walk are what the rule takes; walke is as frequent, but comes later; a word without the ending has no stems
    assert lemmas.learn(own) == {"disclosed": "disclose", "closing": "close"}
    assert lemmas.learn(own, least=10) == {} == lemmas.learn(own.limit(0))
    learnt = lemmas.learn(own)
    got = spark.createDataFrame([("disclosed",), ("closing",), ("walking",), ("rated",)], "w string").select(lemmas.lemma(F.col("w"), learnt).alias("x")).collect()
    assert [r.x for r in got] == ["disclose", "close", "walk", "rate"]


@pytest.mark.parametrize("rule", [lemmas.lemma, {"terminated": "end"}])
def test_content_tokens_take_expressions_and_tables(spark, rule):
    df = spark.createDataFrame([("The parties terminated all policies.",)], "t string")
    got = df.select(F.array_join(text.content_tokens(F.col("t"), ["the", "all"], (), rule), " ").alias("x")).first().x
    assert got == ("party terminate policy" if callable(rule) else "parties end policies")


def test_clean_text_has_lemmas_learnt_from_the_clauses(spark):
    rows = [(f"The supplier disclosed {w} records under these policies without consent.",) for w in ("secret", "old", "new")] + [("They must disclose the record, and disclose it quickly; disclose all, disclose more.",)] * 2
    got = [r.clean_text for r in corpus.preprocessed(spark.createDataFrame(rows, "raw_text string")).collect()]
    assert got[0].startswith("supplier disclose secret record") and got[0].split()[-2:] == ["without", "consent"] and "policy" in got[0]


def test_any_number_of_exceptions(spark, monkeypatch):
    """The query does not list the exceptions, so their number has no limit; its lemmas are those by a list."""
    docs = built.documents(spark, "/root/testdata/sf0.001").select("doc_id", F.expr(f"regexp_extract_all({built.INFLECTED}, '[a-z]+', 0)").alias("w"))
    learnt = lemmas.learn(docs.select(F.explode("w").alias("word")))
    wanted = docs.select("doc_id", F.array_join(F.transform("w", lambda w: lemmas.lemma(w, learnt)), " ")).collect()
    monkeypatch.setattr(lemmas, "MOST", 0)
    assert learnt and sorted(map(tuple, wanted)) == sorted(map(tuple, entry.queries()["n03_lemmas"](spark, "/root/testdata/sf0.001").collect()))
