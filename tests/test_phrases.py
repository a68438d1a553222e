"""The automaton against ``in``, and scores by it against scores by expressions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausemill.functions.lexicon import FEATURES, POLICY
from clausemill.functions.phrases import SEGMENT, Automaton
from clausemill.operators import score

WORDS = [*POLICY.consequences, *POLICY.conditionals, *POLICY.up, *POLICY.down]


def texts(seed, n):
    r = random.Random(seed)
    pieces = [*WORDS, "the", "ban", "anned", "é", " ", "x" * 40, "in the event", "of"]
    return [None, "", "x" * (3 * SEGMENT) + "termination", *(r.choice(["", " "]).join(r.choices(pieces, k=r.choice([1, 5, 40, 400]))) for _ in range(n))]


@pytest.mark.parametrize("phrases", [list(dict.fromkeys(WORDS)), ["a", "aa", "aaa", "ba", ""], ["é", "\U0001f600x", "xé"], ["x" * 700, "x" * 3], []])
def test_automaton_equals_contains(phrases):
    own = texts(1, 200) + ["aaaa", "baaab", "\U0001f600xé", "x" * 1_500]
    found = Automaton(phrases)
    want = [[i for i, p in enumerate(phrases) if t is not None and p in t] for t in own]
    assert found(pa.array(own, pa.string())).to_pylist() == want
    assert found(pa.array(own, pa.string())[7:50]).to_pylist() == want[7:50]  # a slice of a larger array
    assert found(pa.array([], pa.string())).to_pylist() == found(pa.array([""] * 0 + [None], pa.string()))[:0].to_pylist()


def test_a_phrase_across_every_segment_border():
    found = Automaton(["needle"])
    own = ["." * i + "needle" + "." * 2_000 for i in range(SEGMENT - 8, SEGMENT + 8)]
    assert found(pa.array(own)).to_pylist() == [[0]] * len(own)


@pytest.mark.parametrize("lexicon", [POLICY, FEATURES])
def test_scores_do_not_depend_on_the_way_of_matching(spark, monkeypatch, lexicon):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts(2, 150))], "id long, text string")
    many = {p: w for p, w in lexicon.consequences.items() if w > 0.5}

    def run(few):
        monkeypatch.setattr(score, "FEW", few)
        first = score.first_pass(rows, "text", lexicon).withColumn("p2", score.second_pass(F.col("text"), F.col("p1"), many))
        return sorted(map(tuple, first.drop("text").collect())), sorted(map(tuple, score.features(rows, "text", lexicon).drop("text").collect()))

    assert run(0) == run(10_000)


def test_phrase_hits_equal_plain_and_have_no_nested_loop(spark):
    table = spark.createDataFrame([(f"k{i % 3}", i, p, float(i)) for i, p in enumerate([*WORDS, *WORDS[:50]])] + [("k9", 0, None, 1.0), ("k8", 0, "", 2.0)], "kind string, ord int, phrase string, weight double")
    own = texts(3, 60)
    want: dict = {}
    for r in table.collect():
        for i, t in enumerate(own):
            if r.phrase is not None and r.phrase in (t or "").lower():
                want[i, r.kind] = max(want.get((i, r.kind), r.weight), r.weight)
    hits = score.phrase_hits(spark.createDataFrame([(i, t) for i, t in enumerate(own)], "id long, text string"), "id", "text", table)
    assert {(r.id, r.kind): r.weight for r in hits.collect()} == want
    assert "NestedLoop" not in hits._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="10,000"):
        score.phrase_hits(table, "kind", "phrase", spark.range(10_001).select(F.lit("k").alias("kind"), F.col("id").cast("string").alias("phrase"), F.lit(1.0).alias("weight")))
