"""Sentence boundaries learnt without labels: figures on built texts, hand cases, and the splitter alone."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from clausemill.operators import boundaries, segment
from clausemill.operators.boundaries import Boundaries

ABBREVIATIONS = ["e.g.", "approx.", "Dr.", "vs.", "dept.", "U.S."]


def corpus(n):
    """(text, sentences): words of three to eight letters, abbreviations inside of sentences, starters that recur."""
    r = random.Random(2)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 9))) for _ in range(400)]
    out = []
    for _ in range(n):
        made = []
        for _ in range(r.randrange(1, 12)):
            own = [r.choice(["However", "The", "This", r.choice(words).capitalize()]), *r.choices(words, k=r.randrange(4, 15))]
            for _ in range(r.randrange(3)):
                own.insert(r.randrange(1, len(own)), r.choice(ABBREVIATIONS))
            made.append(" ".join(own) + r.choice([".", ".", ".", "!", "?"]))
        out.append((" ".join(made), made))
    return out


def test_learnt_boundaries_on_built_texts(spark):
    made = corpus(400)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "id long, text string").repartition(6)
    model = boundaries.learn(df)
    assert set(model.abbreviations) == {a.lower().rstrip(".") for a in ABBREVIATIONS}
    assert {"however", "the", "this"} <= set(model.starters)

    def right(m):
        got = {r.id: r.s for r in df.select("id", segment.sentences(F.col("text"), m).alias("s")).collect()}
        return sum(got[i] == want for i, (_, want) in enumerate(made)) / len(made)

    assert right(model) > 0.97 and right(None) < 0.1
    again = boundaries.learn(df.repartition(1))
    assert again == model


def test_hand_cases(spark):
    model = Boundaries(("e.g", "dept", "u.s"), ("however", "the"))
    cases = {
        "Ask the dept. of state. However, wait.": ["Ask the dept. of state.", "However, wait."],
        "In the U.S. However, wait": ["In the U.S.", "However, wait"],
        "In the U.S. however small": ["In the U.S. however small"],
        "By J. Smith. (E.g. this) ok?! Yes": ["By J. Smith.", "(E.g. this) ok?!", "Yes"],
        "wait... dept. !": ["wait...", "dept. !"],
        "": [],
        " . ": ["."],
        "Dept.": ["Dept."],
        "a dept. b dept. c": ["a dept. b dept. c"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.s for r in df.select("t", segment.sentences(F.col("t"), model).alias("s")).collect()} == cases
    assert spark.range(1).select(segment.sentences(F.lit(None).cast("string"), model).alias("s")).first().s is None


def test_empty_corpora_learn_nothing(spark):
    for rows in ([], [(None,), ("",)], [("no periods here",)], [(". ! ?",)]):
        assert boundaries.learn(spark.createDataFrame(rows, "text string")) == Boundaries()


def test_the_segmenters_take_learnt_boundaries(spark):
    text = " ".join(["word"] * 20) + " by the dept. of " + " ".join(["rule"] * 25) + "."
    docs = spark.createDataFrame([(d, "x", text) for d in ("hr", "legal", "privacy")], "domain string, source_doc string, text string")
    model = Boundaries(("dept",), ())
    assert segment.clauses(docs).count() == 6 and [r.word_count for r in segment.clauses(docs, model=model).collect()] == [49] * 3


def test_any_number_of_entries(spark, monkeypatch):
    """Queries do not list what is learnt, so the number of entries has no limit."""
    wanted = {n: sorted(map(tuple, entry.queries()[n](spark, "/root/testdata/sf0.001").collect())) for n in ("g04_starters", "g04_learnt_sentences")}
    monkeypatch.setattr(boundaries, "MOST", 0)
    for name, rows in wanted.items():
        assert rows and rows == sorted(map(tuple, entry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
