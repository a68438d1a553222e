"""The ensemble's predictions in batches of tokens against the stages that it was fitted with."""

import random

import pytest
from pyspark.sql import functions as F

from clausemill.operators import ml, sample

TEXTS = ["", "   ", "the of and", "Der Vertrag endet vertrag Vertrag ENDET", "a b c", "x", "ab", "É été naïve-café don't stop_word", "été ́x İstanbul 𝒳𝒴 party", "must must must not the must", "party report annex\nschedule", "it's party's"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(7)
    words = "party report annex schedule must not the of shall vertrag endet été cannot, (annex) report. a-b".split()
    texts = [*TEXTS, None, *(" ".join(r.choices(words, k=r.randrange(1, 40))) for _ in range(300))]
    out = [(i, "AB"[i % 2] if i % 3 else "C", t, *(float(r.randrange(3)) if r.random() < 0.9 else None for _ in ml.NUMERIC)) for i, t in enumerate(texts)]
    return spark.createDataFrame(out, "id long, risk_label string, clean_text string, " + ", ".join(f"{c} double" for c in ml.NUMERIC)).repartition(3)


@pytest.fixture(scope="module")
def model(rows):
    return ml.fit(rows, "clean_text", trees=3, boosts=2, depth=3, n_words=40, n_chars=50)


def by_stages(model, rows):
    """id -> (nonzero features, probabilities), each from its own column."""
    out = model.features.transform(ml.prepare(rows, "clean_text"))
    own = out.select("id", "features", *(getattr(model, m).probabilities(F.col("features")).alias(m) for m in ml.MEMBERS)).collect()
    found = {}
    for x in own:
        sparse = {i: v for i, v in enumerate(x.features.toArray().tolist()) if v}
        found[x.id] = sparse, [(a + b + c) / 3 for a, b, c in zip(*(x[m] for m in ml.MEMBERS), strict=True)]
    return found


@pytest.mark.parametrize("tokens,cells", [(500_000, 1 << 22), (30, 1 << 22), (500_000, 120), (1, 1)])
def test_batches_equal_the_stages(rows, model, monkeypatch, tokens, cells):
    want = by_stages(model, rows)
    got = {x.id: x.probabilities for x in model.transform(rows).collect()}
    assert got == {i: p for i, (_, p) in want.items()}
    monkeypatch.setattr(ml, "TOKENS", tokens)
    monkeypatch.setattr(ml, "CELLS", cells)
    scaled, assembled = model.features.stages[-2:]
    numbers = F.array(*(F.col(c) for c in assembled.getInputCols()[2:]))
    batch = scaled.transform(rows).select("id", ml.tokens(F.col("clean_text"), ml.WORD_TOKEN).alias("w"), ml.tokens(F.col("clean_text"), ml.CHUNK).alias("c"), numbers.alias("n")).toArrow().combine_chunks()
    ids, found = batch["id"].to_pylist(), {}
    for n, f, v, r in ml.TokenVectors.of(model.features).slices(*(batch[c].combine_chunks().slice(5) for c in "wcn")):
        held = [{} for _ in range(n)]
        for place, value, row in zip(f.tolist(), v.tolist(), r.tolist(), strict=True):
            if value:
                held[row][place] = value
        found |= dict(zip(ids[5 + len(found) :], held, strict=False))
    assert len(found) == len(ids) - 5 and found == {i: want[i][0] for i in ids[5:]}


def test_terms_as_frequent_are_kept_by_name(spark):
    table = spark.createDataFrame([(f"{x} {x}z",) + (1.0,) * len(ml.NUMERIC) for x in "qwertzuiopasdfghjklyxcvbnm"], "t string, " + ", ".join(f"{c} double" for c in ml.NUMERIC))
    for parts in (1, 5):
        words = ml.fit_features(table.repartition(parts), "t", 7, 7).stages[0].vocabulary
        assert words == ["az", "bz", "cz", "dz", "ez", "fz", "gz"]


def test_what_a_fit_chooses_its_rows_from_is_read_once(spark, rows):
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(_):
        read.add(1)
        return True

    ml.fit(rows.where(counted(F.col("id"))), "clean_text", trees=1, boosts=1, depth=1, n_words=9, n_chars=9)
    assert read.value == rows.count()


def test_predictions_make_no_string_of_each_ngram(rows, model):
    plan = model.transform(rows)._jdf.queryExecution().executedPlan().toString()
    assert "substring(" not in plan and plan.count("ArrowEvalPython [") == 1


def test_the_best_of_a_class_are_chosen_by_their_keys_alone(spark):
    r = random.Random(5)
    held = [(r.choice(["a", "b", None]), r.choice([None, 0.0, 0.5, float("nan")]), r.choice([None, 1, 2, 3]), f"text {i}") for i in range(400)]
    rows = spark.createDataFrame(held, "l string, s double, id int, t string").repartition(4)
    out = sample.top_per_class(rows, "l", "s", ["id"], 60)
    order = lambda x: (x[1] is None, x[1] == x[1] if x[1] is not None else False, -(x[1] or 0) if x[1] == x[1] else 0, x[2] is not None, x[2] or 0)  # noqa: E731  NaN is the greatest number
    for label in ("a", "b", None):
        want = sorted((x for x in held if x[0] == label), key=order)[:60]
        got = [x for x in out.collect() if x.l == label]
        assert sorted(map(str, (x[1:3] for x in want))) == sorted(str((x.s, x.id)) for x in got) and len({x.t for x in got}) == 60
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan  # the texts of the rest are neither sorted nor shuffled
