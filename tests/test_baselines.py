"""Baselines and the search for parameters."""

import random

import pytest

from clausemill.operators import ml, report


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    words = {"Critical": ["termination", "dismissal", "breach"], "Low": ["guidance", "note", "inform"], "Medium": ["monitor", "caution", "covenant"]}
    out = []
    for i in range(240):
        y = r.choice([*words])
        out.append((i, None if i % 60 == 0 else y, " ".join([*r.choices(words[y], k=2), *r.choices("party report annex schedule".split(), k=5)]), *(float(r.randrange(3)) for _ in ml.NUMERIC)))
    return spark.createDataFrame(out, "id long, risk_label string, clean_text string, " + ", ".join(f"{c} double" for c in ml.NUMERIC)).repartition(4)


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_baselines_learn_and_report(rows, kind):
    model = ml.baseline(rows, "clean_text", kind, trees=10, n_words=40, n_chars=40)
    out = model.transform(rows)
    assert set(out.columns) == {*rows.columns, "probabilities", "confidence", "predicted_risk_label"} and out.count() == 240
    metrics = {r.label: r for r in report.class_metrics(out.where("risk_label IS NOT NULL"), "risk_label", "predicted_risk_label", ("Critical", "Low", "Medium")).collect()}
    assert metrics["macro avg"].f1 > 0.9 and model.labels == ("Critical", "Low", "Medium")
    assert all(abs(sum(r.probabilities) - 1) < 1e-6 and r.confidence == max(r.probabilities) for r in out.limit(9).collect())


def test_unknown_baselines_are_errors(rows):
    with pytest.raises(ValueError, match="logistic or forest"):
        ml.baseline(rows, "clean_text", "oracle", n_words=9, n_chars=9)


def test_search_finds_the_better_parameters_and_repeats(rows):
    ranges = {"rounds": (1, 6), "depth": (1, 2), "rate": (0.3,)}
    found = ml.search(rows, "clean_text", draws=9, folds=2, ranges=ranges, n_words=40, n_chars=40)
    assert len(found) == 4 and [x["score"] for x in found] == sorted((x["score"] for x in found), reverse=True)  # four combinations, each once
    assert found[0]["rounds"] == 6 and 0.7 < found[0]["score"] <= 1
    again = ml.search(rows.repartition(2), "clean_text", draws=9, folds=2, ranges=ranges, n_words=40, n_chars=40)
    assert [{k: round(v, 9) for k, v in x.items()} for x in again] == [{k: round(v, 9) for k, v in x.items()} for x in found]


def test_macro_f1():
    assert ml.macro_f1([]) == 0.0
    assert ml.macro_f1([("a", "a", 3), ("a", "b", 1), ("b", "b", 2), ("b", "a", 2)]) == pytest.approx((6 / 9 + 4 / 7) / 2)
    assert ml.macro_f1([("a", "c", 2)]) == 0.0
