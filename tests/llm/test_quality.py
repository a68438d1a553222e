"""Quality rules against a plain statement of each measure."""

import re

from clausemill.llm import quality

TEXTS = [None, "", "   \n\t", "one two", "a b c d e " * 4, "x\ny\nx\n\n\nx ", "a #1 $$ | b c d e f g h i", "w\xa0v\x1cu t", "LOUD WORDS ONLY HERE AND NOTHING ELSE TO READ AT ALL", "the quick brown fox jumps over a lazy dog near the old river bank today", "long " + " ".join(f"w{i}" for i in range(5000))]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(windows) < 500 else set()
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(TEXTS)], "doc_id long, text string, kept boolean")
    ordered = quality.plan(docs, quality.rules())
    assert {r.name for r in ordered} == {r.name for r in quality.rules()}
    got = {r.doc_id: r for r in quality.measure(docs, ordered).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), i
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert [got[i].kept for i in (4, 8, 9, 10)] == [False, False, True, True]
    kept = quality.keep(docs, ordered)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept} and kept.columns == docs.columns
    assert quality.measure(docs.limit(0), ordered).collect() == []


def test_the_order_does_not_change_the_verdict(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "a b " * 30, "LOUD " * 20, "# $ % x " * 9] * 2)], "doc_id long, text string")
    want = None
    for shift in range(6):
        rules = quality.rules()
        ordered = rules[shift:] + rules[:shift]
        got = sorted(map(tuple, quality.measure(docs, ordered).collect()))
        assert want in (None, got)
        want = got
        assert sorted(r.doc_id for r in quality.keep(docs, ordered).collect()) == [r[0] for r in got if r[-1]]


def test_a_cascade_stops_at_the_first_rejection():
    asked = []
    ordered = [quality.Rule(str(k), lambda d, k=k: asked.append(k) or k == 1) for k in range(3)]
    assert any(r.rejects(quality.Document("x")) for r in ordered) and asked == [0, 1]
