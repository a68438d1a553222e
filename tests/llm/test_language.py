"""Language identification: held-out accuracy, and the filter's parts."""

import random
import zlib

import numpy as np

from clausemill.llm import language

WORDS = {"aa": "the of and water stone house garden over".split(), "bb": "der und wasser stein haus garten über".split(), "cc": "le et eau pierre maison jardin près".split()}


def rows(n=240):
    r = random.Random(4)
    out = [(i, " ".join(r.choices(WORDS[x], k=r.choice([4, 30]))), x) for i in range(n) for x in [r.choice(list(WORDS))]]
    return out + [(n, None, "aa"), (n + 1, "", "aa"), (n + 2, "123 $$ \n", "bb"), (n + 3, "water " * 30_000, None), (None, "eau et pierre", "cc"), (5, "le jardin", "cc")]


def test_held_out_accuracy_and_defined_cases(spark):
    docs = spark.createDataFrame([(i, t, x, "s", 0.5) for i, t, x in rows()], "doc_id long, text string, lang string, source string, score double").repartition(5)
    filters = language.fit(docs)
    assert filters.languages == ("aa", "bb", "cc")
    got = language.predictions(docs, filters).collect()
    assert len(got) == len(rows()) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {(i, x) for i, t, x in rows() if t and any(c.isalpha() for c in t)}
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert sum((r.doc_id, r.lang_pred) in truth for r in held) >= 0.98 * len(held) and held
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    assert [by[i].lang_pred for i in (240, 241, 242, 243)] == ["und", "und", "und", "aa"] and by[240].score == 0 and all(0 <= r.score <= 1 for r in got)
    out = language.identify(docs, filters)
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predictions(docs, nothing).collect()} == {"und"} and language.predictions(docs.limit(0), filters).collect() == []


def test_filter_has_every_learnt_gram_and_few_others():
    rng = np.random.default_rng(3)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, 9000)
    f = language.Filters.build(["x", "y"], [(int(i % 2), int(v)) for i, v in enumerate(h)])

    def masks(values):
        return np.bitwise_and.reduce([f.table[0][at] for at in language.probes(values.view(np.uint64))])

    assert all(m >> (i % 2) & 1 for i, m in enumerate(masks(h)))
    others = masks(rng.integers(-(1 << 63), (1 << 63) - 1, 50_000))
    for bit in (0, 1):
        assert abs((others >> bit & 1).mean() - f.false[bit]) < 0.002


def test_grams_stay_inside_texts():
    got = {}
    for n, h, owner in language.grams(["ab", None, "c", "éß 😀x"]):
        got[n] = np.bincount(owner, minlength=4).tolist()
    # " ab ": 3 of two, 2 of three, 1 of four characters
    assert got[2][0] == 3 and got[3][0] == 2 and got[4][0] == 1 and got[2][1] == 0 and got[2][2] == 2
    alone = [sorted(h.tolist()) for _, h, _ in language.grams(["ab"])]
    assert alone == [sorted(h[o == 1].tolist()) for _, h, o in language.grams(["xyz", "ab", "q"])]


def test_more_languages_than_a_word_has_bits(spark):
    table = [(10 * i + k, f"{' '.join(f'q{chr(97 + i % 26)}{chr(97 + i // 26)}x' for _ in range(6))}", f"l{i:03d}", "s") for i in range(150) for k in range(6)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    filters = language.fit(docs)
    assert len(filters.languages) == 150 and filters.table.shape[0] == 3
    truth = {i: x for i, _, x, _ in table}
    held = [r for r in language.predictions(docs, filters).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) == len(held) > 100
    assert len(language.fit(docs, most=70).languages) == 70


def test_predictions_equal_a_plain_count():
    """The filter's decision, recounted n-gram by n-gram over sets, without probes."""
    texts = [t for _, t, _ in rows(60)]
    owner = [list(WORDS).index(x) if x in WORDS else 0 for *_, x in rows(60)]
    known = [set() for _ in WORDS]
    for t, k in zip(texts, owner, strict=True):
        for _, h, _ in language.grams([t]):
            known[k].update(h.tolist())
    f = language.Filters.build(list(WORDS), [(k, int(np.uint64(v).astype(np.int64))) for k, own in enumerate(known) for v in own])
    names, scores = f.predict(texts)
    for t, name, score in zip(texts, names, scores, strict=True):
        own = [v for _, h, _ in language.grams([t]) for v in h.tolist()]
        found = [sum(v in k for v in own) for k in known]
        if not own:
            assert (name, score) == ("und", 0.0)
        elif sorted(found)[-1] - sorted(found)[-2] > 0.02 * len(own) + 1:
            assert name == list(WORDS)[found.index(max(found))] and abs(score - max(found) / sum(found)) < 0.05


def test_ties_and_unknown_letters():
    f = language.Filters.build(["b", "c"], [(k, int(v.astype(np.int64))) for k in (0, 1) for _, h, _ in language.grams(["same words"]) for v in h])
    assert f.predict(["same words", "ΩΩΩ", "1 2", None]) [0] == ["b", "b", "und", "und"] and f.predict(["ΩΩΩ"])[1][0] == 0.0
