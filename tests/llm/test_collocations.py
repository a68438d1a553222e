"""Operator 11: phrases, cuts, scores and subsumption against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clausemill.llm import collocations as c

SCHEMA = "lang string, text string"


def plain(rows, least=10, most_words=3, share=50, first=2000):
    counts, out = {}, {}
    for lang, text in rows:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, most_words + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first], 1):
            out[lang, i] = (phrase.decode(), -a, left, right, n, -score)
    return out


def answer(docs, **how):
    got = c.collocations(docs, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for x, t in got.dtypes if x not in ("lang", "phrase")} == {"bigint"}
    return {(r.lang, r["rank"]): tuple(r)[2:] for r in got.collect()}


def rows(n, seed):
    some = random.Random(seed)
    words = ["a", "B", "c", "dé", "É", "e f", "g\x00", "x.y", "the", "The", "of", "\U0001f600"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\x0b", " \x1f ", "!"]
    return [(some.choice(["en", "en", "de", None, ""]), "".join(some.choice(words) + some.choices(ends, [30, 2, 2, 1, 1, 1, 1, 1, 1])[0] for _ in range(some.randrange(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"least": 3, "most_words": 4, "share": 30, "first": 50}, {"least": 2, "most_words": 2}, {"least": 1, "most_words": 5, "first": 300}])
def test_equals_plain_python(spark, how):
    own = rows(300 if how.get("least", 9) > 1 else 40, len(how)) + [("en", None), (None, None), ("fr", ""), ("fr", " . \t")] + [("it", "uno due tre. quattro")] * 12
    docs = spark.createDataFrame(own, SCHEMA).repartition(5)
    assert answer(docs, **how) == plain(own, **how)


def test_whole_table_equals_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    got = answer(docs)
    assert got == plain(map(tuple, docs.collect())) and len(got) > 100


def test_very_long_texts_hot_pairs_and_many_parts(spark, monkeypatch):
    """A text beyond a slice, without separators or without spaces; a part for nearly every text; one pair in a third of all words."""
    monkeypatch.setattr(c, "BUCKET", 50)
    some = random.Random(4)
    own = [("en", " ".join(some.choices(["hot pair", "cold", "mild", "warm"], [5, 1, 1, 1], k=300_000))), ("en", ",".join(some.choices("abc", k=400_000)) + " end"), ("de", "x" * 2_500_000)] + [("de", "hot pair")] * 50
    assert answer(spark.createDataFrame(own, SCHEMA)) == plain(own)


def test_empty_table_and_clashing_columns(spark):
    assert answer(spark.createDataFrame([], SCHEMA)) == {}
    docs = spark.createDataFrame([("en", "one two, three")] * 20, SCHEMA)
    for name in ("word", "part", "number", "times", "n", "id", "a", "b", "rank"):
        docs = docs.withColumn(name, F.lit("mine"))
    assert answer(docs) == {("en", 1): ("one two", 20, 20, 20, 60, 1_000_000)}


def test_scores_are_exact_beyond_64_bits(spark):
    some = random.Random(6)
    cases = [(10**15 - 1,) * 3, (1, 10**15 - 1, 10**15 - 1)]
    for _ in range(200):
        a = some.randrange(1, 10 ** some.randrange(1, 15))
        cases.append((a, a + some.randrange(10 ** some.randrange(1, 14)), a + some.randrange(10 ** some.randrange(1, 14))))
    got = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", c._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [1_000_000 * r.a * r.a // (r.l * r.r) for r in got]
