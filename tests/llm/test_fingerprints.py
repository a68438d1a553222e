"""Fingerprints against plain shingle sets."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from clausemill.llm import fingerprints as P


def plain(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def rows():
    r = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    out = [(5, None), (6, ""), (7, "one two"), (8, "one two"), (9, " \n"), (11, "ä ö ü " * 2000), (2**61, "far off"), (-4, "negative id")]
    for i in range(60):
        words = r.choices(base, k=r.choice([3, 30, 90, 400]))
        out.append((100 + 7 * i, " ".join(words)))
    return out + [(200, out[12][1])]


@pytest.mark.parametrize("target", [256, 1])
def test_followers(spark, target):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows()], "doc_id long, text string, bucket int").repartition(5)
    got = {(r.doc_id, r.text): r.next_text for r in P.followers(docs, target=target).collect()}
    order = sorted(((i, t or "") for i, t in rows()), key=lambda x: (-x[0], x[1]))
    assert got == {x: order[(k + 1) % len(order)][1] for k, x in enumerate(order)}


def test_edited(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in P.edited(docs).collect()}
    order = sorted(((i, t or "") for i, t in rows() if i != 200), key=lambda x: -x[0])
    order = order[: [i for i, _ in order].index(198) if (198 in got) else len(order)]
    for k, (i, text) in enumerate(order[:-1]):
        follow = order[k + 1][1]
        third = len(text) // 3
        edit = text[: len(text) - third] + follow[:third]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert abs(r.near_edited - similarity(plain(text), plain(edit))) < 0.2
        assert abs(r.near_next - similarity(plain(text), plain(follow))) < 0.2
    assert got[7].fingerprint == got[8].fingerprint and len(got[7].fingerprint) == 12 and got[5].fingerprint == ""
    assert P.edited(docs.limit(0)).collect() == []
    alone = P.edited(docs.where("doc_id = 7")).collect()[0]
    assert alone.near_next == 1.0


def test_estimates_and_merging(spark):
    words = [f"x{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[500:])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    r = df.select(P.resemblance(F.col("a"), F.col("b")).alias("r"), P.containment(F.col("a"), F.col("b")).alias("c"), P.distinct_shingles(F.col("a")).alias("n"), P.distinct_shingles(P.merge(F.col("a"), F.col("b"))).alias("u"), P.distinct_shingles(F.slice("a", 1, 9)).alias("few")).first()
    assert abs(r.r - 0.5) < 0.15 and abs(r.c - 0.75) < 0.2 and abs(r.n / 1996 - 1) < 0.3 and abs(r.u / 2996 - 1) < 0.3 and r.few == 9
    parts = spark.createDataFrame([(" ".join(words[:1000]), " ".join(words[996:2000]), a)], "p string, q string, whole string")
    merged, whole = parts.select(P.merge(P.sketch(F.col("p")), P.sketch(F.col("q"))), P.sketch(F.col("whole"))).first()
    assert merged == whole
