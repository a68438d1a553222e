"""Near-duplicate sets by keys of parts, stars and one greedy pass, against plain models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.operators import clean, near
from clausemill.operators.components import components


def greedy(rows, num=17, den=20):
    """Orders of the rows (domain, order, tokens) that stay; a set seen before always goes."""
    kept = []
    for d, i, t in sorted(rows, key=lambda r: r[1]):
        s = frozenset(t)
        if not any(e == d and den * len(s & u) >= num * len(s | u) for e, _, u in kept):
            kept.append((d, i, s))
    return {i for _, i, _ in kept}


def families(seed, n, words, sizes=(1, 3, 6, 7, 12, 20, 33, 60)):
    """Sets of all sizes, each drifting from the one before, so that chains arise; two domains and null."""
    r = random.Random(seed)
    rows, base = [], []
    for i in range(n):
        if i % 11 == 0:
            base = r.sample(words, min(len(words), r.choice(sizes)))
        base = list(base)
        for _ in range(r.randrange(3)):
            base[r.randrange(len(base))] = r.choice(words)
        if r.random() < 0.3:
            base = base[: max(1, len(base) - r.randrange(3))] + r.sample(words, r.randrange(3))
        rows.append((r.choice(["a", "a", "b", None]), i, base))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,size", [(1, 90), (2, 4000), (3, 300)])
def test_similar_sets_share_a_key(seed, size):
    """No similar pair is missed, at several thresholds; keys come from hashes as given."""
    words = [f"w{i}" for i in range(size)]
    rows = [set(t) for _, _, t in families(seed, 260, words)]
    hashes = {w: h for w, h in zip(words, np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, len(words)), strict=True)}
    flat = np.array([hashes[w] for t in rows for w in t], np.int64)
    for num, den in ((17, 20), (1, 2), (19, 20), (1, 1)):
        places, keys = near.set_keys(flat, np.array([len(t) for t in rows]), np.zeros(len(rows), np.int64), num, den)
        own = [set() for _ in rows]
        for p, k in zip(places.tolist(), keys.tolist(), strict=True):
            own[p].add(k)
        for i, a in enumerate(rows):
            for j, b in enumerate(rows[:i]):
                if den * len(a & b) >= num * len(a | b):
                    assert own[i] & own[j], (num, den, len(a), len(b))


@pytest.mark.parametrize("seed,size", [(5, 40), (6, 90), (7, 2000)])
def test_greedy_equals_plain(spark, seed, size):
    rows = families(seed, 700, [f"w{i}" for i in range(size)])
    df = spark.createDataFrame([(d, i, " ".join(t)) for d, i, t in rows], "domain string, pos long, text string").repartition(5)
    got = clean.drop_near_duplicates(df, "domain", "pos", "text")
    assert {r.pos for r in got.collect()} == greedy(rows)
    looser = clean.drop_near_duplicates(df, "domain", "pos", "text", 1, 2)
    assert {r.pos for r in looser.collect()} == greedy(rows, 1, 2)


def test_pairs_equal_all_pairs(spark):
    rows = families(8, 400, [f"w{i}" for i in range(120)])
    df = spark.createDataFrame([(d, i, " ".join(t)) for d, i, t in rows], "domain string, pos long, text string")
    first = {}
    for d, i, t in sorted(rows, key=lambda r: r[1]):
        first.setdefault((d, frozenset(t)), i)
    sets = [(d, i, s) for (d, s), i in first.items()]
    want = {(d, min(i, j), max(i, j), len(s & u), len(s | u)) for d, i, s in sets for e, j, u in sets if i < j and d == e and 20 * len(s & u) >= 17 * len(s | u)}
    assert {tuple(r) for r in clean.similar_pairs(df, "domain", "pos", "text").collect()} == want and want


def near_copies(n):
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    return [("a", i, r.sample(base, 60 - r.randrange(3)) + [f"x{i}", f"y{i}"][: r.randrange(3)]) for i in range(n)]


@pytest.mark.parametrize("large", [20_000, 100])
def test_a_group_of_5000_near_copies_takes_linear_rows(spark, monkeypatch, large):
    """Stars have at most one row a set and key; survivors equal the plain model, whether or not the first set's likes go beforehand."""
    monkeypatch.setattr(near, "LARGE", large)
    rows = near_copies(5_000) + [("a", 10_000 + i, [f"z{i}", f"z{i + 1}"]) for i in range(50)]
    df = spark.createDataFrame([(d, i, " ".join(t)) for d, i, t in rows], "domain string, pos long, text string")
    assert {r.pos for r in clean.drop_near_duplicates(df, "domain", "pos", "text").collect()} == greedy(rows)
    if large == 100:
        sets = clean.token_sets(df, "domain", "pos", "text")
        keys = near.keyed(sets, 17, 20)
        assert near.stars(keys).count() <= keys.count() < 60 * sets.count()


def test_empty_and_bare_rows(spark):
    none = spark.createDataFrame([], "domain string, pos long, text string")
    assert clean.drop_near_duplicates(none, "domain", "pos", "text").count() == clean.similar_pairs(none, "domain", "pos", "text").count() == 0
    bare = spark.createDataFrame([("a", 1, None), ("a", 2, " -- "), (None, 3, "one"), (None, 4, "ONE.")], "domain string, pos long, text string")
    assert sorted(r.pos for r in clean.drop_near_duplicates(bare, "domain", "pos", "text").collect()) == [1, 2, 3]


def test_components_of_long_chains_and_a_star(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.range(2_000).select(F.lit(1_000).alias("u"), (F.col("id") + 1_001).alias("v")))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1_000 for i in range(1_000, 3_001)}


def test_a_phrase_that_all_sets_share_ties_none_of_them(spark):
    """Sets of a common phrase and words of their own had keys of parts of the phrase, and all were one component; similar ones still meet."""
    rows = [(i, "d", [*(f"common{k}" for k in range(14)), *(f"own{i}x{k}" for k in range(6))]) for i in range(400)]
    rows += [(400 + i, "d", [*rows[i][2], f"more{i}"]) for i in range(40)]
    sets = spark.createDataFrame([(i, d, i, t) for i, d, t in rows], "node long, domain string, order long, tokens array<string>")
    assert near.stars(near.keyed(sets, 17, 20, near.bucket_counts(sets))).select("v").distinct().count() == 40
    for rare in (True, False):
        assert sorted(r.order for r in near.dropped(sets, 17, 20, rare).collect()) == list(range(400, 440))
    assert sorted((r.i, r.j) for r in near.pairs(sets, 17, 20).collect()) == [(i, 400 + i) for i in range(40)]


def chance(n):
    """Sets of frequent and rare words, with equal parts by chance and copies of a few."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(1_500)]
    weights = [1 / (i + 1) for i in range(1_500)]
    rows = [("a", i, sorted(set(r.choices(words, weights, k=250)))) for i in range(n)]
    return rows + [("a", n + i, [*rows[i][2], "more"]) for i in range(30)]


def test_sets_with_equal_parts_by_chance_are_not_tied(spark):
    """Such sets were one component, in one task; ties are now the similar pairs alone."""
    rows = chance(1_500)
    sets = spark.createDataFrame([(i, d, i, t) for d, i, t in rows], "node long, domain string, order long, tokens array<string>")
    keys = near.keyed(sets, 17, 20, None, near.bucket_counts(sets))
    assert sorted((r.u, r.v) for r in near.ties(keys, sets, 17, 20).collect()) == [(i, 1_500 + i) for i in range(30)]
    assert near.stars(keys).count() > 1_000
    assert sorted(r.order for r in near.dropped(sets, 17, 20).collect()) == list(range(1_500, 1_530))


@pytest.mark.parametrize("few,block", [(0, 2), (4, 3), (1_000, 1_000)])
def test_ties_and_blocks_of_any_size(spark, monkeypatch, few, block):
    """Pairs by blocks of large keys, and survivors by stars alone, by pairs alone and by both, equal the plain models."""
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "BLOCK", block)
    rows = families(11, 300, [f"w{i}" for i in range(60)]) + [(d, 1_000 + i, t) for d, i, t in near_copies(60)]
    df = spark.createDataFrame([(d, i, " ".join(t)) for d, i, t in rows], "domain string, pos long, text string")
    first = {}
    for d, i, t in sorted(rows, key=lambda r: r[1]):
        first.setdefault((d, frozenset(t)), i)
    want = {(d, i, j) for (d, s), i in first.items() for (e, u), j in first.items() if i < j and d == e and 20 * len(s & u) >= 17 * len(s | u)}
    assert {(r.domain, r.i, r.j) for r in clean.similar_pairs(df, "domain", "pos", "text").collect()} == want
    assert {r.pos for r in clean.drop_near_duplicates(df, "domain", "pos", "text").collect()} == greedy(rows)


def test_sets_that_share_frequent_tokens_by_chance_are_not_tied(spark):
    """Each token was a key, so of short texts of few words nearly all hung together in one component, which one task settles (F1, F2)."""
    r = random.Random(3)
    rows = [(i, ("d",), i, sorted(r.sample([f"w{k}" for k in range(150)], 24))) for i in range(600)]
    rows += [(600 + i, ("d",), 600 + i, sorted([*rows[i][3][:23], "else"])) for i in range(20)]
    sets = spark.createDataFrame(rows, "node long, domain struct<domain:string>, order long, tokens array<string>")
    counts = near.bucket_counts(sets)
    tied = {(x.u, x.v) for x in near.ties(near.keyed(sets, 17, 20, counts), sets, 17, 20, near.FEW_RARE).collect()}
    assert tied == {(i, 600 + i) for i in range(20)}
    assert sorted(x.order for x in near.dropped(sets, 17, 20, True).collect()) == list(range(600, 620))


def test_similar_sets_share_a_key_of_rare_tokens():
    """Of one, two and three tokens, with all similar pairs of sets by brute force."""
    r = random.Random(5)
    for words in (30, 60, 300):
        sets = set()
        for _ in range(100):
            own = set(r.sample(range(words), r.randint(1, 28)))
            for _ in range(5):
                sets.add(tuple(sorted(own)))
                own = own ^ set(r.sample(range(words), r.randint(1, 3))) or own
        sets = sorted(sets)
        hashes, sizes = np.array([x * 7919 for s in sets for x in s], np.int64), np.array([len(s) for s in sets])
        counts = np.bincount((near._mixed(hashes.view(np.uint64)) % np.uint64(near.BUCKETS)).astype(np.int64), minlength=near.BUCKETS)
        keys = [set() for _ in sets]
        for place, key in zip(*(x.tolist() for x in near.rare_keys(hashes, sizes, np.zeros(len(sets), np.int64), counts, 17, 20)), strict=True):
            keys[place].add(key)
        similar = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 20 * len(o := set(a) & set(b)) >= 17 * (len(a) + len(b) - len(o))]
        assert len(similar) > 50 and all(keys[i] & keys[j] for i, j in similar)
