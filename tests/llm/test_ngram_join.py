"""The similarity join against all pairs, and its parts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from clausemill.llm import components as graph
from clausemill.llm import ngram_join as N
from clausemill.llm.components import components


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_classes(rows):
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(vocabulary, k=60))
    texts = [None, "", " \n", "One two", "one TWO", "one two three four", "ÉCOLE a b c d", "école a b c d"]
    for _ in range(12):
        words = r.choices(vocabulary, k=r.choice([6, 40, 120, 300]))
        for _ in range(9):  # a chain of edits: near neighbours link, the ends need not
            texts.append(" ".join(words))
            words = list(words)
            words[r.randrange(len(words))] = r.choice(vocabulary)
    texts += [passage + " " + " ".join(r.choices(vocabulary, k=50)) for _ in range(30)]
    texts += [texts[20]] * 15 + [" ".join(vocabulary * 30)]
    return list(enumerate(texts))


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, component_id string").repartition(6)


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = table(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.classes(docs).collect()}
    assert got == plain_classes(rows)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_groups_dealt_in_blocks_lose_no_link(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(N, "BLOCK", 6)
    monkeypatch.setattr(N, "SEEDS", 2)
    monkeypatch.setattr(N, "WEIGHT", 700)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in N.classes(table(spark, rows)).collect()} == plain_classes(rows)


def test_one_group_of_thousands_of_near_copies(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(3000)}" for _ in range(120)]
    rows = []
    for i in range(5000):
        own = list(words)
        for k in range((0, 1, 2, 10)[i % 4]):
            own[r.randrange(12) + 12 * k % 108] = f"x{i}"
        rows.append((i + 10, " ".join(own)))
    sets = {i: plain_set(t) for i, t in rows}
    alike = {i: len(sets[i] & sets[10]) / len(sets[i] | sets[10]) for i in sets}
    # what is further than 0.3 from the original cannot link with its copies, and shares too little with its like
    assert all(x >= 0.85 or x < 0.7 for x in alike.values()) and sum(x < 0.7 for x in alike.values()) == 1250
    got = {x.doc_id: x.component_id for x in N.classes(table(spark, rows)).collect()}
    assert got == {i: 10 if alike[i] >= 0.85 else i for i in sets}


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert N.classes(spark.createDataFrame([], schema)).collect() == []
    assert N.keep_one(spark.createDataFrame([], schema)).collect() == []
    rows = N.classes(spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (4, None)], schema)).collect()
    assert sorted(tuple(r)[1:] for r in rows) == [(0, 4), (2, 3), (2, 3), (2, 3)]


def test_keep_one_with_shared_and_missing_ids(spark):
    rows = [(3, "a b c d e", 1), (3, "a b c d e", 2), (None, "a b c d e", 3), (5, "p q r s t", 4), (7, "P q r s t", 5), (None, "k l m n o", 6), (None, "k l m n o", 7), (4, None, 8), (4, None, 9), (None, "", 10)]
    rows += [(8, "p q r s t", 11), (8, "other words here in full", 12)]  # one id, two texts
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string, set int").repartition(4)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == sorted([(False, 3, "a b c d e"), (False, 5, "p q r s t"), (True, 0, "k l m n o"), (False, 4, ""), (False, 4, ""), (True, 0, ""), (False, 8, "other words here in full")])


def test_prefixes_of_linking_sets_meet():
    r, hot = np.random.default_rng(1), np.random.default_rng(2).integers(0, 256, 1 << N.HOT_BITS - 3).astype(np.uint8)
    for _ in range(300):
        n = int(r.integers(1, 80)) if r.random() < 0.9 else int(r.integers(500, 5000))
        s = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        t = np.unique(np.concatenate((s[int(r.integers(0, 1 + len(s) // 8)) :], r.integers(0, 1 << 63, int(r.integers(0, 1 + n // 9))).astype(np.uint64))))
        both, total = len(np.intersect1d(s, t)), len(np.union1d(s, t))
        if len(s) and len(t) and 100 * both >= 85 * total:
            p, q = N.prefix(s, hot), N.prefix(t, hot)
            i, j = next((i, list(q).index(x)) for i, x in enumerate(p) if x in q)  # the first in the common order
            for a, place, b in ((s, i, t), (t, j, s)):
                most = N.largest(len(a), place + 1)
                assert most[place] >= len(b) and (N.unpacked(N.packed(most, len(a)), np.full(place + 1, len(a))) >= most).all()
            x, y = N.open_ended(N.vector(s)), N.open_ended(N.vector(t))
            width = min(len(x), len(y))
            assert np.minimum(N.folded(x, width), N.folded(y, width)).sum() >= both >= N.need(len(s), len(t))


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(x) for x in range(n)]


def clusters(seed):
    """Sets in clusters of near copies and near misses, small and large."""
    r = np.random.default_rng(seed)
    sets = []
    for _ in range(14):
        base = r.integers(0, 1 << 63, int(r.choice([3, 40, 90, 700, 2500]))).astype(np.uint64)
        for _ in range(int(r.integers(1, 40))):
            own = base.copy()
            own[r.random(len(own)) < r.choice([0.02, 0.07, 0.1, 0.15])] = np.uint64(r.integers(0, 1 << 62))
            sets.append(np.unique(own))
    return sets


def test_tree_joins_all_pairs_that_link():
    for seed in range(3):
        sets = clusters(seed)
        n = len(sets)
        sizes = np.array([len(s) for s in sets])
        fine = [N.open_ended(v) if len(v := N.vector(s)) > N.GROUPS else None for s in sets]
        vectors = np.stack([N.folded(N.open_ended(N.vector(s)), N.GROUPS) for s in sets])
        grid = [(i, j) for i in range(n) for j in range(i)]
        linked = [(i, j) for i, j in grid if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        order = np.arange(n)
        assert roots(n, N.spanning(vectors, sizes, order, sets, fine)) == roots(n, linked) and linked
        i, j = np.array(grid).T
        passed = list(zip(*(x.tolist() for x in N.passing(vectors, sizes, order, i, j, fine)), strict=True))
        assert set(linked) <= set(passed)
        assert roots(n, N.spanning(vectors, sizes, order, None, fine)) == roots(n, passed)
        u, v = N._small_spans(np.zeros(n, np.int64), vectors, sizes, order, fine)
        assert roots(n, zip(u.tolist(), v.tolist(), strict=True)) == roots(n, passed)
        both = N.overlaps(sets[:30], sets[20:60], width=100)
        assert all(both[a, b] == N.overlap(sets[a], sets[20 + b]) == len(np.intersect1d(sets[a], sets[20 + b])) for a in range(30) for b in range(40))


def test_deals_are_joined_over_batches():
    sets = clusters(7)
    deal = np.sort(np.random.default_rng(1).integers(0, 9, len(sets)))
    columns = [pa.array(deal), pa.array(np.arange(len(sets))), pa.array([len(s) for s in sets], pa.int32()), pa.array(np.arange(len(sets))), pa.array([N.vector(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["deal", "node", "n", "label", "vector", "shingles"])
    want = [(i, j) for i in range(len(sets)) for j in range(i) if deal[i] == deal[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    for step in (1, 7, 1000):
        found = [pair for out in N._spans(iter([batch.slice(at, step) for at in range(0, len(sets), step)]), True) for pair in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
        assert roots(len(sets), found) == roots(len(sets), want) and len(found) < len(sets)


def test_key_groups_pass_large_keys_on_in_pieces(monkeypatch):
    r = np.random.default_rng(5)

    def entries(marked):
        e = np.zeros(900, N._ENTRY)
        e["key"], e["n"], e["most"] = r.integers(0, 40, 900), r.choice([100, 90, 40], 900), 65535
        e["key"][:300] = 7
        e["lo"] = r.integers(0, 60, 900) * 400 + e["n"]
        e["n"][marked & (e["key"] == 7)] |= N._LARGE
        return e

    for held, marked in ((N.HELD, False), (200, False), (N.HELD, True)):
        monkeypatch.setattr(N, "HELD", held)
        e = entries(marked)
        blobs = pa.RecordBatch.from_arrays([pa.array([3] * 9), pa.array([e[a : a + 100].tobytes() for a in range(0, 900, 100)], pa.binary())], ["part", "entries"])
        met = {}
        for out in N._key_groups(iter([blobs])):
            for grp, members in zip(out.column("grp").to_pylist(), out.column("members").to_pylist(), strict=True):
                met.setdefault(grp, set()).update(members)
        for key in range(40):
            own = {(int(x["lo"]).to_bytes(N.NAME, "little"), int(x["n"]) & 0x7FFFFFFF) for x in e if x["key"] == key}
            for a, n in own:
                for b, m in own:
                    if a != b and 100 * min(n, m) >= 85 * max(n, m):
                        assert any(a in s and b in s for s in met.values())


@pytest.mark.parametrize("part", [200_000, 60])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART", part)  # one partition, or several and rounds over them
    r = random.Random(9)
    edges = [(i + 1, i) for i in range(300)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(150)] + [(5000, 5000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    want = {x: find(x) for x in root}
    want = {x: c for x, c in want.items() if x != 5000 and (x != c or list(want.values()).count(c) > 1)}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
