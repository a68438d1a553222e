"""Trees from histograms against a brute-force search of every cut, over dense values in one process."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, DoubleType, StructField, StructType

from clausemill.operators import trees
from clausemill.operators import trees as T
from clausemill.plans import stored


def table(spark, seed=1, n=240, wide=7, k=3, parts=4):
    """Sparse and dense vectors, negative values, ties, weights, null codes; the label follows two features."""
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, wide)), 1) * (r.random((n, wide)) < 0.5)
    x[:, 3] = r.integers(0, 3, n)
    x[:, 4] = 0.0
    y = ((x[:, 0] > 0).astype(int) + (x[:, 3] > 1)) % k
    y = np.where(r.random(n) < 0.1, r.integers(0, k, n), y)
    w = r.choice([0.5, 1.0, 2.0], n)
    rows = [(Vectors.dense(v) if i % 3 else Vectors.sparse(wide, {j: a for j, a in enumerate(v) if a}), int(c), float(z)) for i, (v, c, z) in enumerate(zip(x, y, w, strict=True))]
    schema = StructType([StructField("features", VectorUDT()), StructField("y", IntegerType()), StructField("w", DoubleType())])
    return spark.createDataFrame([*rows, (rows[0][0], None, 1.0)], schema).repartition(parts), x, y, w


def plain_bins(bins, x):
    return np.stack([np.searchsorted(bins.edges[bins.first[f] : bins.first[f + 1]], x[:, f], "left") for f in range(x.shape[1])], 1)


def grow(b, g, h, depth, leaves, l2, least, few, rate):
    """One tree by trying every cut of every feature; (feature, bin, left, right, value, gain) by node."""
    nodes = [{"rows": np.ones(len(b), bool), "depth": 0}]
    waiting = []

    def look(i):
        own = nodes[i]["rows"]
        gt, ht = g[own].sum(), h[own].sum()
        nodes[i]["value"] = -rate * gt / (ht + l2)
        best = (0.0, 0, 0)
        for f in range(b.shape[1]):
            for t in np.unique(b[own, f]):
                left = own & (b[:, f] <= t)
                right = own & ~left
                if min(left.sum(), right.sum()) < few or min(h[left].sum(), h[right].sum()) < least:
                    continue
                gain = 0.5 * (g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2) - gt**2 / (ht + l2))
                if gain > best[0] * (1 + 1e-9) + 1e-9:
                    best = (gain, f, int(t))
        if best[0] > 0 and nodes[i]["depth"] < depth:
            waiting.append((i, best))

    look(0)
    count = 1
    while waiting:
        waiting.sort(key=lambda x: (-x[1][0], x[0]))
        chosen = list(waiting) if leaves is None else waiting[:1] if count < leaves else []
        if not chosen:
            break
        waiting = [x for x in waiting if x not in chosen]
        for i, (gain, f, t) in chosen:
            own = nodes[i]["rows"]
            left = own & (b[:, f] <= t)
            nodes[i] |= {"cut": (f, t), "children": (len(nodes), len(nodes) + 1), "gain": gain}
            nodes.extend({"rows": rows, "depth": nodes[i]["depth"] + 1} for rows in (left, own & ~left))
            count += 1
            look(nodes[i]["children"][0])
            look(nodes[i]["children"][1])
    return nodes


@pytest.mark.parametrize("leaves,l2,few", [(None, 0.5, 1), (6, 0.0, 5)])
def test_boosting_equals_brute_force(spark, leaves, l2, few):
    df, x, y, w = table(spark)
    data = T.binned(df, "features", "y", "w", bins=8)
    model = T.boost(data, rounds=4, depth=3, leaves=leaves, l2=l2, few=few)
    b = plain_bins(data.bins, x)
    score = np.tile(np.log(np.bincount(y, w) / w.sum()), (len(y), 1))
    for trees in model.trees:
        p = T.softmax(score)
        for c, tree in enumerate(trees):
            nodes = grow(b, w * (p[:, c] - (y == c)), 2 * w * p[:, c] * (1 - p[:, c]), 3, leaves, l2, 1e-3, few, 0.1)
            assert sorted((f, t) for f, t in zip(tree.feature, tree.bin, strict=True) if f >= 0) == sorted(n["cut"] for n in nodes if "cut" in n)
            assert np.isclose(sorted(g for g, f in zip(tree.gain, tree.feature, strict=True) if f >= 0), sorted(n["gain"] for n in nodes if "cut" in n)).all()
            for n in nodes:
                if "cut" not in n:
                    score[n["rows"], c] += n["value"]
    want = T.softmax(score)
    got = np.array([r.p for r in df.select("features", model.probabilities(F.col("features")).alias("p")).collect()])
    order = {tuple(r.features.toArray()): i for i, r in enumerate(df.select("features").collect())}
    assert np.allclose(got[[order[tuple(v)] for v in x]], want, atol=1e-9)
    assert (want.argmax(1) == y).mean() > 0.8


def test_fits_do_not_depend_on_partitions_or_on_when_scores_are_written(spark, monkeypatch):
    def cuts(parts):
        data = T.binned(table(spark, parts=parts)[0], "features", "y", "w", bins=8)
        both = T.boost(data, rounds=5, depth=3, row_share=0.8, feature_share=0.7), T.randomised(data, 5, depth=4, few=2)
        return [(t.feature, t.bin) for m in both for own in m.trees for t in own]

    one = cuts(1)
    monkeypatch.setattr(T, "WRITE_AFTER", 2)
    assert one == cuts(6) and any(f >= 0 for f, *_ in [x for x, _ in one])


def test_randomised_trees_follow_their_rules(spark):
    df, x, y, w = table(spark, seed=4)
    data = T.binned(df, "features", "y", "w", bins=8)
    model = T.randomised(data, 12, tried=2, few=3)
    b = plain_bins(data.bins, x)
    cuts = set()
    for (tree,) in model.trees:
        at = np.zeros(len(y), int)
        for i, f in enumerate(tree.feature):
            own = at == i
            sums = np.bincount(y[own], w[own], 3)
            assert own.sum() >= 3 and np.allclose(tree.value[i], sums / sums.sum())
            if f < 0:
                # a leaf is pure, or no feature tried leaves three rows on both sides
                assert (sums > 0).sum() == 1 or own.sum() < 60
                continue
            assert b[own, f].min() <= tree.bin[i] < b[own, f].max() and (sums > 0).sum() > 1
            cuts.add((f, tree.bin[i]))
            left = own & (b[:, f] <= tree.bin[i])
            at[left], at[own & ~left] = tree.left[i], tree.right[i]
    assert len({f for f, _ in cuts}) >= 4 and 4 not in {f for f, _ in cuts}  # feature 4 is constant
    p = np.array([r.p for r in df.where("y IS NOT NULL").select("y", model.probabilities(F.col("features")).alias("p")).collect()])
    assert np.allclose(p.sum(1), 1)


def test_one_class_no_rows_and_round_trip(spark, tmp_path):
    df, *_ = table(spark, n=30)
    for rows in (df.where("y = 0"), df.limit(0)):
        data = T.binned(rows, "features", "y")
        for model in (T.boost(data, 3), T.randomised(data, 2)):
            assert {len(r.p) for r in df.select(model.probabilities(F.col("features")).alias("p")).collect()} == {1}
    model = T.boost(T.binned(df, "features", "y"), 2, depth=2)
    model.save(spark, f"file://{tmp_path}/m")
    again = T.Model.load(spark, f"file://{tmp_path}/m")
    both = df.select(model.probabilities(F.col("features")).alias("a"), again.probabilities(F.col("features")).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] and abs(model.importance().sum() - 1) < 1e-9


def test_small_tables_grow_within_tasks_as_large_ones_do(spark, monkeypatch):
    """Every level, or leaf, was a job, and a query's members were cut to few small trees for it (F10)."""
    r = np.random.default_rng(11)
    x = r.normal(size=(300, 6)).round(2)
    rows = [(Vectors.dense(v), int(v[0] + v[1] > 0) + int(v[2] > 1)) for v in x.tolist()]
    table = spark.createDataFrame(rows, ["features", "y"])
    found = []
    for most in (trees.WITHIN, 0):
        monkeypatch.setattr(trees, "WITHIN", most)
        data = trees.binned(table, "features", "y")
        jobs = []
        search = trees._search
        monkeypatch.setattr(trees, "_search", lambda *a: jobs.append(1) or search(*a))
        found.append([trees.boost(data, 3, depth=4, l2=0.5, row_share=0.9, feature_share=0.8), trees.boost(data, 3, leaves=6, few=5), trees.randomised(data, 12, few=2)])
        monkeypatch.setattr(trees, "_search", search)
        assert (len(jobs) == 0) == (most > 0)
    for a, b in zip(*found, strict=True):
        assert [[t.feature for t in own] for own in a.trees] == [[t.feature for t in own] for own in b.trees]
        assert all(np.allclose(u or [0], v or [0]) for p, q in zip(a.trees, b.trees, strict=True) for s, t in zip(p, q, strict=True) for u, v in zip(s.value, t.value, strict=True))


def test_the_ensemble_query_fits_at_full_size(spark, monkeypatch, tmp_path):
    told = {}
    monkeypatch.setattr(stored.ml, "fit", lambda rows, text, **how: told.update(how) or (_ for _ in ()).throw(InterruptedError))
    monkeypatch.setattr(stored.sample, "balance", lambda *a, **how: told.update(given=a[4:], **how))
    with pytest.raises(InterruptedError):
        stored._ensemble(spark, "/root/testdata/sf0.001")
    assert told == {"given": ()}
