"""Boosted and randomised trees over histograms that executors add up.

Values become bins once, by quantiles of each feature.  Rows are packed into blocks, each a sparse
matrix of bins by feature.  To split nodes, every task adds up its blocks' sums by (node, feature,
bin), one task a node merges them and looks for the best cut, and the driver gets one row a node;
histograms have at most features times bins cells, whatever the number of rows.  Of a table of up to
``WITHIN`` rows, as balanced classes give, a task grows all trees of a member by the same code, and
randomised trees are grown by several tasks.

``boost`` fits multiclass trees on gradients and second derivatives of the log loss, with an L2
weight on leaves, by level up to a depth or leaf by leaf, the best first, up to a number of leaves.
``randomised`` fits trees on all rows whose cuts are drawn: of each node, ``tried`` features that
differ in it are drawn, of each a cut between its least and its greatest bin, and the cut with the
greatest decrease of impurity is taken.  Draws, and shares of rows and features, are by hash, so a
fit does not depend on the partitions, but for the order in which sums are added.

Rows without a label code are left out; null weights count 1.  No rows, or one class, give trees of
one leaf.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.plans.stages import cut

#: Rows of a block, rounds after which the scores are written, trees of a group that grow together.
ROWS, WRITE_AFTER, TOGETHER = 4_096, 25, 8
#: Rows up to which trees grow within a task; tasks of randomised trees then.
WITHIN, TASKS = 16_384, 8


def drawn(*parts) -> np.ndarray:
    """Numbers in [0, 1) from integers, which broadcast."""
    x = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x ^ np.asarray(p).astype(np.int64).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(32))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


@dataclass
class Tree:
    """Nodes by number: feature (-1 at a leaf), the last bin that goes left, children, values of the outputs, gain of the cut."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[list[float]] = field(default_factory=lambda: [[]])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, bin_: int, gain: float) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.bin[node], self.gain[node], self.left[node], self.right[node] = feature, bin_, gain, a, a + 1
        for _ in range(2):
            for part, x in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, []), (self.gain, 0.0), (self.depth, self.depth[node] + 1)):
                part.append(x)
        return a, a + 1


class Block:
    """Some rows: label codes, weights, ids, and bins by feature where they differ from the bin of zero."""

    def __init__(self, y, w, ids, features, rows, bins, zero):
        order = np.lexsort((bins, features))
        self.y, self.w, self.ids, self.zero, self.n = y, w, ids, zero, len(y)
        self.features, self.rows, self.bins = (x[order].astype(np.int32) for x in (features, rows, bins))

    def column(self, feature: int) -> np.ndarray:
        a, b = np.searchsorted(self.features, [feature, feature + 1])
        out = np.full(self.n, self.zero[feature], np.int64)
        out[self.rows[a:b]] = self.bins[a:b]
        return out

    def nodes(self, tree: Tree) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(self.n, np.int64)
        held = {0: np.arange(self.n)}
        for i, f in enumerate(tree.feature):  # children have greater numbers
            own = held.pop(i, None)
            if f >= 0 and own is not None and len(own):
                left = self.column(f)[own] <= tree.bin[i]
                for child, rows in ((tree.left[i], own[left]), (tree.right[i], own[~left])):
                    at[rows], held[child] = child, rows
        return at

    def scores(self, trees: list[list[Tree]], k: int) -> np.ndarray:
        out = np.zeros((self.n, k))
        for own in trees:
            for c, tree in enumerate(own):
                out[:, c] += np.array([v[0] if v else 0.0 for v in tree.value])[self.nodes(tree)]
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass(frozen=True)
class Bins:
    """The edges of each feature's bins, and the bin of zero; a value is in the bin of the first edge that it does not exceed."""

    first: np.ndarray
    edges: np.ndarray
    zero: np.ndarray

    def of(self, features: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(features), np.int64)
        order = np.argsort(features, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(features[order])) + 1) if len(order) else ():
            f = features[own[0]]
            out[own] = np.searchsorted(self.edges[self.first[f] : self.first[f + 1]], values[own], "left")
        return out

    def equals(self, other: Bins) -> bool:
        return all(np.array_equal(getattr(self, x), getattr(other, x)) for x in ("first", "edges", "zero"))


@dataclass
class Binned:
    """Blocks (as pickled rows, with scores) of a table, for fitting."""

    blocks: DataFrame
    bins: Bins
    classes: int
    sums: np.ndarray  # weights of the classes
    n: int = WITHIN + 1  # rows
    held: list | None = None  # the blocks and their scores, within a task


def _parts(features: Column) -> tuple[Column, Column]:
    """Indices and values of a vector column."""
    v = F.unwrap_udt(features)
    return F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1)), v["values"]


def find_bins(rows: DataFrame, features: str, bins: int, size: int) -> Bins:
    """Edges at quantiles of each feature's values other than zero, and at zero; aggregated by feature."""
    indices, values = _parts(F.col(features))
    pairs = rows.select(F.explode(F.arrays_zip(indices.alias("f"), values.alias("v"))).alias("x")).select("x.f", "x.v").where("v <> 0")
    shares = F.array(*(F.lit(i / max(1, bins - 2)) for i in range(max(1, bins - 1))))
    held = {r.f: r.q for r in pairs.groupBy("f").agg(F.percentile_approx("v", shares, F.lit(10_000)).alias("q")).collect()}
    edges = [np.unique([0.0, *held.get(f, [])])[:-1] if f in held and max(held[f]) > 0 else np.unique([0.0, *held.get(f, [])]) for f in range(size)]
    edges = [e if len(e) else np.zeros(1) for e in edges]
    return Bins(np.concatenate([[0], np.cumsum([len(e) for e in edges])]), np.concatenate(edges), np.array([int(np.searchsorted(e, 0.0, "left")) for e in edges]))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def block(n: int, f: np.ndarray, v: np.ndarray, rows: np.ndarray, bins: Bins, y=None, w=None, ids=None) -> Block:
    """``n`` rows, of whose features ``f`` have the values ``v`` in ``rows``, others zero; without labels for predictions."""
    known = f < len(bins.zero)  # a longer vector than those of the fit
    f, v, rows = f[known], v[known], rows[known]
    b = bins.of(f, v)
    some = b != bins.zero[f]
    return Block(np.zeros(n, np.int64) if y is None else y, np.ones(n) if w is None else w, np.arange(n) if ids is None else ids, f[some], rows[some], b[some], bins.zero)


def _block(batch: pa.RecordBatch, bins: Bins) -> Block:
    f, size = _lists(batch.column("f"))
    v, _ = _lists(batch.column("v"))
    rows = np.repeat(np.arange(batch.num_rows), size)
    y = batch.column("y").to_numpy().astype(np.int64) if "y" in batch.schema.names else np.zeros(batch.num_rows, np.int64)
    w = batch.column("w").to_numpy() if "w" in batch.schema.names else np.ones(batch.num_rows)
    ids = batch.column("id").to_numpy() if "id" in batch.schema.names else np.arange(batch.num_rows)
    return block(batch.num_rows, f.astype(np.int64), v, rows, bins, y, w, ids)


def binned(rows: DataFrame, features: str, code: str, weight: str | None = None, bins: int = 64) -> Binned:
    """The table for fitting: bins, then blocks in the shared folder. Rows are told apart by a hash of their features and code."""
    own = rows.where(F.col(code).isNotNull())
    indices, values = _parts(F.col(features))
    size = own.select(F.max(F.coalesce(F.unwrap_udt(F.col(features))["size"], F.size(values))).alias("n")).first().n or 1
    found = find_bins(own, features, bins, size)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    flat = own.select(F.col(code).cast("int").alias("y"), w.alias("w"), indices.alias("f"), values.alias("v")).withColumn("id", F.xxhash64("f", "v", "y"))

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                block = _block(batch.slice(at, ROWS), found)
                yield pa.RecordBatch.from_pylist([{"data": pickle.dumps((block, None), 5)}])

    blocks = cut(flat.mapInArrow(pack, "data binary"), "blocks").persist()
    counts = flat.groupBy("y").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    sums = {r.y: r.s for r in counts}
    return Binned(blocks, found, 1 + max(sums, default=0), np.array([sums.get(c, 0.0) for c in range(1 + max(sums, default=0))]), sum(r.n for r in counts))


def _within(data: Binned, grow, parts: list) -> list[Model]:
    """``grow(data, part)`` of all parts, each within a task that holds the blocks."""
    bins, k, sums, n = data.bins, data.classes, data.sums, data.n

    def run(part):
        def own(batches):
            held = [[block, np.zeros((block.n, k)) if score is None else score] for block, score in _opened(batches)]
            yield pa.RecordBatch.from_pylist([{"data": pickle.dumps(grow(Binned(None, bins, k, sums, n, held), part), 5)}])

        return pickle.loads(data.blocks.coalesce(1).mapInArrow(own, "data binary").first().data)  # noqa: S301  as above

    with ThreadPoolExecutor(len(parts)) as pool:  # one job each
        return list(pool.map(run, parts))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, np.ndarray | None]]:
    for batch in batches:
        for data in batch.column("data").to_pylist():
            yield pickle.loads(data)  # noqa: S301  rows that this module has written


def _bytes(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _arrays(data: bytes) -> list[np.ndarray]:
    held = np.load(io.BytesIO(data))
    return [held[k] for k in held.files]


def _merged(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both, which = np.unique(np.concatenate(keys), return_inverse=True)
    flat = np.concatenate(sums)
    out = np.stack([np.bincount(which.reshape(-1), flat[:, c], len(both)) for c in range(flat.shape[1])], 1)
    return both, out


def histogram(keys: np.ndarray, sums: np.ndarray, total: np.ndarray, zero: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, bins, sums of the bin, sums up to it) of each cell in order, given the cells other than of zero, and the sums over all rows: zero has what is left."""
    features = keys // wide
    own, first = np.unique(features, return_index=True)
    rest = total - np.add.reduceat(sums, first, 0) if len(own) else np.zeros((0, len(total)))
    keys, sums = np.concatenate([keys, own * wide + zero[own]]), np.concatenate([sums, rest])
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    features = keys // wide
    run = np.cumsum(sums, 0)
    start = np.searchsorted(features, features, "left")
    return features, keys % wide, sums, run - np.where(start[:, None] > 0, run[start - 1], 0.0)


def best_boosted(keys, sums, total, zero, wide, l2: float, least: float, few: int) -> tuple[float, int, int, np.ndarray]:
    """(gain, feature, bin, left sums) of the cut with the greatest gain; sums are of gradients, second derivatives and rows, of which both sides have ``least`` and ``few``. Of equal gains the first feature and bin; gain 0 where no cut gains."""
    features, bins, _, left = histogram(keys, sums, total, zero, wide)
    right = total - left
    part = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + l2, 1e-300)  # noqa: E731  empty sides are left out below
    gain = 0.5 * (part(left) + part(right) - part(total))
    gain = np.where((np.minimum(left[:, 1], right[:, 1]) >= least) & (np.minimum(left[:, 2], right[:, 2]) >= few), gain, 0.0)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, -1, 0, total
    i = int(np.flatnonzero(gain >= gain.max() * (1 - 1e-9))[0])
    return float(gain[i]), int(features[i]), int(bins[i]), left[i]


def impurity(sums: np.ndarray) -> np.ndarray:
    """Weight times Gini impurity."""
    n = sums.sum(-1)
    return n - (sums**2).sum(-1) / np.maximum(n, 1e-300)


def best_drawn(keys, sums, total, zero, wide, tried: int, few: int, draw) -> tuple[float, int, int, np.ndarray]:
    """The same for drawn cuts; sums are weights of the classes and rows, ``draw(feature, which)`` gives numbers in [0, 1)."""
    features, bins, cells, left = histogram(keys, sums, total, zero, wide)
    full = cells[:, -1] > 0.5
    features, bins, left = features[full], bins[full], left[full]
    own, first, count = np.unique(features, return_index=True, return_counts=True)
    own, first, count = own[count > 1], first[count > 1], count[count > 1]
    if not len(own) or impurity(total[:-1]) <= 1e-9:
        return 0.0, -1, 0, total
    chosen = np.argsort(draw(own, 0), kind="stable")[:tried]
    own, first, count = own[chosen], first[chosen], count[chosen]
    low, high = bins[first], bins[first + count - 1]
    place = low + (draw(own, 1) * (high - low)).astype(np.int64)  # a bin below the greatest
    at = np.array([f + np.searchsorted(bins[f : f + c], p, "right") - 1 for f, c, p in zip(first, count, place, strict=True)])
    gain = impurity(total[:-1]) - impurity(left[at, :-1]) - impurity((total - left[at])[:, :-1])
    gain = np.where(np.minimum(left[at, -1], total[-1] - left[at, -1]) >= few, np.maximum(gain, 1e-12), 0.0)
    i = int(np.lexsort((own, -gain))[0])
    return (float(gain[i]), int(own[i]), int(place[i]), left[at[i]]) if gain[i] > 0 else (0.0, -1, 0, total)


@dataclass
class _Open:
    """A node that waits for its cut: of which tree, which node, and which rows and features it takes."""

    tree: int
    node: int


def _search(data: Binned, trees: list[Tree], open_: list[_Open], channels, allowed, best) -> dict[tuple[int, int], tuple]:
    """(tree, node) -> (gain, feature, bin, left sums, sums) of all open nodes. ``channels(block, score, tree)`` gives the rows' sums or None for rows left out, ``allowed(tree)`` a mask of features or None."""
    slots = {(o.tree, o.node): i for i, o in enumerate(open_)}
    bins, wide = data.bins, int(np.diff(data.bins.first).max()) + 2
    used = sorted({o.tree for o in open_})
    masks = {t: allowed(t) for t in used}

    def added(blocks):
        found: dict[int, tuple[list, list, list]] = {}
        for block, score in blocks:
            for t in used:
                values = channels(block, score, t)
                at = block.nodes(trees[t])
                slot = np.array([slots.get((t, i), -1) for i in range(len(trees[t].feature))], np.int32)[at]
                slot = np.where(values.any(1), slot, -1)
                entry = slot[block.rows]
                some = entry >= 0
                if masks[t] is not None:
                    some &= masks[t][block.features]
                at = np.flatnonzero(some)  # in order of feature and bin
                at = at[np.argsort(entry[at].astype(np.uint16 if len(slots) < 1 << 16 else np.int64), kind="stable")]
                keys = (entry[at].astype(np.int64) * len(bins.zero) + block.features[at]) * wide + block.bins[at]
                start = np.flatnonzero(np.diff(keys, prepend=-1))
                keys, rows = keys[start], block.rows[at]
                sums = np.stack([np.add.reduceat(values[rows, c], start) if len(start) else np.zeros(0) for c in range(values.shape[1])], 1)
                owner = keys // (len(bins.zero) * wide)
                for s in np.unique(slot[slot >= 0]).tolist():
                    a, b = np.searchsorted(owner, [s, s + 1])
                    own = found.setdefault(s, ([], [], []))
                    own[0].append(keys[a:b] % (len(bins.zero) * wide))
                    own[1].append(sums[a:b])
                    own[2].append(values[slot == s].sum(0))
        for s, (keys, sums, total) in found.items():
            yield s, *((keys[0], sums[0]) if len(keys) == 1 else _merged(keys, sums)), np.sum(total, 0)

    if data.held is not None:
        return {(open_[s].tree, open_[s].node): (*best(open_[s], keys, sums, total, bins.zero, wide), total) for s, keys, sums, total in added(data.held)}

    def add(batches):
        for s, *part in added(_opened(batches)):
            yield pa.RecordBatch.from_pylist([{"slot": s, "part": _bytes(*part)}])

    def look(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for s, part in zip(batch.column("slot").to_pylist(), batch.column("part").to_pylist(), strict=True):
                own = held.setdefault(s, [])
                own.append(_arrays(part))
                if len(own) > 8:
                    own[:] = [[*_merged([x[0] for x in own], [x[1] for x in own]), np.sum([x[2] for x in own], 0)]]
        for s, own in held.items():
            keys, sums = _merged([x[0] for x in own], [x[1] for x in own])
            total = np.sum([x[2] for x in own], 0)
            gain, feature, bin_, left = best(open_[s], keys, sums, total, bins.zero, wide)
            yield pa.RecordBatch.from_pylist([{"slot": s, "gain": gain, "feature": feature, "bin": bin_, "sums": [*left.tolist(), *total.tolist()]}])

    parts = max(1, min(len(open_), data.blocks.sparkSession.sparkContext.defaultParallelism))
    rows = data.blocks.mapInArrow(add, "slot long, part binary").repartition(parts, "slot").mapInArrow(look, "slot long, gain double, feature long, bin long, sums array<double>").collect()
    out = {}
    for r in rows:
        half = len(r.sums) // 2
        out[open_[r.slot].tree, open_[r.slot].node] = (r.gain, r.feature, r.bin, np.array(r.sums[:half]), np.array(r.sums[half:]))
    return out


@dataclass
class Model:
    """Rounds of trees, one a class (boosted), or single trees of class shares (randomised)."""

    kind: str
    bins: Bins
    classes: int
    trees: list[list[Tree]]
    start: np.ndarray

    def scores(self, block: Block) -> np.ndarray:
        if self.kind == "boosted":
            return softmax(self.start + block.scores(self.trees, self.classes))
        out = np.zeros((block.n, self.classes))
        for (tree,) in self.trees:
            out += np.array([v if v else [0.0] * self.classes for v in tree.value])[block.nodes(tree)]
        return out / max(1, len(self.trees))

    def probabilities(self, features: Column) -> Column:
        """An array of the classes' probabilities for a vector column."""

        @F.arrow_udf("array<double>")
        def run(f: pa.Array, v: pa.Array) -> pa.Array:
            p = self.scores(_block(pa.RecordBatch.from_arrays([f, v], ["f", "v"]), self.bins))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * self.classes, pa.int32()), pa.array(p.ravel()))

        indices, values = _parts(features)
        return run(indices, values)

    def importance(self) -> np.ndarray:
        """Each feature's gain over all cuts, as a share of all gains."""
        out = np.zeros(len(self.bins.zero))
        for own in self.trees:
            for tree in own:
                for f, g in zip(tree.feature, tree.gain, strict=True):
                    if f >= 0:
                        out[f] += g
        return out / max(out.sum(), 1e-300)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(pickle.dumps(self, 5),)], "model binary").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        """A model that ``save`` has written; like any pickle, only from a place that one trusts."""
        return pickle.loads(spark.read.parquet(path).first().model)  # noqa: S301


def boost(data: Binned, rounds: int = 300, rate: float = 0.1, l2: float = 0.5, depth: int | None = 8, leaves: int | None = None, row_share: float = 1.0, feature_share: float = 1.0, least: float = 1e-3, few: int = 1, seed: int = 42) -> Model:
    """Multiclass boosting; by level up to ``depth``, or with ``leaves`` leaf by leaf, the best first (and up to ``depth``, if given)."""
    k, base = data.classes, data.blocks
    if data.held is None and data.n <= WITHIN:
        how = {"rounds": rounds, "rate": rate, "l2": l2, "depth": depth, "leaves": leaves, "row_share": row_share, "feature_share": feature_share, "least": least, "few": few, "seed": seed}
        return _within(data, lambda held, _: boost(held, **how), [0])[0]
    start = np.log(np.maximum(data.sums, 1e-12) / max(data.sums.sum(), 1e-12))
    done: list[list[Tree]] = []
    written = 0
    size = len(data.bins.zero)
    for number in range(rounds if k > 1 else 0):
        trees = [Tree() for _ in range(k)]
        recent = done[written:]

        def channels(block, score, c, recent=recent, number=number):
            held = (0.0 if score is None else score) + block.scores(recent, k)
            p = softmax(start + held)
            one = (drawn(seed, number, block.ids) < row_share).astype(float)
            w = block.w * one
            return np.stack([w * (p[:, c] - (block.y == c)), np.maximum(2 * w * p[:, c] * (1 - p[:, c]), 1e-16 * one), one], 1)

        def allowed(c, number=number):
            return drawn(seed, number, 7, c, np.arange(size)) < feature_share if feature_share < 1 else None

        def best(_, *cells):
            return best_boosted(*cells, l2, least, few)

        waiting: dict[tuple[int, int], tuple] = {}
        open_ = [_Open(c, 0) for c in range(k)]
        count = [1] * k
        while open_:
            found = _search(Binned(base, data.bins, k, data.sums, data.n, data.held), trees, open_, channels, allowed, best)
            for (c, node), cell in found.items():
                trees[c].value[node] = [-rate * cell[4][0] / (cell[4][1] + l2)]
                if cell[0] > 0 and (depth is None or trees[c].depth[node] < depth):
                    waiting[c, node] = cell
            chosen = []
            for c in range(k):
                own = sorted((x for x in waiting if x[0] == c), key=lambda x: (-waiting[x][0], x[1]))
                chosen += own if leaves is None else own[:1] if count[c] < leaves else []
            open_ = []
            for c, node in chosen:
                gain, feature, bin_, _, _ = waiting.pop((c, node))
                open_ += [_Open(c, child) for child in trees[c].split(node, feature, bin_, gain)]
                count[c] += 1
        done.append(trees)
        if data.held is not None:
            for own in data.held:
                own[1] = own[1] + own[0].scores([trees], k)
            written = len(done)
        elif len(done) - written >= WRITE_AFTER:
            recent = done[written:]

            def add(batches, recent=recent):
                for block, score in _opened(batches):
                    yield pa.RecordBatch.from_pylist([{"data": pickle.dumps((block, (0.0 if score is None else score) + block.scores(recent, k)), 5)}])

            new = cut(base.mapInArrow(add, "data binary"), "scores").persist()
            if base is not data.blocks:
                base.unpersist()
            base, written = new, len(done)
    return Model("boosted", data.bins, k, done, start)


def randomised(data: Binned, trees: int = 300, tried: int | None = None, depth: int | None = None, few: int = 1, seed: int = 42, firsts: list[int] | None = None) -> Model:
    """Extremely randomised trees: drawn features and cuts, leaves of ``few`` rows or more with the shares of the classes; ``tried`` is the root of the number of features by default, ``firsts`` are the groups to grow (all by default)."""
    k, out = data.classes, []
    tried = tried or max(1, int(len(data.bins.zero) ** 0.5))
    firsts = list(range(0, trees, TOGETHER)) if firsts is None else firsts
    if data.held is None and data.n <= WITHIN and firsts:
        each = -(-len(firsts) // TASKS)
        parts = [firsts[i : i + each] for i in range(0, len(firsts), each)]
        found = _within(data, lambda held, own: randomised(held, trees, tried, depth, few, seed, own), parts)
        return Model("randomised", data.bins, k, [t for m in found for t in m.trees], np.zeros(k))
    for first in firsts:
        group = [Tree() for _ in range(min(TOGETHER, trees - first))]

        def channels(block, score, t):
            return np.hstack([block.w[:, None] * (block.y[:, None] == np.arange(k)), np.ones((block.n, 1))])

        def best(o, keys, sums, total, zero, wide, first=first):
            return best_drawn(keys, sums, total, zero, wide, tried, few, lambda f, which: drawn(seed, first + o.tree, o.node, which, f))

        open_ = [_Open(t, 0) for t in range(len(group))]
        while open_:
            found = _search(data, group, open_, channels, lambda t: None, best)
            open_ = []
            for (t, node), (gain, feature, bin_, _, total) in sorted(found.items(), key=lambda x: x[0]):
                group[t].value[node] = (total[:-1] / max(total[:-1].sum(), 1e-300)).tolist()
                if gain > 0 and (depth is None or group[t].depth[node] < depth):
                    open_ += [_Open(t, child) for child in group[t].split(node, feature, bin_, gain)]
        out += [[t] for t in group]
    return Model("randomised", data.bins, k, out, np.zeros(k))
