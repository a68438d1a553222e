"""Similarity join of texts on word n-grams with count-vector R-trees (operator 10).

Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; a text's set holds
its distinct shingles of four words (with fewer words the whole sequence, without
words nothing).  Two texts link when their sets' Jaccard similarity reaches the
threshold (85 in a hundred).  Components of links come out, none is lost:

1. Every text's set, its name of 80 bits and its count vector are computed once and
   written to the shared folder; everything below works on distinct sets.
2. An R-tree over all count vectors would meet nearly all pairs, as vectors of
   unrelated texts of one size lie close together.  So sets are first dealt by exact
   prefix keys: in a global order of shingles, two linking sets share one of their
   first ``n - ceil(0.85 n) + 1``.  The order puts shingles last that many texts share
   (found by counting; a bounded list, which affects cost only).  Keys without two
   sets of sizes that may link are dropped, and of keys with the same sets one stays.
3. The sets of each key are indexed as points in an R-tree: shingles are hashed into
   groups, group counts are the coordinates.  The overlap of two sets is at most the
   sum of their coordinates' minima, that of two boxes at most the sum of their upper
   corners' minima; both are held against the overlap that the threshold asks for.
   What survives joins sets into neighbourhoods.  A task writes no pairs, only edges
   that span them, and nodes of one neighbourhood are skipped.
4. Each neighbourhood's whole sets go to one task, once.  An R-tree over them finds
   the pairs, which are verified there on the whole sets; again edges that span the
   components come out, and nodes of one component are skipped.

A group (of a key, or a neighbourhood) of more than ``BLOCK`` sets or ``WEIGHT``
shingles is dealt in blocks by size class, each with some members of its class and the
next as common seeds.  Then those that are not in the group's largest component meet
every block of their own and the neighbouring classes.  Two sets of different
components thus always meet, and a group that is one component costs one pass.

Null texts count as empty; empty sets link with nothing; an empty table gives an empty
result.  Rows that share a doc_id are joined each by its own text; rows of null doc_id
link like others and name no component but one of their own kind.
"""

from __future__ import annotations

from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from clausemill.llm.common import materialise, small_batches, steps, trim
from clausemill.llm.components import components

WORDS, PERCENT = 4, 85
GROUPS, LEAF = 128, 32
#: Sets and shingles of a group that one task takes whole, or of a block; seeds of a block.
BLOCK, WEIGHT, SEEDS = 4_096, 2_000_000, 64
HOT_BITS, HOT_MOST, HOTTER = 22, 1 << 17, 100_000
#: Entries of prefix keys that a task holds before it passes on large keys; parts of the keys at least, and bytes of a part.
HELD, PARTS, PART_BYTES = 2_000_000, 1_024, 12_000_000
#: Rows of 32 bytes that are broadcast at most.
SENT = 1_000_000
NAME = 10


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    if len(_words) > 100_000:
        _words.clear()
    index = _words.__getitem__
    rows = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    lengths = list(map(len, rows))
    flat = np.fromiter(map(index, chain.from_iterable(rows)), np.uint64, sum(lengths))
    out, at = [], 0
    many = np.full(max(0, len(flat) - WORDS + 1), WORDS, np.uint64)
    for i in range(WORDS if len(many) else 0):
        many = _mix(many, flat[i : i + len(many)])
    for n in lengths:
        if n >= WORDS:
            h = many[at : at + n - WORDS + 1]
            h.sort()
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif n:
            h = np.full(1, n, np.uint64)
            for i in range(n):
                h = _mix(h, flat[at + i : at + i + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(31)


def set_name(s: np.ndarray) -> bytes | None:
    """An 80-bit name of a set; null for the empty set."""
    return xxhash.xxh3_128_digest(s.tobytes())[:NAME] if len(s) else None


def need(a, b):
    """Least overlap of linking sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The shingles of which a linking set has one, in the order that puts hot ones last."""
    size = len(s) - -(-PERCENT * len(s) // 100) + 1
    warm = flagged(s, hot)
    rare = s[~warm]
    return rare[:size] if len(rare) >= size else np.concatenate((rare, s[warm]))[:size]


def largest(n: int, count: int) -> np.ndarray:
    """For each of the first ``count`` places of a set of ``n``: the largest set that can link with it and share no earlier shingle.

    From place p on, n - p shingles are left, which must reach the overlap needed.
    """
    return (100 + PERCENT) * (n - np.arange(count)) // PERCENT - n


def packed(most: np.ndarray, n: int) -> np.ndarray:
    """A largest size as a share of the own size in 16 bits, rounded up."""
    return np.ceil((most / n - 0.5) * 65_000).astype(np.uint16)


def unpacked(share: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.ceil((share / 65_000 + 0.5) * n).astype(np.int64)


def flagged(s: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each shingle's slot is set in a bitmap."""
    slot = s >> np.uint64(64 - HOT_BITS)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def vector(s: np.ndarray) -> np.ndarray:
    """Group counts, of ``GROUPS`` groups or so many that two to four shingles share one; 255 stands for any count from there on."""
    width = max(GROUPS, 1 << (len(s) // 4 - 1).bit_length()) if len(s) > 4 else GROUPS
    return np.minimum(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8)


def open_ended(v: np.ndarray) -> np.ndarray:
    """Vectors as upper bounds: 255 becomes more than any text has."""
    return np.where(v == 255, 1 << 24, v.astype(np.int32))


def folded(v: np.ndarray, width: int) -> np.ndarray:
    """The counts of fewer groups."""
    return v.reshape(-1, width).sum(0) if len(v) > width else v


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, set (its name), row (unique), n of every row; vector and shingles only where a task meets a set first."""

    def run(batches):
        seen: set[bytes] = set()
        row = TaskContext.get().partitionId() << 36
        for batch in steps(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            names = list(map(set_name, sets))
            first = [x is not None and x not in seen and not seen.add(x) for x in names]
            vectors = [vector(s).tobytes() if f else None for s, f in zip(sets, first, strict=True)]
            bodies = [s.tobytes() if f else None for s, f in zip(sets, first, strict=True)]
            rows = np.arange(row, row + len(sets))
            row += len(sets)
            if len(seen) > 200_000:
                seen.clear()
            columns = [batch.column("doc_id"), pa.array(names, pa.binary()), pa.array(rows), pa.array(map(len, sets), pa.int64()), pa.array(vectors, pa.binary()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "set", "row", "n", "vector", "shingles"])
        _words.clear()
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set binary, row long, n long, vector binary, shingles binary")


def _bodies(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a column in one array, and where each row's begin."""
    data = column.buffers()[2]
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    return np.frombuffer(data, np.uint64, at[-1] // 8) if data and at[-1] else np.zeros(0, np.uint64), at // 8


def hot_slots(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the hash slots of the most common shingles, and of those in very many sets; of fixed size.

    A task reports the shingles that it meets three times and more among a million.
    """

    def run(batches):
        held, size = [], 0

        def flush():
            values = np.concatenate(held)
            values.sort()
            third = values[2:][values[2:] == values[:-2]] if len(values) > 2 else values[:0]
            values, times = np.unique(third, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times + 2, pa.int64())], ["shingle", "times"])

        for batch in batches:
            flat, at = _bodies(batch.column("shingles"))
            held.append(flat[at[0] : at[-1]].copy())
            size += len(held[-1])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counted = sets.select("shingles").where("shingles is not null").mapInArrow(run, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    counted = materialise(counted.withColumn("level", F.floor(8 * F.log2("times")).cast("int")), "counted")
    # the lowest level down to which there are no more than the list may hold
    held, least = 0, 1 << 30
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # eight levels for each power of two
        held += r["count"]
        if held > HOT_MOST:
            break
        least = r.level
    top = counted.where(F.col("level") >= least).select("shingle", "times").collect()
    return _slots([r.shingle for r in top]), _slots([r.shingle for r in top if r.times >= HOTTER])


def _slots(shingles: list[int]) -> np.ndarray:
    out = np.zeros(1 << HOT_BITS - 3, np.uint8)
    slot = np.array(shingles, np.int64).view(np.uint64) >> np.uint64(64 - HOT_BITS)
    np.bitwise_or.at(out, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
    return out


_ENTRY = np.dtype([("key", "<u4"), ("n", "<u4"), ("most", "<u2"), ("lo", "<u8"), ("hi", "<u2")])
_NAMED = np.dtype([("rest", "V10"), ("name", f"V{NAME}")])
_LARGE = np.uint32(1 << 31)


def _names(e: np.ndarray) -> pa.Array:
    """The names of entries as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(e), [None, pa.py_buffer(np.arange(len(e) + 1, dtype=np.int32) * NAME), pa.py_buffer(np.ascontiguousarray(e.view(_NAMED)["name"]))])


def _fitting(e: np.ndarray, near: int = 8) -> np.ndarray:
    """Whether an entry's key has another set that may link and share no earlier key; entries come by key and size.

    Sizes and places decide among the ``near`` next ones; beyond that sizes alone do.
    """
    n = e["n"].astype(np.int64)
    most = unpacked(e["most"], n)
    out = np.zeros(len(e), bool)
    for d in range(1, near + 1):
        same = e["key"][d:] == e["key"][:-d]
        fits = same & (100 * n[:-d] >= PERCENT * n[d:])
        if d < near:
            fits &= (most[:-d] >= n[d:]) & (most[d:] >= n[:-d])
        out[d:] |= fits
        out[:-d] |= fits
    return out


def _key_groups(batches):
    """grp, mark, members of the keys that have two sets of sizes that may link; blobs come sorted by part.

    A key that is marked as large, or that a part turns out to hold too often to keep, is
    passed on in pieces that share ``grp``; else ``grp`` names the members.
    """
    part, held, size = None, [], 0
    large: set[int] = set()

    def pieces(e, grp, cuts):
        for a, b in zip([0, *cuts], [*cuts, len(e)], strict=True):
            if a == b:
                continue
            names = _names(e[a:b])
            yield grp, xxhash.xxh3_128_digest(grp + memoryview(names.buffers()[2])), names

    def settle(last: bool):
        """Groups of the held entries; before the last time those of large keys only, the others stay held."""
        nonlocal held, size
        e = np.concatenate(held)
        e = e[np.lexsort((~e["most"], e["hi"], e["lo"], e["n"], e["key"]))]
        same = e["key"][1:] == e["key"][:-1]
        new = np.ones(len(e), bool)
        new[1:] = ~same | (e["lo"][1:] != e["lo"][:-1]) | (e["hi"][1:] != e["hi"][:-1])  # of a set's places that meet in a key the first
        e = e[new]
        edge = np.flatnonzero(np.diff(e["key"])) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(e)]))
        marked = (e["n"][starts] & _LARGE > 0) | (ends - starts > HELD // 8) | np.isin(e["key"][starts], np.fromiter(large, np.uint32, len(large)))
        rest = np.repeat(~marked, ends - starts)
        for a, b in zip(starts[marked], ends[marked], strict=True):
            key = int(e["key"][a])
            grp = b"k" + key.to_bytes(4, "little")
            if not e["n"][a] & _LARGE:
                large.add(key)
                grp += int(part).to_bytes(8, "little")
            yield from pieces(e[a:b], grp, range(BLOCK, b - a, BLOCK))
        e = e[rest]
        if not last:
            held, size = [e], len(e)
            return
        e = e[_fitting(e)]
        if len(e):
            edge = np.flatnonzero(np.diff(e["key"])) + 1
            yield e, np.concatenate(([0], edge, [len(e)]))

    def batch_of(found):
        """Arrow batches: of single pieces, or of all keys of a part."""
        for x in found:
            if len(x) == 3:
                grp, mark, names = x
                yield pa.RecordBatch.from_arrays([pa.array([grp], pa.binary()), pa.array([mark], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)], ["grp", "mark", "members"])
                continue
            e, at = x
            data = np.ascontiguousarray(e.view(_NAMED)["name"]).tobytes()
            marks = [xxhash.xxh3_128_digest(data[NAME * a : NAME * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            for k in range(0, len(marks), 5_000):
                own = pa.array(marks[k : k + 5_000], pa.binary())
                cut = at[k : k + 5_001]
                yield pa.RecordBatch.from_arrays([own, own, pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), _names(e[cut[0] : cut[-1]]))], ["grp", "mark", "members"])

    for batch in batches:
        for own, blob in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist(), strict=True):
            if own != part and held:
                yield from batch_of(settle(True))
                held, size = [], 0
                large.clear()
            part = own
            held.append(np.frombuffer(blob, _ENTRY))
            size += len(held[-1])
            if size > HELD:
                yield from batch_of(settle(False))
    if held:
        yield from batch_of(settle(True))


def key_groups(sets: DataFrame, hot: np.ndarray, hotter: np.ndarray, parts: int) -> DataFrame:
    """grp, members (names of distinct sets) for the prefix shingles that sets of fitting sizes share.

    A key is a part number and 32 bits of the shingle's hash; two shingles that meet in
    a key cost a comparison, no more.  Shingles of very many sets are dealt over all
    parts by set.  Keys with the same members are one group.
    """

    def run(batches):
        held, size = [], 0

        def flush():
            e = np.concatenate([x[1] for x in held])
            own = np.concatenate([x[0] for x in held])
            order = np.argsort(own, kind="stable")
            e, own = e[order], own[order]
            at = np.flatnonzero(np.diff(own, prepend=-1))
            blobs = [e[a:b].tobytes() for a, b in zip(at, [*at[1:], len(e)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(blobs, pa.binary())], ["part", "entries"])

        for batch in batches:
            flat, at = _bodies(batch.column("shingles"))
            for name, a, b in zip(batch.column("set").to_pylist(), at[:-1], at[1:], strict=True):
                own = prefix(flat[a:b], hot)
                e = np.empty(len(own), _ENTRY)
                e.view(_NAMED)["name"] = np.frombuffer(name, f"V{NAME}")
                e["key"], e["n"], e["most"] = own >> np.uint64(32), b - a, packed(largest(b - a, len(own)), b - a)
                to = ((own & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
                if (very := flagged(own, hotter)).any():
                    e["n"][very] |= _LARGE
                    to[very] = int(e["lo"][0]) % parts
                held.append((to, e))
                size += len(own)
            if size > 300_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    blobs = sets.select("set", "shingles").where("shingles is not null").mapInArrow(run, "part long, entries binary")
    found = blobs.repartition("part").sortWithinPartitions("part").mapInArrow(_key_groups, "grp binary, mark binary, members array<binary>")
    return found.dropDuplicates(["mark"]).select("grp", "members")


class RTree:
    """Count vectors under boxes: a node keeps its upper corner and its smallest and largest size."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, fine: list[np.ndarray | None] | None = None):
        self.vectors, self.sizes, self.fine = vectors, sizes, fine
        self.nodes: list[tuple[np.ndarray, int, int, int, int, list[int]]] = []
        self.order = np.arange(len(sizes))
        self.root = self._build(0, len(sizes))

    def _build(self, a: int, b: int) -> int:
        own = self.order[a:b]
        children: list[int] = []
        if b - a > LEAF:
            v = self.vectors[own]
            axis = int((v.max(0).astype(np.int64) - v.min(0)).argmax())
            self.order[a:b] = own[np.argsort(v[:, axis], kind="stable")]
            mid = (a + b) // 2
            children = [self._build(a, mid), self._build(mid, b)]
        self.nodes.append((self.vectors[own].max(0), int(self.sizes[own].min()), int(self.sizes[own].max()), a, b, children))
        return len(self.nodes) - 1

    def pairs(self, labels: np.ndarray):
        """Rows (i, j) of different labels that sizes and bounds allow to link, leaf by leaf.

        ``labels`` may change while the caller joins what it gets: nodes that have become one are skipped.
        """
        todo = [(self.root, self.root)]
        while todo:
            p, q = todo.pop()
            top, small, big, a, b, inner = self.nodes[p]
            top2, small2, big2, a2, b2, inner2 = self.nodes[q]
            if 100 * big < PERCENT * small2 or 100 * big2 < PERCENT * small:
                continue
            if np.minimum(top, top2).sum(dtype=np.int64) < need(small, small2):
                continue
            left, right = self.order[a:b], self.order[a2:b2]
            label = labels[left[0]]
            if (labels[left] == label).all() and (labels[right] == label).all():
                continue
            if not inner and not inner2:
                i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
                if p == q:
                    i, j = i[i < j], j[i < j]
                i, j = passing(self.vectors, self.sizes, labels, i, j, self.fine)
                if len(i):
                    yield i, j
            elif p == q:
                todo += [(inner[0], inner[1]), (inner[1], inner[1]), (inner[0], inner[0])]
            elif inner and (not inner2 or b - a >= b2 - a2):
                todo += [(c, q) for c in inner]
            else:
                todo += [(p, c) for c in inner2]


def passing(vectors, sizes, labels, i, j, fine=None):
    """The pairs that differ in label, may link by their sizes and pass the bound of summed minima; large sets also that of ``fine`` vectors."""
    a, b = sizes[i], sizes[j]
    keep = (labels[i] != labels[j]) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
    i, j = i[keep], j[keep]
    out = np.ones(len(i), bool)
    for at in range(0, len(i), 16_384):
        own = slice(at, at + 16_384)
        out[own] = np.minimum(vectors[i[own]], vectors[j[own]]).sum(1, dtype=np.int64) >= need(sizes[i[own]], sizes[j[own]])
    i, j = i[out], j[out]
    if fine is None:
        return i, j
    out = np.ones(len(i), bool)
    for k in np.flatnonzero(np.minimum(sizes[i], sizes[j]) > 4 * GROUPS).tolist():
        x, y = fine[i[k]], fine[j[k]]
        if x is not None and y is not None:
            width = min(len(x), len(y))
            out[k] = np.minimum(folded(x, width), folded(y, width)).sum(dtype=np.int64) >= need(int(sizes[i[k]]), int(sizes[j[k]]))
    return i[out], j[out]


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Shared shingles of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 1 << 15) -> np.ndarray:
    """Shared shingles of every x with every y, as products of incidence matrices of ``width`` shingles."""
    _, column = np.unique(np.concatenate([*xs, *ys]), return_inverse=True)
    row = np.repeat(np.arange(len(xs) + len(ys)), [len(s) for s in (*xs, *ys)])
    out = np.zeros((len(xs), len(ys)), np.int64)
    for at in range(0, int(column.max(initial=-1)) + 1, width):
        own = (column >= at) & (column < at + width)
        m = np.zeros((len(xs) + len(ys), width), np.float32)
        m[row[own], column[own] - at] = 1
        out += (m[: len(xs)] @ m[len(xs) :].T).astype(np.int64)
    return out


def spanning(vectors: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray] | None = None, fine: list | None = None) -> list[tuple[int, int]]:
    """Rows (i, j) that join all rows that link, and no more than that takes; without sets, that the bound lets pass."""
    labels, out = labels.copy(), []
    for i, j in RTree(vectors, sizes, fine).pairs(labels):
        linked = None
        if sets is not None and len(i) > 48:
            xs, at_x = np.unique(i, return_inverse=True)
            ys, at_y = np.unique(j, return_inverse=True)
            both = overlaps([sets[k] for k in xs], [sets[k] for k in ys])[at_x, at_y]
            linked = 100 * both >= PERCENT * (sizes[i] + sizes[j] - both)
            i, j, linked = i[linked], j[linked], True
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if labels[a] == labels[b]:
                continue
            if sets is not None and not linked:
                both = overlap(sets[a], sets[b])
                if 100 * both < PERCENT * (int(sizes[a]) + int(sizes[b]) - both):
                    continue
            out.append((a, b))
            labels[labels == labels[b]] = labels[a]
    return out


def _vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Vectors of ``GROUPS`` groups as bounds, and the finer ones."""
    raw = column.to_pylist()
    fine = [open_ended(np.frombuffer(x, np.uint8)) if len(x) > GROUPS else None for x in raw]
    plain = open_ended(np.frombuffer(b"".join([x[:GROUPS] for x in raw]), np.uint8).reshape(-1, GROUPS))
    for k, v in enumerate(fine):
        if v is not None:
            plain[k] = folded(v, GROUPS)
    return plain, fine


def _small_spans(deal, vectors, sizes, labels, fine) -> tuple[np.ndarray, np.ndarray]:
    """The same for many groups of one leaf each, without sets: all together, pair distance by pair distance."""
    edge = np.flatnonzero(np.diff(deal)) + 1
    ends = np.repeat(np.concatenate((edge, [len(deal)])), np.diff(np.concatenate(([0], edge, [len(deal)]))))
    found = []
    d = 1
    while len(i := np.flatnonzero(np.arange(len(deal)) + d < ends)):
        found.append(passing(vectors, sizes, labels, i, i + d, fine))
        d += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    root = np.arange(len(deal))
    while True:
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            break
    at = np.flatnonzero(root != np.arange(len(deal)))
    return root[at], at


def _spans(batches, whole: bool):
    """u, v of rows that come sorted by deal; each deal is handled as it ends."""
    held: list[pa.RecordBatch] = []

    def handle(table: pa.Table):
        deal = table.column("deal").to_numpy()
        names, sizes, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "label"))
        vectors, fine = _vectors(table.column("vector"))
        sets = None
        if whole:
            flat, at = _bodies(table.combine_chunks().column("shingles").chunk(0))
            sets = [flat[a:b] for a, b in pairwise(at.tolist())]
        edge = np.flatnonzero(np.diff(deal)) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(deal)]))
        small = (ends - starts <= LEAF) & (not whole)
        u, v = [], []
        if small.any():
            own = np.repeat(small, ends - starts)
            i, j = _small_spans(deal[own], vectors[own], sizes[own], labels[own], [fine[k] for k in np.flatnonzero(own)])
            u.append(names[own][i])
            v.append(names[own][j])
        for a, b in zip(starts[~small], ends[~small], strict=True):
            for i, j in spanning(vectors[a:b], sizes[a:b], labels[a:b], sets[a:b] if sets else None, fine[a:b]):
                u.append(names[a + i : a + i + 1])
                v.append(names[a + j : a + j + 1])
        none = np.zeros(0, np.int64)
        edges = np.unique(np.stack((np.concatenate([none, *u]), np.concatenate([none, *v]))), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["u", "v"])

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        last = batch.column("deal")[-1].as_py()
        if not whole and rows < 10_000 or held[0].column("deal")[0].as_py() == last:
            continue
        table = pa.Table.from_batches(held)
        done = int(np.searchsorted(table.column("deal").to_numpy(), last))
        yield handle(table.slice(0, done))
        held, rows = table.slice(done).combine_chunks().to_batches(), rows - done
    if held:
        yield handle(pa.Table.from_batches(held))
    trim()


def spans(rows: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """u, v: edges that span what links in each grp of rows (grp, node, n and, without sets, vector)."""
    thin, whole = rows.select("grp", "node", "n"), sets is not None
    most = f"count(*) > {BLOCK}" + (f" or sum(n) > {WEIGHT}" if whole else "")
    large = thin.groupBy("grp").agg(F.expr(most).alias("large")).where("large").select("grp")
    key = F.xxhash64("grp").alias("deal")  # two groups that meet in a deal cost comparisons, no more
    if large.isEmpty():
        return materialise(_spanned(rows.withColumn("deal", key).withColumn("label", F.col("node")), sets), "spans")
    large = materialise(large, "large")
    small = rows.join(large, "grp", "left_anti").withColumn("deal", key).withColumn("label", F.col("node"))
    # linking sets are in the same size class or in neighbouring ones
    home = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / PERCENT)) * 1.0000001)).cast("int")
    big = rows.join(large, "grp", "left_semi").withColumn("home", home)
    blocks = F.expr(f"cast(ceil(greatest(count(*) / {BLOCK}, " + (f"sum(n) / {WEIGHT}" if whole else "0") + ")) as int)")
    classes = materialise(big.groupBy("grp", "home").agg(blocks.alias("blocks"), F.count("*").alias("members")), "classes")
    big = big.join(classes, ["grp", "home"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    seeds = big.where(f"pmod(xxhash64(node, 1), greatest(1, members div {SEEDS})) = 0").drop("blocks", "block", "members")
    seeds = seeds.withColumn("home", F.explode(F.array("home", F.col("home") - 1))).join(classes.drop("members"), ["grp", "home"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = big.drop("members").unionByName(seeds.select(big.drop("members").columns)).withColumn("deal", F.xxhash64("grp", "home", "block")).withColumn("label", F.col("node"))
    columns = small.columns
    edges = materialise(_spanned(small.unionByName(first.select(columns)), sets), "spans")
    # those outside of a group's largest component meet every block of their own and the neighbouring classes
    labels = components(edges)
    big = big.drop("members").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    main = big.groupBy("grp", "label").count().groupBy("grp").agg(F.max_by("label", "count").alias("main"))
    odd = materialise(big.select("grp", "node", "label", "home").join(main, "grp").where("label <> main"), "odd").drop("main")
    if odd.isEmpty():
        return edges
    chunks = materialise(odd.groupBy("grp", "home").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("chunks")), "chunks")
    near = F.explode(F.array(F.col("home") - 1, "home", F.col("home") + 1)).alias("other")
    there = chunks.select("grp", F.col("home").alias("from"), "chunks", near).select("grp", "from", "chunks", F.col("other").alias("home"))
    met = big.join(there, ["grp", "home"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    apart = big.join(odd.select("grp", "node"), ["grp", "node"], "left_semi").join(chunks, ["grp", "home"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), "chunks"))
    apart = apart.withColumn("from", F.col("home")).drop("blocks", "block").withColumn("home", F.explode(F.array(F.col("home") - 1, "home", F.col("home") + 1)))
    apart = apart.join(classes.drop("members"), ["grp", "home"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    second = met.unionByName(apart.select(met.columns)).withColumn("deal", F.xxhash64("grp", "home", "block", "from", "chunk"))
    return edges.unionByName(materialise(_spanned(second.select(columns), sets), "spans"))


def _spanned(dealt: DataFrame, sets: DataFrame | None) -> DataFrame:
    whole = sets is not None
    thin = dealt.select("deal", "node", "n", "label", *([] if whole else ["vector"]))
    if whole:
        few = thin.count() <= SENT
        thin = sets.select(F.col("row").alias("node"), "vector", "shingles").where("shingles is not null").join(F.broadcast(thin) if few else thin, "node")
    return thin.repartition("deal").sortWithinPartitions("deal", "n", "node").mapInArrow(lambda batches: _spans(batches, whole), "u long, v long")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, set, n; distinct sets: set, node, rep, n; links: u, v between nodes, enough to span every component)."""
    with small_batches(docs.sparkSession):
        return _links(docs)


def _links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    sets = materialise(shingled(docs), "sets")
    own = sets.select("doc_id", "set", "n")
    points = sets.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.expr("min(if(vector is null, null, row))").alias("node"), F.first("n").alias("n"), F.first("vector", True).alias("vector"))
    points = materialise(points, "points")
    # a set has about n * 15 / 100 prefix keys
    total = points.agg(F.sum("n")).first()[0] or 0
    parts = max(PARTS, int(total * (100 - PERCENT) // 100 * _ENTRY.itemsize // PART_BYTES))
    groups = materialise(key_groups(sets, *hot_slots(sets), parts), "groups")
    rows = groups.select(F.xxhash64("grp").alias("grp"), F.explode("members").alias("set")).join(points.hint("shuffle_merge"), "set").select("grp", "node", "n", "vector")
    hoods = components(spans(materialise(rows, "rows")))
    members = materialise(hoods.join(points.select("node", "n"), "node").select(F.col("component").alias("grp"), "node", "n"), "hoods")
    return own, points.drop("vector"), spans(members, sets)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) for every row."""
    own, points, found = links(docs)
    joined = own.where("n > 0").select("doc_id", "n", "set").join(_named(points, found), "set").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _named(points: DataFrame, found: DataFrame) -> DataFrame:
    """set, component (a node), component_id (the smallest doc_id there) of every distinct set."""
    joined = points.join(components(found), "node")
    first = joined.groupBy("component").agg(F.min("rep").alias("first"))
    first = joined.join(first, "component").select("set", "component", "first")
    return points.join(first, "set", "left").select("set", F.coalesce("component", "node").alias("component"), F.coalesce("first", "rep").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: one of those with the smallest doc_id (a null one where no other is); rows stay as they are.

    Rows without words stay.  Where rows share a doc_id, or have none, the one with the
    smallest text among those in the component stays, also if they are equal.  Columns of
    ``docs`` may have any names.
    """
    own, points, found = links(docs)
    named = materialise(_named(points, found), "named")
    name = "set"
    while name in docs.columns:
        name += "_"
    often = materialise(own.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(name)), "often")
    once = own.join(named, "set", "left").where("n = 0 or doc_id = component_id").select(F.col("doc_id").alias(name)).join(often, name, "left_anti").where(F.col(name).isNotNull())
    plain = docs.join(once, F.col("doc_id") == F.col(name), "left_semi")
    if often.isEmpty():
        return plain
    odd = _with_names(docs.join(often, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi"), name)
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("whole")
    odd = odd.select(whole, F.col(name).alias("set"), F.col("doc_id").alias("id")).join(named, "set", "left").where("component is null or id <=> component_id")
    one = odd.where("component is not null").groupBy("component").agg(F.min_by("whole", "whole.text").alias("whole"))
    return plain.unionByName(one.select("whole.*")).unionByName(odd.where("component is null").select("whole.*"))


def _with_names(docs: DataFrame, name: str) -> DataFrame:
    """The rows with the names of their sets."""

    def run(batches):
        for batch in steps(batches):
            names = [set_name(s) for s in shingle_sets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))
