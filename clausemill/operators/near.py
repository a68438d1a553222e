"""Near-duplicate token sets: keys, ties, components, one greedy pass.

Two sets with a Jaccard similarity of num / den or more differ in few tokens, at most ``d`` for
their sizes.  Tokens are dealt into ``m`` parts by hash, ``m > d``; then at least ``m - d`` parts of
two such sets are equal.  A set's keys are hashes of ``d + 1`` of its parts, those of the rarest
tokens (by counts of hash buckets): of the equal parts the rarest is not among the ``m - d - 1`` that
either set leaves out, so similar sets share a key, and unlike single tokens such keys, of several
tokens each, are seldom shared by others.  Sizes are in classes, each ``den / num`` times as large as
the one before; similar sets are in one class or two neighbouring ones, so a set has keys for its
class with the next and for the one before with it.

Of short texts that share phrases, such as clauses, thousands have equal parts.  There ``rare`` keys
serve: similar sets share one of each one's rarest tokens (one more than it may lack), in whatever
order of all tokens, and the next ones that they share are not far behind; counts by hash bucket give
an order in which rare ones come first, and tell whether a key needs a second and a third token.

Of a key that up to ``FEW`` sets share (``FEW_RARE`` of rare keys), the pairs are compared, and similar ones are tied: sets that
share a key by chance, ever more of them in ever larger tables, tie nothing.  The sets of other keys are
tied to the smallest of them, a star.  Components of the ties hold whatever is
similar.  ``dropped`` settles each component in one pass over its sets in order: a set goes if it is
similar to a kept one, which the same keys find.  A group of n near copies costs n rows at each
step; a task holds the kept sets of one component.  Of a component of over ``LARGE`` sets, those
similar to its first one, which always stays, go before, by a join that spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.operators.components import components
from clausemill.plans.stages import cut

#: Sets of a component beyond which the sets like its first one go beforehand.
LARGE = 20_000
#: Hash buckets of tokens whose counts tell rare from frequent ones.
BUCKETS = 1 << 18
#: Sets of a key up to which their pairs are compared; sets of a block of a larger key's pairs, about; tokens and rows at once in a task.
FEW, BLOCK, ONCE = 16, 256, 500_000
#: Sets that a key of rare tokens may have by chance, about, before another token is added to it; sets of such a key up to which their pairs are compared.
CHANCE, FEW_RARE = 8, 128


@lru_cache
def classes(most: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, d, m): the first size of each class up to that of ``most``, and for the sets of a class and the next one, the tokens in which similar ones differ at most, and the number of parts."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(starts[-1] * den // num + 1)
    starts += [starts[-1] * den // num + 1, (starts[-1] * den // num + 1) * den // num + 1]
    s = np.array(starts, np.int64)
    differ = (s[1:-1] - 1 + s[2:] - 1) * (den - num) // (den + num)
    return s, differ, differ + 1 + differ // 4


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_keys(hashes: np.ndarray, sizes: np.ndarray, group: np.ndarray, num: int, den: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place of the set, key) of all sets, given their tokens' hashes one after the other, their sizes, a hash of what they must have in common, and counts by bucket (none: parts of more tokens count as rarer); sets of no token have no key."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    drawn = _mixed(hashes.astype(np.int64).view(np.uint64))
    rarity = np.ones(len(drawn)) if counts is None else 0.05 + np.log(counts.max(initial=1) / np.maximum(counts, 1))[(drawn % np.uint64(len(counts))).astype(np.int64)]
    # whole numbers, whose sums are the same in whatever order
    rarity = (rarity * 1024).astype(np.int64)
    starts, differ, parts = classes(1 << int(sizes.max(initial=1)).bit_length(), num, den)
    level = np.searchsorted(starts, sizes, "right") - 1
    places, keys = [], []
    for step in (0, 1):
        pair = level - step
        some = (pair >= 0) & (sizes > 0)
        m = np.where(some, parts[np.maximum(pair, 0)], 0)
        first = np.concatenate([[0], np.cumsum(m)])
        use = some[own]
        slot = first[own[use]] + ((drawn[use] >> np.uint64(7)) % m[own[use]].astype(np.uint64)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        filled, at = np.unique(slot[order], return_index=True)
        sums, rare = np.zeros(first[-1], np.uint64), np.zeros(first[-1], np.int64)
        if len(at):
            sums[filled] = np.add.reduceat(drawn[use][order], at)
            rare[filled] = np.add.reduceat(rarity[use][order], at)
        whose = np.repeat(np.arange(len(sizes)), m)
        number = np.arange(first[-1]) - first[whose]
        salt = _mixed(group.astype(np.int64).view(np.uint64)[whose] + (number.astype(np.uint64) << np.uint64(12)) + pair[whose].astype(np.uint64))
        found = _mixed(sums ^ salt).view(np.int64)
        wanted = np.lexsort((found, -rare, whose))[number < (differ[np.maximum(pair, 0)] + 1)[whose]]  # whose is in order already
        places.append(whose[wanted])
        keys.append(found[wanted])
    return np.concatenate(places), np.concatenate(keys)


def rare_keys(hashes: np.ndarray, sizes: np.ndarray, group: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the set, key) of the rarest tokens of each set; similar sets share such a key.

    Of a set's tokens, the rarest first, a similar one has one among as many as it may lack and one more, a second
    among one more of them, and a third among two more. So the first token that both have makes a key alone where
    few sets have it, else with the second one, and with the third where still many sets would share it by chance:
    what decides is known of the tokens, so both decide alike. Any order of all tokens will do, so counts of hash
    buckets are enough. For short sets: the keys of a set may grow with the third power of what it may lack.
    """
    own = np.repeat(np.arange(len(sizes)), sizes)
    drawn = _mixed(hashes.astype(np.int64).view(np.uint64))
    many = counts[(drawn % np.uint64(len(counts))).astype(np.int64)]
    order = np.lexsort((drawn, many, own))
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(own)) - np.repeat(first, sizes)
    lacks = sizes - -(-sizes * num // den)
    drawn, many, salt = drawn[order], many[order].astype(np.float64), _mixed(group.astype(np.int64).view(np.uint64))
    common = max(1.0, float(counts.max(initial=1)))
    # sets of which a second and a third token are looked for; up to two tokens sets are similar only if they are equal
    at = np.flatnonzero(place <= lacks[own])  # own is in order already
    alone = (many[at] <= CHANCE) | (sizes[own[at]] < 3)
    found, places = [_mixed(drawn[at[alone]] ^ salt[own[at[alone]]])], [own[at[alone]]]
    at = at[~alone]

    def behind(last: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of last, place) of all tokens after the last one that a key has."""
        n = np.maximum(np.minimum(lacks[own[last]] + more, sizes[own[last]] - 1) - place[last], 0)
        row = np.repeat(np.arange(len(last)), n)
        return row, last[row] + 1 + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)

    for lo in range(0, len(at), ONCE // 8):
        one = at[lo : lo + ONCE // 8]
        row, second = behind(one, 1)
        key, likely = _mixed(drawn[one])[row] + drawn[second], many[one][row] * many[second] / common
        enough = likely <= CHANCE
        found.append(_mixed(_mixed(key[enough]) ^ salt[own[second[enough]]]))
        places.append(own[second[enough]])
        key, second = key[~enough], second[~enough]
        row, third = behind(second, 2)
        found.append(_mixed(_mixed(_mixed(key)[row] + drawn[third]) ^ salt[own[third]]))
        places.append(own[third])
    return np.concatenate(places), np.concatenate(found).view(np.int64)


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many sets have tokens of each hash bucket: one row a bucket, whatever the input."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            drawn = _mixed(_arrays(batch)[0].astype(np.int64).view(np.uint64))
            total += np.bincount((drawn % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = sets.select(_hashes()).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes one after the other, and sizes."""
    column = batch.column("hashes")
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``ONCE`` tokens, or one row."""
    ends = batch.column("hashes").offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + ONCE, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _keys(batch: pa.RecordBatch, counts: np.ndarray, rare: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    own = (*_arrays(batch), batch.column("d").to_numpy())
    return rare_keys(*own, counts, num, den) if rare else set_keys(*own, num, den, counts)


def keyed(sets: DataFrame, num: int, den: int, rare: np.ndarray | None = None, counts: np.ndarray | None = None) -> DataFrame:
    """(node, key) of all sets (node, domain, tokens): keys of rare tokens with the counts ``rare``, else of parts, the rarest by ``counts``; a pair may come twice."""

    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                places, keys = _keys(batch, counts if rare is None else rare, rare is not None, num, den)
                nodes = batch.column("node").to_numpy()[places]
                for i in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(keys[i : i + 100_000])], ["node", "key"])

    return sets.select("node", F.xxhash64("domain").alias("d"), _hashes()).mapInArrow(run, "node long, key long")


def _hashes():
    return F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes")


def stars(keys: DataFrame) -> DataFrame:
    """(u, v): each set with the smallest one that shares a key. Ends are aggregated before the shuffle, and only keys of several sets are joined."""
    ends = keys.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u < last").select("key", "u")
    return keys.join(ends, "key").where("node <> u").select("u", F.col("node").alias("v")).distinct()


def shared(keys: DataFrame) -> DataFrame:
    """(key, node, u, n) of the keys of several sets: the smallest set and the number of them. One shuffle of the keys, of which few are left."""
    own = Window.partitionBy("key")
    return keys.select("key", "node", F.min("node").over(own).alias("u"), F.max("node").over(own).alias("last"), F.count(F.lit(1)).over(own).alias("n")).where("u < last").drop("last")


def candidates(groups: DataFrame) -> DataFrame:
    """(a < b): the pairs of sets that share a key, once each.

    Near copies share many keys, mostly with the same smallest set, so a task that has all keys of such a set
    drops most repetitions before they are shuffled.  Larger groups are dealt in blocks of about ``BLOCK``
    sets by hash, each pair of blocks by itself.
    """
    blocks = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / BLOCK)))).cast("int")
    dealt = groups.select("key", "node", "u", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("u", "blocks", F.least("own", "other"), F.greatest("own", "other")).alias("cell")
    dealt = dealt.select(cell, "key", "node", (F.col("own") <= F.col("other")).alias("low"), (F.col("own") >= F.col("other")).alias("high"))

    def run(batches):
        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "key", "node", "low", "high")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if done:
                yield from _crossed(*(x[:done] for x in held))
                held = [x[done:] for x in held]
        if held is not None:
            yield from _crossed(*held)

    return dealt.repartition("cell").sortWithinPartitions("cell", "key", "node").mapInArrow(run, "a long, b long").distinct()


def _crossed(cell: np.ndarray, key: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one cell and key, one of the lower block and one of the higher, once each."""
    found, held = [], 0
    same = np.ones(len(cell), bool)
    for step in range(1, len(cell)):
        same = same[:-1] & (cell[step:] == cell[:-step]) & (key[step:] == key[:-step])
        if not same.any():
            break
        at = np.flatnonzero(same & (low[:-step] & high[step:] | high[:-step] & low[step:]) & (node[step:] != node[:-step]))
        found.append(np.stack([node[at], node[at + step]], 1))
        held += len(at)
        if held > 8 * ONCE:
            found = [np.unique(np.concatenate(found), axis=0)]
            held = len(found[0])
    if found:
        out = np.unique(np.concatenate(found), axis=0)
        for i in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 100_000, 0]), pa.array(out[i : i + 100_000, 1])], ["a", "b"])


def compared(near: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, domain, i < j, overlap, total) of those pairs (a, b) that are of one domain and similar."""
    left = sets.select(F.col("node").alias("a"), "domain", F.col("order").alias("o1"), F.col("tokens").alias("t1"))
    right = sets.select(F.col("node").alias("b"), F.col("domain").alias("other"), F.col("order").alias("o2"), F.col("tokens").alias("t2"))
    both = near.join(left, "a").join(right, "b").where("domain = other").withColumn("overlap", F.size(F.array_intersect("t1", "t2")))
    both = both.withColumn("total", F.size("t1") + F.size("t2") - F.col("overlap")).where(den * F.col("overlap") >= num * F.col("total"))
    return both.select("a", "b", "domain", F.least("o1", "o2").alias("i"), F.greatest("o1", "o2").alias("j"), "overlap", "total")


def ties(keys: DataFrame, sets: DataFrame, num: int, den: int, few: int = FEW) -> DataFrame:
    """(u, v): similar sets of the keys of up to ``few`` sets, and stars of the others."""
    groups = cut(shared(keys), "shared")
    close = compared(cut(candidates(groups.where(F.col("n") <= few)), "candidates"), sets, num, den).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return close.union(groups.where((F.col("n") > few) & (F.col("node") != F.col("u"))).select("u", F.col("node").alias("v")).distinct())


def dropped(sets: DataFrame, num: int, den: int, rare: bool = False) -> DataFrame:
    """(domain, order) of the sets (node, domain, order, tokens) that a kept one of a lower order in their domain removes."""
    counts = bucket_counts(sets)
    keys = keyed(sets, num, den, counts) if rare else keyed(sets, num, den, None, counts)
    found = components(cut(ties(keys, sets, num, den, FEW_RARE if rare else FEW), "ties"))
    grouped = cut(sets.join(found, "node").select("component", "domain", "order", "tokens"), "components")
    large = grouped.groupBy("component", "domain").agg(F.count(F.lit(1)).alias("n"), F.min_by("tokens", "order").alias("t"), F.min("order").alias("o")).where(F.col("n") > LARGE)
    both = F.size(F.array_intersect("tokens", "t"))
    marked = grouped.join(large, ["component", "domain"], "left").withColumn("like", F.col("t").isNotNull() & (F.col("order") != F.col("o")) & (den * both >= num * (F.size("tokens") + F.size("t") - both))).drop("t", "o", "n")
    kind = sets.select("domain", "order").schema

    def run(batches):
        component, index, kept = None, {}, []
        for batch in (x for whole in batches for x in _slices(whole)):
            places, keys = _keys(batch, counts, rare, num, den)
            cuts = np.searchsorted(np.sort(places), np.arange(batch.num_rows + 1))
            keys = keys[np.argsort(places, kind="stable")].tolist()
            gone = []
            owners = zip(batch.column("component").to_pylist(), batch.column("domain").to_pylist(), strict=True)
            for i, (own, tokens) in enumerate(zip(owners, batch.column("tokens").to_pylist(), strict=True)):
                if own != component:
                    component, index, kept = own, {}, []
                held, mine = set(tokens), keys[cuts[i] : cuts[i + 1]]
                found = {x for k in mine if k in index for x in index[k]}
                if any(den * (o := len(held & kept[x])) >= num * (len(held) + len(kept[x]) - o) for x in found):
                    gone.append(i)
                else:
                    for k in set(mine):
                        index.setdefault(k, []).append(len(kept))
                    kept.append(held)
            yield batch.select(["domain", "order"]).take(pa.array(gone, pa.int32()))

    rest = marked.where("NOT like").select("component", "domain", "order", "tokens", F.xxhash64("domain").alias("d"), _hashes())
    late = rest.repartition("component").sortWithinPartitions("component", "domain", "order").mapInArrow(run, kind)
    return marked.where("like").select("domain", "order").unionByName(late)


def pairs(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(domain, i < j, overlap, total) of all similar pairs of different sets: as many rows as there are such pairs."""
    near = cut(candidates(shared(keyed(sets, num, den, None, bucket_counts(sets)))), "candidates")  # its size decides how it is joined
    return compared(near, sets, num, den).drop("a", "b")
