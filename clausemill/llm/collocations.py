"""Phrase collocations by hierarchical pair naming (operator 11).

Texts are coded once, where they are read: every part of some ``PART`` bytes of text has its own
dictionary of (lang, word) with counts, and its words as numbers of that dictionary, with a zero
where a piece ends.  From there on a level at a time:

1. Names of the level are joined globally: the words of the dictionaries (level 1) or the pairs
   of the last level's names (higher levels) meet in buckets by hash.  What occurs ``least`` times
   gets an id, and every part learns the ids of its own entries.
2. Each part replaces its numbers by these ids, zero where there is none.  Two neighbours that
   both have an id are a pair: a (k-1)-gram and the next one, which share all but one word, make
   a k-gram.  The part counts its distinct pairs and deals them to the buckets.  Nothing of this is
   kept but the ids: for the next level a part finds its pairs again, in the same order.

A name is a row (id, left, right, count) whose left and right point at the two names it joins.
The pointers give the parts of every cut (k-1 words from the left: follow right pointers; the
first words: follow left ones) and the phrases that hold it: a phrase is dropped if one that
points at it is frequent enough, as longer ones are never more frequent than those.

Only pairs of frequent names are shuffled, a part at a time, as packed columns of integers.  A bucket holds ``BUCKET`` pairs on average, at most one entry for a part
and pair, whatever a pair's frequency.  A hot language is split like any other, because pairs are
dealt by their names; ranks by language keep the first rows of every task before the shuffle.

Null texts are empty; null languages are ``und``.  Equal rows count each.  An empty table gives an
empty result.  Only ``lang`` and ``text`` are read, so further columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.common import materialise, small_batches, trim

#: Bytes of text of a part, bytes that are split into words at once, numbers of a row, pairs and words of a bucket.
PART, SLICE, ROW, BUCKET, DISTINCT = 10_000_000, 1_000_000, 200_000, 800_000, 250_000
BREAK = b"\xff"  # no byte of UTF-8
TABLE = bytes(0xFF if chr(i) in ".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))

#: Shares of a language's phrases that are ranked apart first.
SALTS = 16

CODED = "part string, at int, numbers binary, lang string, words binary, times binary, size int, n long"
WORDS = "bucket int, part string, lang string, words binary, numbers binary, times binary"
PAIRS = "bucket int, part string, entries binary"
NAMED = "id long, a long, b long, times long, part string, level int, numbers binary, ids binary"


def squeezed(held: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(held)


def loosened(held: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(held)


def packed(column: np.ndarray, rising: bool = False) -> bytes:
    """A column of integers, as differences if it rises: bytes of equal weight together, compressed."""
    own = np.diff(column, prepend=column.dtype.type(0)) if rising else column
    return squeezed(np.ascontiguousarray(own.view(np.uint8).reshape(len(own), -1).T).tobytes())


def unpacked(held: bytes, kind: str, rising: bool = False) -> np.ndarray:
    own = np.frombuffer(loosened(held), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    own = np.ascontiguousarray(own.T).view(kind).ravel()
    return np.cumsum(own, dtype=kind) if rising else own


#: Columns of the distinct pairs of a part in a bucket, in order of the two names: names, number in the part, count there.
COLUMNS = (("a", "<i8", True), ("b", "<i8", False), ("number", "<i4", True), ("times", "<i4", False))


def _joined(columns: list[np.ndarray]) -> bytes:
    parts = [packed(c, rising) for c, (_, _, rising) in zip(columns, COLUMNS, strict=True)]
    return np.array([len(p) for p in parts], "<i4").tobytes() + b"".join(parts)


def _split(held: bytes) -> list[np.ndarray]:
    ends = np.cumsum([4 * len(COLUMNS), *np.frombuffer(held, "<i4", len(COLUMNS))])
    return [unpacked(held[x:y], kind, rising) for x, y, (_, kind, rising) in zip(ends, ends[1:], COLUMNS, strict=False)]


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in slices, with BREAK between pieces; A-Z in lower case."""
    text = text.translate(TABLE)
    at = 0
    while at < len(text):
        to = text.find(b" ", at + SLICE)
        to = len(text) if to < 0 else to
        yield text[at:to].replace(BREAK, b" \xff ").split()
        at = to


def _code(batches):
    """Rows of numbers, then of the dictionary, of each part."""
    task, made = TaskContext.get().partitionId(), 0
    table: dict = {}
    chunks: list[np.ndarray] = []
    size = entries = 0

    def written():
        name = f"{task}-{made}"
        flat = np.concatenate([*chunks, np.zeros(1, np.int32)])
        counts = np.bincount(flat, minlength=entries + 1)
        rows = [{"part": name, "at": at // ROW, "numbers": packed(flat[at : at + ROW])} for at in range(0, len(flat), ROW)]
        for lang, own in table.items():
            found, numbers = list(own)[1:], np.fromiter(own.values(), "<i4", len(own))[1:]
            for at in range(0, len(found), ROW):
                these = numbers[at : at + ROW]
                rows.append({"part": name, "lang": lang, "words": squeezed(b" ".join(found[at : at + ROW])), "numbers": packed(these), "times": packed(counts[these]), "size": len(these), "n": int(counts[these].sum())})
        for row in rows:
            yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("part", pa.string()), ("at", pa.int32()), ("numbers", pa.binary()), ("lang", pa.string()), ("words", pa.binary()), ("times", pa.binary()), ("size", pa.int32()), ("n", pa.int64())])
    end = np.zeros(1, np.int32)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = table.setdefault(lang, {BREAK: 0})
            for found in words(text):
                get = own.get
                numbers = [get(w) for w in found]
                if None in numbers:
                    for i, w in enumerate(found):
                        if numbers[i] is None:
                            if (x := get(w)) is None:
                                entries += 1
                                x = own[w] = entries
                            numbers[i] = x
                chunks.append(np.array(numbers, np.int32))
            chunks.append(end)
            size += len(text)
            if size > PART:
                yield from written()
                table, entries, chunks, size, made = {}, 0, [], 0, made + 1
                trim()
    if size:
        yield from written()


def coded(docs: DataFrame) -> DataFrame:
    """The coded texts, as a table in the shared folder."""
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("length(text) > 0")
    with small_batches(own.sparkSession, 1_000, "8m"):
        return materialise(own.mapInArrow(_code, CODED), "coded")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, list]]:
    """For each part (rows sorted by part): its rows of numbers, by their order, and its rows of ids (level, numbers, ids)."""
    part, flats, ids = None, [], []
    for batch in batches:
        for name, at, level, numbers, own in zip(*(batch.column(x).to_pylist() for x in ("part", "at", "level", "numbers", "ids")), strict=True):
            if name != part:
                if part is not None:
                    yield part, flats, ids
                part, flats, ids = name, [], []
            if own is None:
                flats.append((at, unpacked(numbers, "<i4")))
            else:
                ids.append((level, unpacked(numbers, "<i4"), unpacked(own, "<i8")))
    if part is not None:
        yield part, flats, ids


def _neighbours(flat: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, number of the pair at each, first names, second names, counts): distinct pairs of neighbours with names, in order of the names. ``names`` has the id of each number, 0 for none."""
    some = np.flatnonzero(names)
    some = some[np.argsort(names[some])]
    rank = np.full(len(names), -1, np.int64)
    rank[some] = np.arange(len(some))
    own = rank[flat]
    at = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
    keys, which, times = np.unique(own[at] * max(1, len(some)) + own[at + 1], return_inverse=True, return_counts=True)
    return at, which.reshape(-1), names[some[keys // max(1, len(some))]], names[some[keys % max(1, len(some))]], times


def _pairs(level: int, buckets: int):
    """Of each part: its distinct pairs of names of the level before, by bucket. The part goes through the levels below again: pairs have the same numbers each time."""

    def run(batches):
        schema = pa.schema([("bucket", pa.int32()), ("part", pa.string()), ("entries", pa.binary())])
        for part, flats, ids in _by_part(batches):
            flat = np.concatenate([x for _, x in sorted(flats, key=lambda x: x[0])])
            for k in range(1, level):
                names = np.zeros(1 + max([int(flat.max(initial=0)), *(int(n.max()) for x, n, _ in ids if x == k)]), np.int64)
                for x, n, i in ids:
                    if x == k:
                        names[n] = i
                at, which, first, second, times = _neighbours(flat, names)
                flat = np.zeros(len(flat), np.int32)
                flat[at] = which + 1
            mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
                yield pa.RecordBatch.from_pylist([{"bucket": int(bucket[own[0]]), "part": part, "entries": _joined([first[own], second[own], (own + 1).astype("<i4"), times[own].astype("<i4")])}], schema)
            del flat, names, first, second, times, mixed, bucket, order
            trim()

    return run


def _words(buckets: int):
    """The dictionaries of the parts, by bucket."""

    def run(batches):
        schema = pa.schema([("bucket", pa.int32()), ("part", pa.string()), ("lang", pa.string()), ("words", pa.binary()), ("numbers", pa.binary()), ("times", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                found, numbers, times = loosened(row["words"]).split(b" "), unpacked(row["numbers"], "<i4"), unpacked(row["times"], "<i8")
                bucket = np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % buckets
                order = np.argsort(bucket, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    held = row | {"bucket": int(bucket[own[0]]), "words": squeezed(b" ".join([found[i] for i in own.tolist()])), "numbers": packed(numbers[own]), "times": packed(times[own])}
                    yield pa.RecordBatch.from_pylist([held], schema)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket (rows sorted by bucket)."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != key:
                if rows:
                    yield key, rows
                key, rows = row["bucket"], []
            rows.append(row)
    if rows:
        yield key, rows


def _name_words(least: int):
    """Of each bucket: the words that occur ``least`` times or more in a language, with ids, and for each part its own ones."""

    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("times", pa.int64()), ("part", pa.string()), ("level", pa.int32()), ("numbers", pa.binary()), ("ids", pa.binary())])
        for bucket, rows in _by_bucket(batches):
            sums: dict[str, dict[bytes, int]] = {}
            for row in rows:
                own = sums.setdefault(row["lang"], {})
                for w, n in zip(loosened(row["words"]).split(b" "), unpacked(row["times"], "<i8").tolist(), strict=True):
                    own[w] = own.get(w, 0) + n
            ids: dict[str, dict[bytes, int]] = {}
            last = bucket << 32
            for lang, own in sums.items():
                found = [(w, n) for w, n in own.items() if n >= least]
                ids[lang] = {w: last + i for i, (w, _) in enumerate(found, 1)}
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "word": w.decode(), "id": ids[lang][w], "times": n} for w, n in some], schema)
                last += len(found)
            for row in rows:
                get = ids[row["lang"]].get
                named = np.array([get(w, 0) for w in loosened(row["words"]).split(b" ")], "<i8")
                if named.any():
                    yield pa.RecordBatch.from_pylist([{"part": row["part"], "level": 1, "numbers": packed(unpacked(row["numbers"], "<i4")[named > 0]), "ids": packed(named[named > 0])}], schema)

    return run


def _name(level: int, least: int):
    """Of each bucket: the pairs that occur ``least`` times or more, with ids, and for each part its own ones."""

    def run(batches):
        schema = pa.schema([("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("times", pa.int64()), ("part", pa.string()), ("level", pa.int32()), ("numbers", pa.binary()), ("ids", pa.binary())])

        def named(bucket, parts, rows):
            own = [_split(r) for r in rows]
            sizes = [len(x[0]) for x in own]
            a, b, number, count = (np.concatenate(c) for c in zip(*own, strict=True))
            owner = np.repeat(np.arange(len(rows)), sizes)
            left, i = np.unique(a, return_inverse=True)
            right, j = np.unique(b, return_inverse=True)
            keys, which = np.unique(i.astype(np.int64) * len(right) + j, return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, which, count)
            frequent = np.flatnonzero(times >= least)
            ids = np.zeros(len(keys), np.int64)
            ids[frequent] = (bucket << 32) + 1 + np.arange(len(frequent))
            for at in range(0, len(frequent), 10_000):
                own = frequent[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(left[keys[own] // len(right)]), pa.array(right[keys[own] % len(right)]), pa.array(times[own]), *(pa.nulls(len(own), f.type) for f in list(schema)[4:])], schema=schema)
            kept = np.flatnonzero(ids[which] > 0)
            for own in np.split(kept, np.flatnonzero(np.diff(owner[kept])) + 1) if len(kept) else ():
                yield pa.RecordBatch.from_pylist([{"part": parts[owner[own[0]]], "level": level, "numbers": packed(number[own]), "ids": packed(ids[which[own]])}], schema)

        for bucket, rows in _by_bucket(batches):
            yield from named(bucket, [r["part"] for r in rows], [r["entries"] for r in rows])
            trim()

    return run


def levels(code: DataFrame, least: int, most_words: int) -> list[DataFrame]:
    """Names of each level: (id, lang, word, times) of words, then (id, a, b, times) of pairs of names of the level before."""
    spark = code.sparkSession
    size, total = code.agg(F.sum("size"), F.sum("n")).first()  # words of the parts' dictionaries; all words, and so no fewer than pairs
    size, total = size or 0, total or 0
    with small_batches(spark, 200, "4m"):
        dealt = code.where("words IS NOT NULL").select("part", "lang", "words", "numbers", "times").mapInArrow(_words(1 + size // DISTINCT), WORDS)
        named = materialise(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_name_words(least), f"lang string, word string, {NAMED}"), "named")
    out = [named.where("part IS NULL").select("id", "lang", "word", "times")]
    ids = named.where("part IS NOT NULL").select("part", "level", "numbers", "ids")
    flats = code.where("at IS NOT NULL").select("part", "at", F.lit(None).cast("int").alias("level"), "numbers", F.lit(None).cast("binary").alias("ids"))
    for k in range(2, most_words + 1):
        rows = flats.unionByName(ids.select("part", F.lit(None).cast("int").alias("at"), "level", "numbers", "ids"))
        with small_batches(spark, 200, "4m"):
            made = rows.repartition("part").sortWithinPartitions("part").mapInArrow(_pairs(k, 1 + total // BUCKET), PAIRS)
            named = materialise(made.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_name(k, least), NAMED), "named")
        out.append(named.where("part IS NULL").select("id", "a", "b", "times"))
        ids = ids.unionByName(named.where("part IS NOT NULL").select("part", "level", "numbers", "ids"))
    return out


def phrases(names: list[DataFrame]) -> list[DataFrame]:
    """For each level the phrases with what their pointers lead to: (id, a, b, lang, phrase, times, heads, tails), where heads has the counts of the first 1, 2, .. words, tails those of the rest behind them."""
    none = F.array().cast("array<long>")
    out = [names[0].select("id", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "lang", F.col("word").alias("phrase"), "times", none.alias("heads"), none.alias("tails"))]
    for level in names[1:]:
        left = out[-1].select(F.col("id").alias("a"), "lang", F.col("phrase").alias("start"), F.concat("heads", F.array("times")).alias("heads"))
        right = out[-1].select(F.col("id").alias("b"), F.substring_index("phrase", " ", -1).alias("final"), F.concat(F.array("times"), "tails").alias("tails"))
        both = level.join(left, "a").join(right, "b")
        out.append(both.select("id", "a", "b", "lang", F.concat_ws(" ", "start", "final").alias("phrase"), "times", "heads", "tails"))
    return out


def collocations(docs: DataFrame, least: int = 10, most_words: int = 3, share: int = 50, first: int = 2000) -> DataFrame:
    """Each language's first phrases of 2 to ``most_words`` words by score: (lang, rank, phrase, a, l, r, n, score)."""
    code = coded(docs)
    known = phrases(levels(code, least, most_words))
    held = []
    for at, level in enumerate(known[1:], 1):
        if at + 1 < len(known):
            longer = known[at + 1].select(F.explode(F.array("a", "b")).alias("id"), "times").groupBy("id").agg(F.max("times").alias("longer"))
            level = level.join(longer, "id", "left").where(f"longer IS NULL OR CAST(100 AS DECIMAL(20)) * longer < CAST({share} AS DECIMAL(20)) * times")
        held.append(level.select("lang", "phrase", F.col("times").alias("a"), "heads", "tails"))
    cut = F.transform("heads", lambda h, i: F.struct(_score(F.col("a"), h, F.col("tails")[i]).alias("score"), i.alias("k"), h.alias("l"), F.col("tails")[i].alias("r")))
    scored = reduce(DataFrame.unionByName, held).withColumn("cut", F.array_min(cut)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    top = _first(scored, first)
    totals = code.where("words IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _first(scored: DataFrame, first: int) -> DataFrame:
    """Each language's first rows with their rank: the first of each of ``SALTS`` shares of its phrases, then of these, so that no task reads more than ``SALTS * first`` rows of a language."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits: exact while counts have at most 15 digits; the result fits a long, as a is at most l and r."""
    wide = [c.cast("decimal(15,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide[0] * wide[0]), wide[1] * wide[2])
