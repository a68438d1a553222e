"""Phrases of a lexicon in texts, all in one pass: an Aho-Corasick automaton in arrays.

States and transitions are numbers in one dense table, failure links are folded into it.  Texts of
a batch are cut into segments, which overlap by the longest phrase less one byte, and all of them
step through the table together, a byte at a time; so the time follows the bytes of the texts and
not the number of phrases.  Bytes of UTF-8 are matched; a phrase is found where ``contains`` finds it.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a segment besides its overlap.
SEGMENT = 512


class Automaton:
    """Over the phrases in the order given; empty ones are found in every text."""

    def __init__(self, phrases: list[str]):
        encoded = [p.encode() for p in phrases]
        self.longest = max(map(len, encoded), default=0)
        self.always = np.array([i for i, p in enumerate(encoded) if not p], np.int32)
        alphabet = sorted({b for p in encoded for b in p})
        self.symbol = np.zeros(256, np.int32)  # 0: a byte of no phrase
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        rows: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for i, p in enumerate(encoded):
            at = 0
            for s in self.symbol[list(p)].tolist():
                if s not in rows[at]:
                    rows[at][s] = len(rows)
                    rows.append({})
                    ends.append([])
                at = rows[at][s]
            if p:
                ends[at].append(i)
        self.next = np.zeros((len(rows), self.width), np.int32)
        fails, queue = [0] * len(rows), deque([0])
        while queue:
            at = queue.popleft()
            if at:
                self.next[at] = self.next[fails[at]]
                ends[at] = ends[at] + ends[fails[at]]
            for s, to in rows[at].items():
                fails[to] = int(self.next[fails[at], s]) if at else 0
                queue.append(to)
            for s, to in rows[at].items():
                self.next[at, s] = to
        self.ends = np.array([bool(e) for e in ends])
        self.first = np.concatenate([[0], np.cumsum([len(e) for e in ends])])
        self.found = np.array([i for e in ends for i in e], np.int32)

    def __call__(self, texts: pa.Array) -> pa.Array:
        """For each text the numbers of the phrases that it contains, rising; none for a null."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        size = np.diff(offsets)
        if texts.null_count:
            size = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, size)
        row = np.repeat(np.arange(len(size)), -(-size // SEGMENT))  # of each segment
        place = (np.arange(len(row)) - np.concatenate([[0], np.cumsum(-(-size // SEGMENT))])[row]) * SEGMENT
        back = np.minimum(place, max(0, self.longest - 1))
        start = offsets[:-1][row] + place - back
        length = np.minimum(size[row] - place, SEGMENT) + back
        order = np.argsort(-length, kind="stable")
        row, start, length = row[order], start[order], length[order]
        state, hits = np.zeros(len(row), np.int64), []
        table, active = self.next.ravel(), len(row)
        for step in range(int(length[0]) if len(row) else 0):
            while length[active - 1] <= step:
                active = int(np.searchsorted(-length, -step, "left"))
            state = table[state[:active] * self.width + self.symbol[data[start[:active] + step]]].astype(np.int64)
            ended = np.flatnonzero(self.ends[state])
            if len(ended):
                hits.append(row[ended] * len(self.ends) + state[ended])
        pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        owner, state = pairs // len(self.ends), pairs % len(self.ends)
        count = self.first[state + 1] - self.first[state]
        within = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else count, count)
        n = max(1, len(self.found) + len(self.always))
        keys = np.repeat(owner, count) * n + self.found[np.repeat(self.first[state], count) + within]
        if len(self.always):
            known = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            keys = np.concatenate([keys, (known[:, None] * n + self.always).ravel()])
        keys = np.unique(keys)
        ends = np.concatenate([[0], np.cumsum(np.bincount(keys // n, minlength=len(size)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys % n, pa.int32()))


def hits(text: Column, phrases: list[str]) -> Column:
    """An array of the numbers of the phrases that each text contains; empty for null."""
    if len(set(phrases)) != len(phrases):
        raise ValueError("phrases must differ")
    automaton = Automaton(phrases)

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        return automaton(texts)

    return found(text)


def largest(found: Column, phrases: list[str], words: dict[str, float]) -> Column:
    """The largest weight in ``words`` of the phrases found; null where none of them has one."""
    return F.array_max(_weights(found, phrases, words))


def smallest(found: Column, phrases: list[str], words: dict[str, float]) -> Column:
    return F.array_min(_weights(found, phrases, words))


def _weights(found: Column, phrases: list[str], words: dict[str, float]) -> Column:
    table = F.array(*(F.lit(words.get(p)).cast("double") for p in phrases))
    return F.transform(found, lambda i: F.get(table, i))
