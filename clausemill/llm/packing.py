"""Packing of documents into token windows by Karmarkar-Karp differencing (operator 1).

Documents are tokenised where they are read.  Per block of about ``block_windows``
windows, a task cuts full windows out of long documents and distributes what is left
by multiway differencing: the two partial partitions with the widest spread are
merged again and again, the heaviest slot of one with the lightest slot of the
other, until one partition with near-equal windows is left.  A share of the
documents is cut into small fillers first, so that windows come out nearly full.
When a window exceeds the capacity, the window count rises and the block is dealt
anew.  Ids beyond a block's full windows go to the next block; those of a task's last
block form sequences whose lengths are powers of two, which need no padding.

Null texts count as empty and are their end id alone; rows that repeat, or share a doc_id, are packed
each for itself; an empty table gives an empty result.  Only doc_id and text are read, so further
columns do not matter.  No shuffle, and no state beyond a block; results are the same for the same input
partition, so lost tasks can be run again.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from clausemill.llm.bpe import encoder, segments
from clausemill.llm.common import steps

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Items of each of k windows: multiway largest differencing."""
    if not sizes:
        return [[] for _ in range(k)]
    n = len(sizes)
    heap = []
    for i in sorted(range(n), key=lambda i: -sizes[i]):
        heap.append((-sizes[i], i, None, None))
    heapq.heapify(heap)
    parts: list[tuple[int, int]] = []  # node n + j joins these two nodes
    tick = n

    def slots(entry):
        spread, i, loads, nodes = entry
        if loads is None:
            loads, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
            loads[0], nodes[0] = -spread, i
        return loads, nodes

    while len(heap) > 1:
        a, an = slots(heapq.heappop(heap))
        b, bn = slots(heapq.heappop(heap))
        loads, bn = a + b[::-1], bn[::-1]
        both = np.flatnonzero((an >= 0) & (bn >= 0))
        nodes = np.maximum(an, bn)
        if len(both):
            nodes[both] = n + len(parts) + np.arange(len(both))
            parts += zip(an[both].tolist(), bn[both].tolist(), strict=True)
        order = np.argsort(-loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        heapq.heappush(heap, (int(loads[-1] - loads[0]), tick, loads, nodes))
        tick += 1
    _, nodes = slots(heap[0])
    out = []
    for node in nodes.tolist():
        items, todo = [], [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo += parts[x - n]
        out.append(items)
    return out


def powers(n: int) -> list[int]:
    """n as a sum of powers of two, the largest first."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


Piece = tuple[int, int, int]  # document, start, length


def take(pieces: list[Piece], size: int) -> list[Piece]:
    """Removes ``size`` ids from the end of the pieces, cutting one if need be."""
    out: list[Piece] = []
    while size and pieces:
        d, s, n = pieces.pop()
        own = min(n, size)
        out.append((d, s + n - own, own))
        size -= own
        if own < n:
            pieces.append((d, s, n - own))
    return out[::-1]


def pack_block(pieces: list[Piece], capacity: int, last: bool = True, filler_share: float = 0.08, filler: int = 24, slack: float = 0.002) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences as lists of pieces, and the pieces that are left for the next block (none after the last)."""
    out: list[list[Piece]] = []
    rest: list[Piece] = []
    for d, s, n in pieces:
        full = n - n % capacity
        out += [[(d, a, capacity)] for a in range(s, s + full, capacity)]
        if n > full:
            rest.append((d, s + full, n - full))
    rest.sort(key=lambda x: (-x[2], x[0], x[1]))
    total = sum(x[2] for x in rest)
    k = int(total // (capacity * (1 - slack)))
    tail = take(rest, total - int(k * capacity * (1 - slack)))
    cut = take(rest, int(filler_share * total)) if k > 1 else []
    items = rest + [(d, a, min(filler, s + n - a)) for d, s, n in cut for a in range(s, s + n, filler)]
    while items:
        windows = karmarkar_karp([x[2] for x in items], k)
        if all(sum(items[i][2] for i in w) <= capacity for w in windows):
            out += [[items[i] for i in sorted(w)] for w in windows if w]
            break
        k += 1
    if not last:
        return out, tail
    for size in reversed(powers(sum(x[2] for x in tail))):
        out.append(take(tail, size))
    return out, []


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, block_windows: int = 128) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id alone; rows that share a doc_id
    are packed each for itself; an empty table gives no rows.  ``sequence_id`` holds
    the input partition in its upper bits.
    """

    def run(batches):
        e = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 36
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        pieces: list[Piece] = []
        size = 0

        def flush(last):
            nonlocal sequence, ids, names, pieces, size
            cols: list[list] = [[] for _ in range(7)]
            done, left = pack_block(pieces, capacity, last)
            for own in done:
                offset = 0
                for d, s, n in own:
                    row = (names[d], s, n, zlib.crc32(ids[d][s : s + n].tobytes()), len(ids[d]), sequence, offset)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                    offset += n
                sequence += 1
            kept = sorted({d for d, _, _ in left})
            new = {d: i for i, d in enumerate(kept)}
            ids, names, pieces = [ids[d] for d in kept], [names[d] for d in kept], [(new[d], s, n) for d, s, n in left]
            size = sum(n for _, _, n in pieces)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in PIECES.split(", ")])

        for batch in steps(batches):
            flat, counts = e.encode(batch.column("text").to_pylist())
            ends = segments(counts)
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                pieces.append((len(ids), 0, int(counts[k]) + 1))
                ids.append(np.append(flat[ends[k] : ends[k + 1]], end_id).astype("<u4"))
                names.append(doc)
                size += len(ids[-1])
                if size >= block_windows * capacity:
                    yield flush(False)
        if pieces:
            yield flush(True)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
