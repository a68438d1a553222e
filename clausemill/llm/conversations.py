"""Conversation repair by composition of weighted transducers (operator 12).

The input acceptor of a conversation has one symbol a row: the row's role initial and its
fault.  The edit transducer keeps, reroles or deletes a symbol and inserts roles; the role
grammar accepts ``(s?(ua)+)?``.  Their composition is expanded lazily, state by state in
topological order (rows read, then insertions since the last row), and each state holds the
least weight that reaches it: cost first, then the string of edit labels.

Two paths of equal cost over the same rows are never prefixes of one another: both have one
label a row, so the longer one would hold more insertions, which cost.  Hence the order of two
such strings is settled by a letter that both have, weights multiply and compare alike from
either side, and the paths of a long conversation may be composed in any grouping: each block
of rows gives a matrix of weights from grammar state to grammar state, and matrices multiply.

Rows are dealt by ranges of (conv_id, turn, role, text) and sorted, so a task holds whole
conversations in order, and settles them.  Those at either end of a task, and those of over
``LONG`` rows, are open: their rows are written, duplicates are found by an aggregation, chunks
are multiplied, one row a chunk meets in one task, and the repaired text is assembled by chunk.
Only the digest of such a text, which is sequential by nature, reads it in one task, in pieces
of ``PIECE`` bytes and without holding it; and its audit, a single string by contract, is held.

Null texts and roles are one space, as are null ids and turns where they are hashed.  Rows of one
turn stand by role, then text (its first 64 characters, then its SHA-256).  Equal rows are
duplicates of the first.  All rows of a null conv_id are one conversation.  An empty table gives
an empty result.  Only the four columns are read, so further columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import materialise

SPACES = " \t\n\x0b\x0c\r"
#: Rows of a conversation that a task settles itself, rows of a block, bytes of a piece of repaired text.
LONG, BLOCK, PIECE = 5_000, 32, 1_000_000

#: The role grammar: state and role initial give the next state; 0 and 3 accept.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
#: Costs of the edits; a truncated row that stays costs INSERT more.
REROLE, DELETE, INSERT = 1, 2, 5
LEGAL = ("su", "ua", "au")

Weight = tuple[int, str, tuple[int, ...]]


def edits(symbol: str) -> Iterator[tuple[str, str, int]]:
    """Arcs of the edit transducer for one row: (role initial or '', label, cost). Symbols: s u a o as the row stands, S U A O if truncated, x if it must go."""
    yield "", "D", DELETE
    if symbol != "x":
        more = INSERT if symbol.isupper() else 0
        yield symbol.lower(), "K", more
        for role in NAMES:
            yield role, "R", REROLE + more


@lru_cache(maxsize=1 << 16)
def block(symbols: str, start: int) -> dict[int, tuple[int, str]]:
    """Least weights from grammar state ``start`` over the rows to each state right after the last row."""
    front = {start: (0, "")}
    for symbol in symbols:
        front = _step(_inserted(front), symbol)
    return front


def _inserted(front: dict[int, tuple[int, str]]) -> list[tuple[int, tuple[int, str]]]:
    """States between two rows, by the number of insertions; a third one would close a cycle of positive cost."""
    layers, layer = list(front.items()), list(front.items())
    for _ in range(2):
        layer = [(to, (cost + INSERT, done + "I")) for state, (cost, done) in layer for role in NAMES if (to := GRAMMAR.get((state, role))) is not None]
        layers += layer
    return layers


def _step(states: list[tuple[int, tuple[int, str]]], symbol: str) -> dict[int, tuple[int, str]]:
    out: dict[int, tuple[int, str]] = {}
    for state, (cost, done) in states:
        for role, label, price in edits(symbol):
            to = GRAMMAR.get((state, role)) if role else state
            if to is not None and (to not in out or (cost + price, done + label) < out[to]):
                out[to] = (cost + price, done + label)
    return out


def matrix(symbols: str) -> dict[int, dict[int, Weight]]:
    """Weights from each grammar state to each other over all rows, by blocks."""
    parts = [{q: {to: (*w, (to,)) for to, w in block(symbols[i : i + BLOCK], q).items()} for q in range(4)} for i in range(0, max(1, len(symbols)), BLOCK)]
    return product(parts, inner=False)


def product(parts: list[dict], inner: bool = True) -> dict[int, dict[int, Weight]]:
    """The product of matrices in order, pairwise, so that strings are copied as often as the number of parts has bits; ``inner`` keeps the states between the parts."""
    while len(parts) > 1:
        parts = [_times(parts[i], parts[i + 1], inner) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _times(a: dict, b: dict, inner: bool) -> dict:
    out: dict = {}
    for q, row in a.items():
        best: dict[int, Weight] = {}
        for mid, (c1, s1, p1) in row.items():
            for to, (c2, s2, p2) in b.get(mid, {}).items():
                if to not in best or c1 + c2 <= best[to][0]:
                    w = (c1 + c2, s1 + s2, p1 + p2 if inner else p2)
                    if to not in best or w < best[to]:
                        best[to] = w
        out[q] = best
    return out


def closed(row: dict[int, Weight]) -> tuple[int, str, tuple[int, ...]]:
    """The least weight of a whole sequence: insertions at its end reach an accepting state. The states are those before these insertions."""
    ends = [(cost, done, tuple(row[q][2])) for q in row for state, (cost, done) in _inserted({q: row[q][:2]}) if state in FINAL]
    return min(ends, key=lambda w: w[:2])


def audit(symbols: str) -> tuple[int, str]:
    """Cost and labels of the cheapest repair."""
    return closed(matrix(symbols)[0])[:2]


def repaired(rows: list[tuple[str, str]], labels: str, state: int = 0) -> list[str]:
    """The ``role:text`` items that the labels make of the rows (role, text)."""
    out, at = [], 0
    for label in labels:
        role, text = rows[at] if label != "I" else ("", "")
        at += label != "I"
        if label == "D":
            continue
        if label != "K":
            role = NAMES["a" if state == 2 else "u"]
        state = GRAMMAR[state, role[0]]
        out.append(f"{role}:{text}")
    return out


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


def fault(text: str) -> str:
    """'b' blank, 't' truncated, '' neither."""
    held = text.rstrip(SPACES)
    return "b" if not held else "" if held[-1] in ".!?" else "t"


class Tally:
    """What is counted over the rows of a conversation in order."""

    def __init__(self) -> None:
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_role = self.last_role = None
        self.symbols: list[str] = []

    def add(self, turn: int | None, role: str, what: str, again: bool) -> None:
        """One row: its turn, role initial, fault, and whether an earlier row equals it."""
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.last
            self.high = self.last = turn
        if self.last_role is None:
            self.first_role = role
        else:
            self.illegal += self.last_role + role not in LEGAL
        self.last_role = role
        if what == "b":
            self.blank += 1
            self.symbols.append("x")
        elif again:
            self.duplicate += 1
            self.symbols.append("x")
        else:
            self.truncated += what == "t"
            self.symbols.append(role.upper() if what == "t" else role)

    def chunk(self) -> dict:
        return {k: getattr(self, k) for k in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role")} | {"rows": len(self.symbols)}


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def damaged(rows: DataFrame) -> DataFrame:
    """The rows as the damage leaves them, and those that it drops with ``gone``; hashes decide, so any run damages alike."""
    space = F.lit(" ")
    code = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")), F.lit(20))
    own = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), code.alias("code"))
    text = F.when(F.col("code") < 2, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return own.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows``, which are taken as they are; rows with ``gone`` only name their conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    keyed = rows.select("*", F.substring("text", 1, 64).alias("head"), F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("n"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest"), F.col("n")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", "digest", F.monotonically_increasing_id().alias("at"))
    numbers = ", ".join(f"{x} long" for x in RESULT)
    first = materialise(dealt.mapInArrow(_settle, f"conv_id {kind}, {numbers}, audit string, repaired_sha256 string, part long, at long, turn long, role string, text string, gone boolean, digest string, what string"), "settled")
    settled = first.where("part IS NULL").select("conv_id", *RESULT, "audit", "repaired_sha256")
    rest = first.where("part IS NOT NULL")
    earliest = rest.where("NOT gone").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    told = rest.select("conv_id", "part", "at", "turn", F.substring("role", 1, 1).alias("role"), "gone", "what").join(earliest, "at", "left")  # unique on both sides
    chunks = told.repartition("part").sortWithinPartitions("at").mapInArrow(_summaries, f"conv_id {kind}, part long, at long, last long, told string")
    merged = materialise(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_merge, f"conv_id {kind}, part long, at long, state int, labels string, {numbers}, audit string"), "merged")
    lines = rest.where("NOT gone").select("conv_id", "part", "at", F.lit(1).alias("step"), "role", "text", F.lit(0).alias("state"), F.lit("").alias("labels"))
    plans = merged.where("part IS NOT NULL").select("conv_id", "part", "at", F.when(F.col("state") < 0, 2).otherwise(0).alias("step"), F.lit("").alias("role"), F.lit("").alias("text"), "state", "labels")
    pieces = lines.unionByName(plans).repartition("part").sortWithinPartitions("at", "step").mapInArrow(_pieces, f"conv_id {kind}, at long, piece binary")
    none = [F.lit(None).cast("long").alias(x) for x in RESULT]
    heads = merged.where("part IS NULL").select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("binary").alias("piece"), *RESULT, "audit")
    stream = heads.unionByName(pieces.select("conv_id", "at", "piece", *none, F.lit(None).cast("string").alias("audit")))
    hashed = stream.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_hash, f"conv_id {kind}, {numbers}, audit string, repaired_sha256 string")
    return settled.unionByName(hashed)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _out(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and bytes; ``text`` is the column that may be long."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text] or "")
        if len(held) >= 2_000 or size > 2_000_000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _with(batches: Iterator[pa.RecordBatch], run: Callable, fields: list[tuple[str, pa.DataType]], text: int) -> Iterator[pa.RecordBatch]:
    """Runs ``run`` over the rows of all batches; the type of conv_id is that of the first batch."""
    first = next(batches, None)
    if first is not None:
        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *fields])

        def both():
            yield first
            yield from batches

        yield from _out(run(_rows(both())), schema, text)


_NUMBERS = [(x, pa.int64()) for x in RESULT]


def _settle(batches):
    """Conversations that lie inside this task; rows of the others (the first, the last, long ones) pass with their order."""

    def whole(rows: list[tuple]) -> tuple:
        tally, seen, kept = Tally(), set(), []
        for _, turn, role, text, gone, digest, _ in rows:
            if not gone:
                tally.add(turn, initial(role), fault(text), (role, digest) in seen)
                seen.add((role, digest))
                kept.append((role, text))
        cost, labels = audit("".join(tally.symbols))
        told = hashlib.sha256("\n".join(repaired(kept, labels)).encode("utf-8", "surrogatepass")).hexdigest()
        return (rows[0][0], gaps(tally.low, tally.high, tally.turns), tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, labels, told, *[None] * 8)

    def passed(row: tuple) -> tuple:
        conv, turn, role, text, gone, digest, at = row
        return (conv, *[None] * 8, at >> 33, at, turn, role, text, gone, digest, "" if gone else fault(text))

    def run(rows):
        held, is_open, size = [], True, 0  # the first conversation may have begun in another task
        for row in rows:
            if held and held[-1][0] != row[0]:
                if not is_open:
                    yield whole(held)
                held, is_open, size = [], False, 0
            held.append(row)
            size += len(row[3])
            if not is_open and (len(held) > LONG or size > 4 * PIECE):
                is_open = True
                yield from map(passed, held)
            elif is_open:
                yield passed(row)
            if is_open:
                held = held[-1:]
        if held and not is_open:
            yield from map(passed, held)

    fields = [*_NUMBERS, ("audit", pa.string()), ("repaired_sha256", pa.string()), *((x, pa.int64()) for x in ("part", "at", "turn")), ("role", pa.string()), ("text", pa.string()), ("gone", pa.bool_()), ("digest", pa.string()), ("what", pa.string())]
    return _with(batches, run, fields, 13)


def _summaries(batches):
    """One row for every conversation's rows of one part: what is counted, and the matrix of weights."""

    def run(rows):
        key, tally, first, last = None, Tally(), 0, 0

        def told():
            return (key[1], key[0], first, last, json.dumps(tally.chunk() | {"matrix": {q: {to: w[:2] for to, w in row.items()} for q, row in matrix("".join(tally.symbols)).items()}}))

        for at, conv, part, turn, role, gone, what, new in rows:
            if key != (part, conv):
                if key:
                    yield told()
                key, tally, first = (part, conv), Tally(), at
            last = at
            if not gone:
                tally.add(turn, initial(role), what, not new)
        if key:
            yield told()

    return _with(batches, run, [("part", pa.int64()), ("at", pa.int64()), ("last", pa.int64()), ("told", pa.string())], 4)


def _merge(batches):
    """The result of each conversation from its chunks in order, and for each chunk its labels and the grammar state before it."""

    def merged(chunks: list[tuple]) -> Iterator[tuple]:
        told = [json.loads(c[4]) for c in chunks]
        weights = product([{int(q): {int(to): (*w, (int(to),)) for to, w in row.items()} for q, row in t.pop("matrix").items()} for t in told])
        cost, labels, states = closed(weights[0])
        own, before = [t for t in told if t["rows"]], [t for t in told if t["low"] is not None]
        turns = sum(t["turns"] for t in before) - sum(a["high"] == b["low"] for a, b in zip(before, before[1:], strict=False))
        illegal = sum(t["illegal"] for t in told) + sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(own, own[1:], strict=False))
        missing = gaps(before[0]["low"], before[-1]["high"], turns) if before else 0
        conv = chunks[0][0]
        yield (conv, None, None, None, None, missing, *(sum(t[x] for t in told) for x in ("blank", "duplicate", "truncated")), illegal, cost, labels)
        at, state = 0, 0
        for chunk, t, after in zip(chunks, told, states, strict=True):
            start, left = at, t["rows"]
            while left:
                left -= labels[at] != "I"
                at += 1
            yield (conv, chunk[1], chunk[2], state, labels[start:at], *[None] * 7)
            state = after
        if at < len(labels):  # insertions behind the last row, marked by a negative state
            yield (conv, chunks[-1][1], chunks[-1][3], -1 - state, labels[at:], *[None] * 7)

    def run(rows):
        held: list[tuple] = []
        for row in rows:
            if held and held[0][0] != row[0]:
                yield from merged(held)
                held = []
            held.append(row)
        if held:
            yield from merged(held)

    return _with(batches, run, [("part", pa.int64()), ("at", pa.int64()), ("state", pa.int32()), ("labels", pa.string()), *_NUMBERS, ("audit", pa.string())], 4)


def _pieces(batches):
    """The repaired text of each chunk, in pieces of items joined by newlines."""

    def run(rows):
        labels, at, state, items, size, begun, whose = "", 0, 0, [], 0, 0, None

        def piece():
            return (whose, begun, "\n".join(items).encode("utf-8", "surrogatepass"))

        for conv, _, order, step, role, text, start, own in rows:
            if step != 1:
                if items:
                    yield piece()
                    items, size = [], 0
                labels, at, state, whose, begun = own, 0, start if step == 0 else -1 - start, conv, order
                if step == 2:  # nothing follows: all labels are insertions
                    items, begun = repaired([], labels, state), order + 1  # behind the piece that may begin with the last row
                    continue
            if step == 1:
                to = at
                while labels[to] == "I":
                    to += 1
                made = repaired([(role, text)], labels[at : to + 1], state)
                for item in made:
                    state = GRAMMAR[state, item[0]]
                at = to + 1
                if made and not items:
                    begun = order
                items += made
                size += sum(map(len, made))
                if size > PIECE:
                    yield piece()
                    items, size = [], 0
        if items:
            yield piece()

    return _with(batches, run, [("at", pa.int64()), ("piece", pa.binary())], 2)


def _hash(batches):
    """The digest of each conversation's pieces, read in order and not held."""

    def run(rows):
        head, digest, begun = None, None, False
        for row in rows:
            if row[2] is None:  # the row with the counts comes first
                if head:
                    yield (head[0], *head[3:], digest.hexdigest())
                head, digest, begun = row, hashlib.sha256(), False
            else:
                digest.update(b"\n" * begun + row[2])
                begun = True
        if head:
            yield (head[0], *head[3:], digest.hexdigest())

    return _with(batches, run, [*_NUMBERS, ("audit", pa.string()), ("repaired_sha256", pa.string())], 7)
