"""Operator 12: conversation repair against plain models."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from clausemill.llm import conversations as c

GOOD = re.compile("(s?(ua)+)?")
SYMBOLS = "suaoSUAOx"


def every_repair(symbols):
    """(cost, labels) of all edits with at most two insertions a gap that give a legal sequence of roles."""
    gaps = ["", "u", "a", "ua", "au"]
    for between in itertools.product(gaps, repeat=len(symbols) + 1):
        for acts in itertools.product(("K", "u", "a", "D"), repeat=len(symbols)):
            if any(a != "D" and x == "x" or a == "K" and x in "oO" for a, x in zip(acts, symbols, strict=True)):
                continue
            roles = labels = ""
            cost = 0
            for gap, act, x in itertools.zip_longest(between, acts, symbols, fillvalue=""):
                roles, labels, cost = roles + gap, labels + "I" * len(gap), cost + 5 * len(gap)
                if act:
                    roles += {"K": x.lower(), "D": ""}.get(act, act)
                    labels += act if act in "KD" else "R"
                    cost += {"K": 0, "D": 2}.get(act, 1) + 5 * (act != "D" and x in "SUAO")
            if GOOD.fullmatch(roles):
                yield cost, labels


def test_cheapest_repair_equals_enumeration():
    some = random.Random(3)
    cases = ["".join(x) for n in range(3) for x in itertools.product(SYMBOLS, repeat=n)]
    cases = cases[:10] + some.sample(cases[10:], 40) + ["".join(some.choices(SYMBOLS, k=3)) for _ in range(12)]
    for symbols in cases:
        assert c.audit(symbols) == min(every_repair(symbols)), symbols


def search(symbols):
    """Uniform-cost search over (cost, labels), another way to the same answer."""
    heap, done = [(0, "", 0, "")], set()
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    while True:
        cost, labels, at, last = heapq.heappop(heap)
        if at == len(symbols) and last in ("", "a"):
            return cost, labels
        if (at, last) in done:
            continue
        done.add((at, last))
        for role in follows[last]:
            if role != "s":
                heapq.heappush(heap, (cost + 5, labels + "I", at, role))
        if at < len(symbols):
            x = symbols[at]
            heapq.heappush(heap, (cost + 2, labels + "D", at + 1, last))
            for role in follows[last] if x != "x" else "":
                if role == x.lower():
                    heapq.heappush(heap, (cost + 5 * x.isupper(), labels + "K", at + 1, role))
                elif role != "s":
                    heapq.heappush(heap, (cost + 1 + 5 * x.isupper(), labels + "R", at + 1, role))


def test_blocks_multiply_to_the_whole():
    some = random.Random(5)
    for n in (0, 1, 31, 32, 33, 64, 65, 200, 777):
        for weights in ((1,) * 9, (1, 9, 9, 1, 1, 1, 1, 1, 1)):
            symbols = "".join(some.choices(SYMBOLS, weights, k=n))
            assert c.audit(symbols) == search(symbols)
            cuts = sorted(some.choices(range(n + 1), k=5))
            parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
            cost, labels, states = c.closed(c.product([{q: {to: (*w[:2], (to,)) for to, w in row.items()} for q, row in c.matrix(p).items()} for p in parts])[0])
            assert (cost, labels) == search(symbols) and len(states) == len(parts)


def plain(rows):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, digest), in plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        own, (role, text) = convs.setdefault(conv, []), (x if x is not None else " " for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        own += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, counts = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in own:
            held = re.sub("[\x20\x09-\x0d]", "", text)
            what = "b" if not held else "d" if (role, text) in seen else "" if held[-1] in ".!?" else "t"
            seen.add((role, text))
            x = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if what in ("b", "d") else x.upper() if what else x
            counts[what] = counts.get(what, 0) + 1
        turns = [t for t, _, _ in own if t is not None]
        cost, labels = search(symbols)
        texts, left, last = [], iter(own), ""
        for label in labels:
            _, role, text = next(left) if label != "I" else (0, "", "")
            if label == "D":
                continue
            if label != "K":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            texts.append(f"{role}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["b"], counts["d"], counts["t"], illegal, cost, labels, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def answer(rows):
    return {r[0]: tuple(r)[1:] for r in c.repair(c.damaged(rows)).collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_whole_table_equals_plain(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = answer(rows)
    assert got == plain(map(tuple, rows.collect())) and len({len(x[6]) for x in got.values()}) > 3


def test_nulls_ties_repeats_long_texts_and_hot_conversation(spark):
    some = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "sage", "üser"], ["Yes.", "no", "", " \t\n", None, "ok?\x0b ", "é!", "x" * 200_000, "a\nb."]
    rows = [(some.choice([None, *range(40)]), some.choice([None, *range(9)]), some.choice(roles), some.choice(texts[:7] + texts[8:])) for _ in range(900)]
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"{t} {'x' * 200_000}.") for t in range(30)]
    rows += [(7777, t // 2, some.choice(roles[:4]), some.choice([f"{t}.", f"{t}", "again.", ""])) for t in range(11_000)]  # spans all tasks
    rows += [(9999, 1, "user", "same.")] * 3_000
    some.shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("gone", "at", "part", "n", "head", "digest", "code", "copy", "labels"):
        table = table.withColumn(name, F.lit("mine"))
    got, want = answer(table), plain(rows)
    assert got.keys() == want.keys()
    assert [k for k in got if got[k] != want[k]] == []


def test_empty_table_and_dropped_conversations(spark):
    assert answer(spark.createDataFrame([], SCHEMA)) == {}
    dropped = next(i for i in range(1_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert answer(spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_number_of_tasks_does_not_matter(spark, parts):
    rows = [(i % 3, i, ("user", "assistant")[i // 3 % 2], f"{i}.") for i in range(400)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert answer(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
