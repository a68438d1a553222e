"""Quality rules in a short-circuit cascade (operator 2).

Each rule rejects a document or lets it pass; a document is kept when no rule
rejects it, so the verdict does not depend on the order.  The order decides the
cost: on a sample of some hundred rows every rule is timed and its rejections are counted, and
the rules run by rejections per second, each only on what earlier rules let pass.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``.  Null and empty texts have no words
and are rejected.  Rows that repeat are judged each for itself; an empty table gives an empty result;
further columns, whatever their names, are kept by ``keep`` and ignored by ``measure``.  Work is
row-local; there is no shuffle.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import steps

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, SPACES))


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : n + i] for i in range(WINDOW)), strict=True))
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    if len(seen) == n:
        return 0
    twice = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : n + i] |= twice
    return int(covered.sum())


def stutters(words: list[bytes]) -> int:
    """Words that equal the word before."""
    return sum(map(bytes.__eq__, words, words[1:]))


def may_repeat(rows: list[list[bytes]]) -> list[bool]:
    """For each word list, False if no window of five words occurs twice in it (by 64-bit hashes of all rows at once)."""
    table: dict[bytes, int] = {}
    flat = np.fromiter((table.setdefault(w, len(table)) for row in rows for w in row), np.uint64, sum(map(len, rows)))
    owner = np.repeat(np.arange(len(rows), dtype=np.uint64), [len(r) for r in rows])
    n = len(flat) - WINDOW + 1
    out = np.zeros(len(rows), bool)
    if n > 1:
        h = owner[:n] + np.uint64(1)
        for i in range(WINDOW):
            h = (h ^ flat[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = owner[:n] == owner[WINDOW - 1 :]
        own = owner[:n][whole]
        order = np.argsort(h[whole])
        same = h[whole][order]
        out[own[order[1:][same[1:] == same[:-1]]].astype(np.int64)] = True
    return out.tolist()


class Document:
    """A text whose words and measures are computed once, when a rule first asks for them."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def symbols(self) -> int:
        return symbols(self.text)

    @cached_property
    def duplicate_lines(self) -> int:
        return duplicate_lines(self.text)

    @cached_property
    def repeated_words(self) -> int:
        return repeated_words(self.words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


def _capitals(d: Document) -> bool:
    upper = sum(map(str.isupper, d.text))
    return 2 * upper > sum(map(str.isalpha, d.text))


def rules(min_words: int = 10, repeat_percent: int = 20, symbol_percent: int = 10, duplicate_line_percent: int = 50, stutter_percent: int = 30) -> tuple[Rule, ...]:
    """The production rules; shares are per hundred words, lines or letters."""
    return (
        Rule("few_words", lambda d: len(d.words) < min_words),
        Rule("repeated_windows", lambda d: 100 * d.repeated_words > repeat_percent * len(d.words)),
        Rule("symbols", lambda d: 100 * d.symbols > symbol_percent * len(d.words)),
        Rule("duplicate_lines", lambda d: 100 * d.duplicate_lines > duplicate_line_percent * (d.text.count("\n") + 1)),
        Rule("capitals", _capitals),
        Rule("stutter", lambda d: 100 * stutters(d.words) > stutter_percent * len(d.words)),
    )


def plan(docs: DataFrame, ruleset: tuple[Rule, ...], sample_rows: int = 400) -> tuple[Rule, ...]:
    """The rules by rejections per second on about ``sample_rows`` rows, chosen by a hash and measured on an executor."""

    def run(batches):
        texts = [t for b in batches for t in b.column("text").to_pylist()]
        names, spent, rejected = [], [], []
        for rule in ruleset:
            own = [Document(t) for t in texts]
            for d in own:
                d.words  # noqa: B018  splitting is shared, so no rule is charged with it
            begun = time.perf_counter()
            rejected.append(sum(rule.rejects(d) for d in own))
            spent.append(time.perf_counter() - begun)
            names.append(rule.name)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(spent), pa.array(rejected, pa.int64())], ["name", "seconds", "rejected"])

    # the share follows from the number of rows, so that every task sends its part of the sample and no more
    share = int(1_000_000_000 * min(1.0, sample_rows / max(1, docs.count())))
    sample = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)) < share).select("text").limit(2 * sample_rows)
    gain = {r.name: r.rejected / max(r.seconds, 1e-6) for r in sample.coalesce(1).mapInArrow(run, "name string, seconds double, rejected long").collect()}
    return tuple(sorted(ruleset, key=lambda r: -gain.get(r.name, 0.0)))


def keep(docs: DataFrame, ordered: tuple[Rule, ...]) -> DataFrame:
    """The rows that no rule rejects, with all their columns; rules run in the order given and stop at the first rejection."""

    def run(batches):
        for batch in steps(batches):
            own = [not any(r.rejects(d) for r in ordered) for d in map(Document, batch.column("text").to_pylist())]
            yield batch.filter(pa.array(own, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def measure(docs: DataFrame, ordered: tuple[Rule, ...], min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """Base measures of every row, whether the base rules fail it, and the cascade's verdict.

    The cascade is that of ``keep``: all rules, in the order given, up to the first
    rejection.  Measures that the row returns anyhow are computed once for both.
    """

    def run(batches):
        for batch in steps(batches):
            own = [Document(t) for t in batch.column("text").to_pylist()]
            for d, maybe in zip(own, may_repeat([d.words for d in own]), strict=True):
                if not maybe:
                    d.repeated_words = 0
            kept = [not any(r.rejects(d) for r in ordered) for d in own]
            n = [len(d.words) for d in own]
            failed = [k < min_words or 100 * d.repeated_words > repeat_percent * k for k, d in zip(n, own, strict=True)]
            kept = [k and not f for k, f in zip(kept, failed, strict=True)]
            cols = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, [word_chars(d.text) for d in own], [d.symbols for d in own], [d.duplicate_lines for d in own], [d.repeated_words for d in own])), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in MEASURES.split(", ")])

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, MEASURES)
