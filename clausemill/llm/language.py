"""Language identification with language-bitmask n-gram filters (operator 8).

Every language keeps its most frequent letter n-grams (two to four characters, word
ends marked by a space), but for those that another language uses over three times
as often; so an n-gram may belong to several languages.  They go into one bit-sliced Bloom filter: an array of
bitmasks with one bit per language, so that the AND of an n-gram's few entries gives
all languages that have it.  A text's n-grams are counted per language; the counts
are corrected for the false positives that each language's fill implies, and the
largest decides.

The filter is fitted on a bounded sample of labelled rows (``sample_docs`` a
language, about) and holds ``top`` n-grams a language and length, so what a task
receives has a fixed size; a row of words holds 64 languages.  Null texts and texts
without letters are ``und`` with score 0; so is every text when nothing was learnt.  Of
languages with equal counts the first by name is predicted; a text with letters of which
no language has an n-gram gets the first by name with score 0.  Rows that share a doc_id
are predicted each by its own text, null ids are not held out and not learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from clausemill.llm.common import steps

LENGTHS = (2, 3, 4)
LOG_SIZE, PROBES = 18, 3
#: Floor of what a known language has of a text: deviations over the mean of false positives, and share of the n-grams.
#: Labelled rows of sf0.01 and sf0.1 have a share of 0.56 or more, held out or not.
NOISE, SHARE = 3.0, 0.05
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def _letters(codes: np.ndarray) -> np.ndarray:
    out = _LETTER[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        out[i] = chr(codes[i]).isalpha()
    return out


def grams(texts: list[str | None]):
    """(hashes, owners) of all n-grams of each length; words do not reach across texts."""
    # U+FFFF parts the texts; like every other non-letter it counts as a space
    codes = np.frombuffer(("￿" + "￿".join((t or "").lower().replace("￿", " ") for t in texts) + "￿").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(codes == 0xFFFF) - 1
    letter = _letters(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space after a word
    keep[0] = True
    codes, owner, letter = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
    for n in LENGTHS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        whole = np.ones(m, bool)
        for i in range(1, n - 1):
            whole &= letter[i : m + i]
        if n == 2:
            whole &= letter[:m] | letter[1:]
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = (h ^ codes[i : m + i]) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(32))[whole]
        first = np.where(letter[:m], owner[:m], owner[1 : m + 1])[whole]
        yield n, h, first


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    table: np.ndarray  # bitmasks; a row of words for every 64 languages
    false: np.ndarray  # false-positive rate of each language

    @staticmethod
    def build(languages: list[str], rows: list[tuple[int, int]]) -> Filters:
        """From (language number, n-gram hash) rows."""
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if np.dtype(k).itemsize * 8 >= len(languages)), np.uint64)
        table = np.zeros((max(1, -(-len(languages) // 64)), 1 << LOG_SIZE), kind)
        if rows:
            number = np.array([r[0] for r in rows], np.int64)
            h = np.array([r[1] for r in rows], np.int64).view(np.uint64)
            for at in probes(h):
                np.bitwise_or.at(table, (number // 64, at), (np.uint64(1) << (number % 64).astype(np.uint64)).astype(kind))
        fill = np.array([(table[i // 64] >> kind(i % 64) & kind(1)).mean() for i in range(len(languages))])
        return Filters(tuple(languages), table, fill**PROBES)

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and those found of each language."""
        n, kind = len(texts), self.table.dtype.type
        total, hits = np.zeros(n), np.zeros((n, len(self.languages)))
        for _, h, owner in grams(texts):
            total += np.bincount(owner, minlength=n)[:n]
            at = probes(h)
            for w, word in enumerate(self.table):
                mask = np.bitwise_and.reduce([word[x] for x in at])
                for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                    hits[:, i] += np.bincount(owner, mask >> kind(i % 64) & kind(1), minlength=n)[:n]
        return total, hits

    def unknown(self, total: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Whether a text has no more of any language than false positives, or a trace, explain (``NOISE``, ``SHARE``)."""
        mean = total[:, None] * self.false
        level = np.maximum(NOISE * np.sqrt(mean * (1 - self.false)), SHARE * total[:, None])
        return (hits - mean <= level).all(1)

    @property
    def learnt(self) -> list[str]:
        """Languages with at least one n-gram."""
        return [x for x, share in zip(self.languages, self.false, strict=True) if share > 0]

    def predict(self, texts: list[str | None], floor: bool = False) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; with ``floor``, texts that are ``unknown`` are ``und``, too."""
        n = len(texts)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        total, hits = self.count(texts)
        real = np.maximum(0.0, (hits - total[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)))
        best = real.argmax(1)
        score = np.where(total > 0, real[np.arange(n), best] / np.maximum(real.sum(1), 1e-9), 0.0)
        if floor:
            none = self.unknown(total, hits)
            total, score = np.where(none, 0, total), np.where(none, 0.0, score)
        return [self.languages[b] if t else "und" for b, t in zip(best, total, strict=True)], np.clip(score, 0.0, 1.0)


def probes(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> np.uint64(20 * i) & np.uint64((1 << LOG_SIZE) - 1)).astype(np.int64) for i in range(PROBES)]


def held_out():
    """crc32 of the doc_id as text, modulo 3, is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = 3000, top: int = 4000, relative: float = 0.3, most: int = 1024) -> Filters:
    """Learns from text and lang of labelled rows that are not held out: about ``sample_docs`` rows of each language, chosen by a hash of their id.

    Of more than ``most`` languages those with the most rows are learnt (then by name).
    """
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    languages = sorted(counts)
    if not languages:
        return Filters.build([], [])
    number = {lang: i for i, lang in enumerate(languages)}
    shares = docs.sparkSession.createDataFrame([(lang, int(1_000_000 * min(1.0, sample_docs / n))) for lang, n in counts.items()], "lang string, share long")
    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share")).drop("share")  # at most ``most`` rows

    def run(batches):
        for batch in steps(batches):
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for n, h, owner in grams(batch.column("text").to_pylist()):
                for i in np.unique(own):
                    values, times = np.unique(h[own[owner] == i], return_counts=True)
                    size = len(values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, i), pa.int64()), pa.array(np.full(size, n), pa.int64()), pa.array(values.view(np.int64)), pa.array(times, pa.int64())], ["number", "n", "gram", "times"])

    counted = sample.mapInArrow(run, "number long, n long, gram long, times long").groupBy("number", "n", "gram").agg(F.sum("times").alias("times"))
    rated = counted.withColumn("rate", F.col("times") / F.sum("times").over(Window.partitionBy("number", "n")))
    own = rated.where(F.col("times") > 1).withColumn("most", F.max("rate").over(Window.partitionBy("n", "gram"))).where(F.col("rate") >= relative * F.col("most"))
    best = own.withColumn("place", F.row_number().over(Window.partitionBy("number", "n").orderBy(F.desc("times"), "gram"))).where(F.col("place") <= top)
    return Filters.build(languages, [(r.number, r.gram) for r in best.select("number", "gram").collect()])


def identify(docs: DataFrame, filters: Filters, floor: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, with the language and its score at the end (columns of these names are replaced); ``floor`` as in ``predict``."""
    docs = docs.drop(*names)
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches):
        for batch in steps(batches):
            found, scores = filters.predict(batch.column("text").to_pylist(), floor)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores)], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def predictions(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score; nothing but the text enters a prediction."""
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), filters).drop("text")
