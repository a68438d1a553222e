"""Edit-aware token counts (operator 3).

A document's pre-token segments encode independently of each other.  A segment is a run of white
space with the characters that follow; one of over ``LONG`` characters is cut further, where the
vocabulary's split pattern always cuts: around added tokens, between letters and digits, before
other signs, and before digits.  (A longer run of letters alone is one pre-token and stays whole.)
A tree keeps them: leaves are pages of up to 64 segments, inner nodes hold the sums of characters
and tokens below them.  An edit finds its page by descending over character sums, cuts anew only
the segments that it touches and one on either side, encodes those, and updates the sums on the way
to the root.  A page that grows too large makes the tree be laid out again, without encoding.

``store`` adds the trees' leaves to a table, as lengths and counts of segments, and ``apply`` edits
such a table: documents without edits are passed on, others are laid out from what is stored, and
only what their edits touch is encoded.

Null text counts as empty: no segments, no tokens.  Offsets are code points and are clipped to the
text.  Rows that share a doc_id are counted, and edited, each for itself; rows of null doc_id have no
edits.  Edits of one document apply in order of ``seq``, those of equal ``seq`` in order of their
other columns.  Further columns are ignored by ``edited_counts`` and kept by ``store`` and ``apply``;
columns of the names of what is stored are replaced.  An empty table gives an empty result.  Counting
is row-local; edits are joined by doc_id, and a task holds the trees of one step of texts beside the
bounded piece table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from clausemill.llm.bpe import PieceEncoder, encoder
from clausemill.llm.common import steps

PAGE = 64
Edit = tuple[int, int, str]  # start, end, replacement

#: Characters of a segment beyond which it is cut further, and of the pieces at least.
LONG, PIECE = 32, 16
#: Places where the split pattern of byte-level vocabularies always cuts: contractions alone join other signs and letters.
_SAFE = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})")
STORED = ("segment_chars", "segment_tokens", "n_tokens")


def cut(text: str, pieces: PieceEncoder) -> list[str]:
    """The segments of a text."""
    out: list[str] = []
    for chunk in pieces.chunks(text):
        if len(chunk) <= LONG or pieces.merges.words:
            out.append(chunk)
            continue
        for part in pieces.merges.marks.split(chunk) if pieces.merges.marks else [chunk]:
            at = 0
            for m in _SAFE.finditer(part) if part not in pieces.merges.added else ():
                if m.start() - at >= PIECE:
                    out.append(part[at : m.start()])
                    at = m.start()
            if at < len(part):
                out.append(part[at:])
    return out


class TokenTree:
    """Segments of one text under sums of characters and tokens."""

    def __init__(self, segments: list[str], counts: list[int], pieces: PieceEncoder):
        self.pieces, self.encoded = pieces, 0
        self._lay_out(segments, counts)

    @staticmethod
    def of(text: str | None, pieces: PieceEncoder) -> TokenTree:
        segments = cut(text or "", pieces)
        tree = TokenTree(segments, pieces.count_chunks(segments), pieces)
        tree.encoded = len(segments)
        return tree

    def _lay_out(self, segments: list[str], counts: list[int]) -> None:
        half = PAGE // 2
        self.pages = [(segments[i : i + half], counts[i : i + half]) for i in range(0, len(segments), half)] or [([], [])]
        size = 1
        while size < len(self.pages):
            size *= 2
        self.size = size
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for i, (s, c) in enumerate(self.pages):
            self.chars[size + i], self.tokens[size + i] = sum(map(len, s)), sum(c)
        for i in range(size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_segments(self) -> int:
        return sum(len(s) for s, _ in self.pages)

    @property
    def text(self) -> str:
        return "".join(x for s, _ in self.pages for x in s)

    def _find(self, offset: int) -> tuple[int, int]:
        """The page that holds a character, and the offset in it; the last page for the end."""
        i = 1
        while i < self.size:
            i *= 2
            if offset >= self.chars[i] and self.chars[i + 1]:
                offset -= self.chars[i]
                i += 1
        return i - self.size, offset

    def _set(self, page: int, segments: list[str], counts: list[int]) -> None:
        self.pages[page] = (segments, counts)
        i = self.size + page
        self.chars[i], self.tokens[i] = sum(map(len, segments)), sum(counts)
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces the characters from start to end."""
        plan = self.plan(start, end, replacement)
        self.commit(plan, self.pieces.count_chunks(plan[-1]))

    def plan(self, start: int, end: int, replacement: str) -> tuple:
        """What an edit changes: pages, their segments and counts, and the segments to put in, which are still to be counted."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        first, inner = self._find(start)
        last, _ = self._find(max(start, end - 1))
        base = start - inner
        # pages with a neighbouring segment on either side
        left = first
        while left > 0 and (left == first or not self.pages[left][0]):
            left -= 1
            base -= self.chars[self.size + left]
        right = last
        while right < len(self.pages) - 1 and (right == last or not self.pages[right][0]):
            right += 1
        segments = [x for s, _ in self.pages[left : right + 1] for x in s]
        counts = [x for _, c in self.pages[left : right + 1] for x in c]
        a, at = 0, base  # first touched segment: the one that holds the character before the edit
        while a < len(segments) and at + len(segments[a]) < start:
            at += len(segments[a])
            a += 1
        b, to = a, at
        while b < len(segments) and to <= end:
            to += len(segments[b])
            b += 1
        if a > 0:
            a -= 1
            at -= len(segments[a])
        if b < len(segments):
            b += 1
        old = "".join(segments[a:b])
        return left, right, segments, counts, a, b, cut(old[: start - at] + replacement + old[end - at :], self.pieces)

    def commit(self, plan: tuple, fresh_counts: list[int]) -> None:
        left, right, segments, counts, a, b, fresh = plan
        self.encoded += len(fresh)
        segments[a:b], counts[a:b] = fresh, fresh_counts
        n = right - left + 1
        share = -(-len(segments) // n)
        if share > PAGE:
            every = [*self.pages[:left], (segments, counts), *self.pages[right + 1 :]]
            self._lay_out([x for s, _ in every for x in s], [x for _, c in every for x in c])
            return
        for k in range(n):
            self._set(left + k, segments[k * share : (k + 1) * share], counts[k * share : (k + 1) * share])


def edit_all(trees: list[TokenTree], edits: list[list[Edit]], pieces: PieceEncoder) -> None:
    """Applies each tree's edits in order; the segments of one round are counted together."""
    for k in range(max(map(len, edits), default=0)):
        plans = [(t, t.plan(*own[k])) for t, own in zip(trees, edits, strict=True) if k < len(own)]
        counts, at = pieces.count_chunks([c for _, p in plans for c in p[-1]]), 0
        for t, p in plans:
            t.commit(p, counts[at : at + len(p[-1])])
            at += len(p[-1])


def spread_edits(n_chars: int) -> list[Edit]:
    """Three edits of a text, the last place first: an insertion, a deletion, a replacement."""
    return [(3 * n_chars // 4, 3 * n_chars // 4 + 8, "-x-"), (n_chars // 2, n_chars // 2 + 16, ""), (n_chars // 4, n_chars // 4, " [edited] ")]


COLUMNS = "doc_id long, n_chars long, n_segments long, n_tokens long, edited_n_chars long, edited_n_tokens long, n_reencoded long"


def edited_counts(docs: DataFrame, tokenizer: str, edits: Callable[[int], list[Edit]] = spread_edits) -> DataFrame:
    """Counts of each text and of its edited text, and how many segments the edits encoded anew."""

    def run(batches):
        pieces = encoder(tokenizer)
        for batch in steps(batches):
            texts = batch.column("text").to_pylist()
            segments = [cut(t or "", pieces) for t in texts]
            counts = pieces.count_chunks([c for own in segments for c in own])
            trees, at = [], 0
            for own in segments:
                trees.append(TokenTree(own, counts[at : at + len(own)], pieces))
                at += len(own)
            before = [(t.n_chars, t.n_segments, t.n_tokens) for t in trees]
            edit_all(trees, [edits(t.n_chars) for t in trees], pieces)
            rows = [(*b, t.n_chars, t.n_tokens, t.encoded) for b, t in zip(before, trees, strict=True)]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], [c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)


def _numbers(values: list[int]) -> bytes:
    return np.array(values, "<i4").tobytes()


def _stored(tree: TokenTree) -> tuple[bytes, bytes, int]:
    segments = [x for own, _ in tree.pages for x in own]
    return _numbers([len(x) for x in segments]), _numbers([x for _, own in tree.pages for x in own]), tree.n_tokens


def _restored(text: str, chars: bytes, tokens: bytes, pieces: PieceEncoder) -> TokenTree:
    """A tree from what is stored, without encoding."""
    ends = np.cumsum(np.frombuffer(chars, "<i4")).tolist()
    return TokenTree([text[a:b] for a, b in zip([0, *ends], ends, strict=False)], np.frombuffer(tokens, "<i4").tolist(), pieces)


def _with_trees(docs: DataFrame, more: tuple[str, ...] = ()) -> StructType:
    kinds = {"segment_chars": BinaryType(), "segment_tokens": BinaryType()}
    return StructType([*(f for f in docs.schema.fields if f.name not in (*STORED, *more)), *(StructField(n, kinds.get(n, LongType())) for n in (*STORED, *more))])


def store(docs: DataFrame, tokenizer: str) -> DataFrame:
    """All columns of docs, with the lengths and token counts of the text's segments and its token count."""
    schema = _with_trees(docs)

    def run(batches):
        pieces = encoder(tokenizer)
        for batch in steps(batches):
            segments = [cut(t or "", pieces) for t in batch.column("text").to_pylist()]
            counts, at, rows = pieces.count_chunks([c for own in segments for c in own]), 0, []
            for own in segments:
                mine = counts[at : at + len(own)]
                rows.append((_numbers([len(x) for x in own]), _numbers(mine), sum(mine)))
                at += len(own)
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[: -len(STORED)]), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True))], schema.names)

    return docs.drop(*STORED).mapInArrow(run, schema)


def apply(stored: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """A stored table after edits (doc_id, seq, start, end, replacement), in the same columns and ``n_encoded``: the segments that the edits of a row encoded, 0 for a row without edits."""
    name = "edits"
    while name in stored.columns:
        name += "_"
    own = edits.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", F.coalesce("replacement", F.lit("")).alias("replacement")))).alias(name))
    schema = _with_trees(stored, ("n_encoded",))

    def run(batches):
        pieces = encoder(tokenizer)
        for batch in steps(batches):
            texts, chars, tokens, todo = (batch.column(n).to_pylist() for n in ("text", *STORED[:2], name))
            trees = [_restored(t or "", c, k, pieces) for t, c, k in zip(texts, chars, tokens, strict=True)]
            edit_all(trees, [[(e["start"], e["end"], e["replacement"]) for e in x] for x in todo], pieces)
            made = {"text": pa.array([t.text for t in trees], pa.string()), "n_encoded": pa.array([t.encoded for t in trees], pa.int64())}
            rows = [_stored(t) for t in trees]
            for n, column, kind in zip(STORED, zip(*rows, strict=True) if rows else [[]] * 3, (pa.binary(), pa.binary(), pa.int64()), strict=True):
                made[n] = pa.array(column, kind)
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n) if n in batch.schema.names else None) for n in schema.names], schema.names)

    touched = stored.drop("n_encoded").join(own, "doc_id").mapInArrow(run, schema)
    rest = stored.drop("n_encoded").join(own.select(F.col("doc_id").alias(name)), F.col("doc_id") == F.col(name), "left_anti")
    return touched.unionByName(rest.withColumn("n_encoded", F.lit(0).cast("long")))
