"""Byte-pair encoding and decoding in batched numpy merge rounds (operator 7).

All symbols of many words lie in one flat array.  A round looks every adjacent
pair up by binary search in the sorted pair keys, takes each word's lowest rank
with a segmented minimum and merges all occurrences of that pair at once, left
to right.  Words without a mergeable pair leave the array, so a round costs as
much as the symbols that are still in play.

Texts are cut at single spaces and only distinct pieces are encoded; the piece
table is bounded (``max_pieces``) and lives as long as the Python worker.

Defined results: null text counts as empty, an empty text has no ids; the string
of an added token (such as ``<|endoftext|>``) inside a text gives that token's id,
as the ``tokenizers`` library does by default.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import regex

#: The split pattern of byte-level vocabularies and that of the word-end vocabulary.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"""


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def segments(lengths: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums with the total at the end."""
    return np.concatenate(([0], np.cumsum(lengths)))


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[start[i]:start[i] + count[i]]`` over all i."""
    at = segments(count)
    return flat[np.repeat(start - at[:-1], count) + np.arange(at[-1])]


class Merges:
    """Vocabulary and merge rules of a BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.words = bool(self.end)  # word-end vocabularies: lower case, white space dropped
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.size = max(max(vocab.values()), *self.added.values(), 0) + 1
        self.wide = self.size > 1 << 16
        keys = (left * self.size + right).astype(np.uint64 if self.wide else np.uint32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        back = {c: b for b, c in enumerate(letters)}
        self.spelled = [b""] * self.size
        for token, i in vocab.items():
            body = token.removesuffix(self.end) if self.end else token
            self.spelled[i] = bytes(back[c] for c in body) if all(c in back for c in body) else token.encode()
        for token, i in self.added.items():
            self.spelled[i] = token.encode()
        self.pattern = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs, by binary search; the number of rules where there is none."""
        key = left.astype(np.uint64 if self.wide else np.uint32)
        key *= key.dtype.type(self.size)
        key += right.astype(key.dtype)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(len(self.ranks)))

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids of words given as one flat symbol array, and each word's id count.

        Only the two pairs beside a merged symbol are looked up again after a round.
        """
        none = np.int32(len(self.ranks))
        n = len(lengths)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        which = np.flatnonzero(lengths > 0)
        lengths = lengths[which]
        tail = np.zeros(len(symbols), bool)  # a word's last symbol starts no pair
        if len(which):
            tail[np.cumsum(lengths) - 1] = True
            rank = np.full(len(symbols), none, np.int32)
            rank[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
            rank[tail] = none
        while len(which):
            low = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
            live = low < none
            alive = int(live.sum())
            if 4 * alive < 3 * len(which):  # words that are finished leave
                out = np.repeat(~live, lengths)
                done.append((which[~live], lengths[~live], symbols[out]))
                if not alive:
                    break
                stay = ~out
                symbols, rank, tail = symbols[stay], rank[stay], tail[stay]
                which, lengths, low = which[live], lengths[live], low[live]
            place = np.flatnonzero((rank == np.repeat(low, lengths)) & (rank < none))
            close = np.diff(place) == 1
            if close.any():  # runs such as a a a: every second one, from the left
                first = np.concatenate(([True], ~close))
                run = np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
                place = place[(np.arange(len(place)) - run) % 2 == 0]
            symbols[place] = self.made[rank[place]]
            tail[place] = tail[place + 1]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            owner = np.searchsorted(np.cumsum(lengths), place, side="right")
            lengths = lengths - np.bincount(owner, minlength=len(lengths))
            symbols, rank, tail = symbols[keep], rank[keep], tail[keep]
            at = place - np.arange(len(place))
            at = np.concatenate((at, at[at > 0] - 1))
            ends = tail[at]
            rank[at[ends]] = none
            at = at[~ends]
            rank[at] = self.pair_ranks(symbols[at], symbols[at + 1])
        count = np.zeros(n, np.int64)
        if not done:
            return np.zeros(0, np.int32), count
        ids, sizes, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        count[ids] = sizes
        order = np.argsort(ids, kind="stable")
        return gather(flat, segments(sizes)[:-1][order], sizes[order]), count

    def normal(self, piece: str) -> str:
        if not self.words or (piece.isascii() and piece.islower()):
            return piece
        piece = unicodedata.normalize("NFC", piece)
        return "".join(c.lower() for c in piece)

    def cut(self, piece: str) -> list[str]:
        """Pre-tokens of a piece that holds no added token."""
        space = piece[:1] == " "
        body = piece[1:] if space else piece
        if body.isalpha():
            return [body if self.words else piece]
        if body[:-1].isalpha() and body[-1] in PLAIN_MARKS:
            return [body[:-1] if self.words else piece[:-1], body[-1]]
        return self.pattern.findall(piece)

class _Index(dict):
    """Numbers its keys in the order in which they are first asked for, and lists those that are new."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.fresh.append(key)
        return n

    def take_fresh(self) -> list:
        out, self.fresh = self.fresh, []
        return out


class _Growing:
    """An array that grows at the end, in amortised constant time."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            more = np.zeros(max(need, len(self.data) * 3 // 2), self.data.dtype)
            more[: self.size] = self.data[: self.size]
            self.data = more
        self.data[self.size : need] = values
        self.size = need


class _Runs:
    """Numbered runs of ids that grow at the end."""

    def __init__(self):
        self._flat, self._start, self._count = _Growing(np.int32), _Growing(np.int64), _Growing(np.int64)

    @property
    def flat(self) -> np.ndarray:
        return self._flat.data[: self._flat.size]

    @property
    def start(self) -> np.ndarray:
        return self._start.data[: self._start.size]

    @property
    def count(self) -> np.ndarray:
        return self._count.data[: self._count.size]

    def extend(self, flat: np.ndarray, count: np.ndarray) -> None:
        self._start.add(self._flat.size + segments(count)[:-1])
        self._flat.add(flat)
        self._count.add(count)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[at]
        return gather(self.flat, self.start[at], count), count


#: Marks that stand alone after letters in both patterns.
PLAIN_MARKS = frozenset(",.;:!?)]}")
#: White space of the split pattern.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_CHUNK = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


class PieceEncoder:
    """Encodes texts through a bounded table of distinct pieces.

    A single space between two other characters always starts a new pre-token, so
    the pieces between single spaces encode independently; a text with any other
    use of spaces is cut before each run of white space instead.
    """

    def __init__(self, merges: Merges, max_pieces: int = 400_000, max_bytes: int = 24_000_000):
        self.merges, self.max_pieces, self.max_bytes = merges, max_pieces, max_bytes
        self.clear()

    @property
    def odd(self) -> np.ndarray:
        return self._odd.data[: self._odd.size]

    def clear(self) -> None:
        self.table, self.pieces, self._odd = _Index(), _Runs(), _Growing(bool)
        self.vocabulary, self.known = _Index(), _Runs()
        self.held = 0  # characters of the keys

    def _room(self) -> None:
        """Empties the table when it has grown beyond its bounds; both hold but for what one call adds."""
        if len(self.table) > self.max_pieces or self.held > self.max_bytes:
            self.clear()

    def _words(self, words: list[str], budget: int = 1 << 16) -> None:
        """Merges new pre-tokens, about ``budget`` symbols at a time."""
        m = self.merges
        raw = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = m.inner[flat]
        ends = np.cumsum(lengths)
        if m.words:
            symbols[ends[lengths > 0] - 1] = m.last[flat[ends[lengths > 0] - 1]]
        cuts = [*np.unique(np.searchsorted(ends, np.arange(0, len(flat), budget), side="left")), len(raw)]
        ids, counts = [], []
        for a, b in pairwise(cuts):
            i, c = m.merge(symbols[ends[a] - lengths[a] : ends[b - 1]].copy(), lengths[a:b])
            ids.append(i)
            counts.append(c)
        if ids:
            self.known.extend(np.concatenate(ids), np.concatenate(counts))

    def _learn(self) -> None:
        m, keys = self.merges, self.table.take_fresh()
        if not keys:
            return
        self.held += sum(map(len, keys)) + sum(len(k[0]) for k in keys if k.__class__ is tuple)
        follow = not m.words  # (piece,) is a piece as it is; any other follows a space
        odd = np.zeros(len(keys), bool)
        index = self.vocabulary.__getitem__
        at: list[int] = []
        sizes: list[int] = []
        add, size, lead, plain = at.append, sizes.append, " " if follow else "", follow or None
        for k, key in enumerate(keys):
            if key.__class__ is str and (plain or key.isascii() and key.islower()):
                if key.isalpha():
                    add(index(lead + key))
                    size(1)
                    continue
                body = key[:-1]
                if body.isalpha() and key[-1] in PLAIN_MARKS:
                    add(index(lead + body))
                    add(index(key[-1]))
                    size(2)
                    continue
            before = len(at)
            if key.__class__ is str:
                odd[k] = follow and (not key or key[0] in SPACE or key[-1] in SPACE)
                key = lead + key
            else:
                key = key[0]
            if "<|" in key and m.marks is not None:
                for part in m.marks.split(key):
                    if part in m.added:
                        add(index((part,)))
                    elif part:
                        at += map(index, m.cut(m.normal(part)))
            else:
                at += map(index, m.cut(m.normal(key)))
            size(len(at) - before)
        fresh = self.vocabulary.take_fresh()
        if any(isinstance(w, tuple) for w in fresh):  # added tokens: learnt in order, each as one id
            for w in fresh:
                if isinstance(w, tuple):
                    self.known.extend(np.array([m.added[w[0]]]), np.array([1]))
                else:
                    self._words([w])
        else:
            self._words(fresh)
        flat, count = self.known.take(np.array(at, np.int64))
        ends = segments(count)[segments(np.array(sizes, np.int64))]
        self.pieces.extend(flat, np.diff(ends))
        self._odd.add(odd)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts (int32), and each text's id count."""
        self._room()
        index, split = self.table.__getitem__, not self.merges.words
        fold = not split and "<|" not in "".join(filter(None, texts))
        rows: list[list[int]] = []
        for text in texts:
            if fold and text and text.isascii():
                text = text.lower()
            pieces = text.split(" ") if text else []
            if split and pieces:
                pieces[0] = (pieces[0],)
            rows.append(list(map(index, pieces)))
        self._learn()
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum()))
        if split:
            owner = np.repeat(np.arange(len(rows)), lengths)
            again = np.unique(owner[self.odd[at]]).tolist()
            again += [k for k, t in enumerate(texts) if t and (t[0] in SPACE or (s := t.find(" ")) > 0 and t[s - 1] in SPACE)]
            if again:
                for k in again:
                    rows[k] = [index((x,)) for x in _CHUNK.findall(texts[k])]
                self._learn()
                lengths = np.fromiter(map(len, rows), np.int64, len(rows))
                at = np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum()))
        flat, count = self.pieces.take(at)
        return flat, np.diff(segments(count)[segments(lengths)])

    def chunks(self, text: str) -> list[str]:
        """The text cut before each run of white space; chunks encode independently."""
        return _CHUNK.findall(text)

    def count_chunks(self, chunks: list[str]) -> list[int]:
        """Id counts of chunks."""
        self._room()
        index = self.table.__getitem__
        at = [index((c,)) for c in chunks]
        self._learn()
        return self.pieces.count[np.array(at, np.int64)].tolist()

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive id runs; malformed UTF-8 becomes U+FFFD."""
        spelled = self.merges.spelled
        out, at = [], 0
        for n in counts:
            out.append(b"".join([spelled[i] for i in ids[at : at + n].tolist()]).decode("utf-8", "replace"))
            at += n
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python process for a tokenizer file."""
    return PieceEncoder(Merges(path))
