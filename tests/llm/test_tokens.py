"""Encoding, token files and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clausemill.llm import packing, token_digests, token_files
from clausemill.llm.bpe import Merges, PieceEncoder

TEXTS = [None, "", " ", "a", "  a b", "a\n b  c \n", " x ", "it's <|endoftext|> we'll\t\tq", "ÉCOLE Σας 日本語 😀 é", "aaaaaaaaaaaaa bbbbb", "a \x1c\x1d b\xa0 c　d", " \n", "<|endoftext|><|startoftext|> x", "One two, three. " * 700, "z" * 3000, "same text", "same text"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    path = public_tokenizers.path(name)
    ids, counts = PieceEncoder(Merges(path)).encode(TEXTS)
    library = Tokenizer.from_file(path)
    at = 0
    for text, n in zip(TEXTS, counts, strict=True):
        assert ids[at : at + n].tolist() == library.encode(text or "", add_special_tokens=False).ids
        at += n


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library_at_random(name):
    r = random.Random(11)
    library, own = Tokenizer.from_file(public_tokenizers.path(name)), PieceEncoder(Merges(public_tokenizers.path(name)))
    signs = ["a", "B", "the", " ", " ", "  ", "\n", "\t", "'s", "'LL", "1", "234", ".", ",", "!?", "é", "ß", "日", "😀", "\u0301", "\xa0", "\u3000", "\u200b", "<|endoftext|>", "<|", "#", "%%%", "ﬁ", "İ", "ǅ", "\x1c", "\x00", "\x7f", "µ", "Σ"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    ids, counts = own.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        at += n


def test_round_trip_digests(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*TEXTS, "\ud7ff\ue000 é" * 9, "日本" * 4000]
    got = {r.doc_id: r for r in token_digests.round_trip(documents(spark, texts).repartition(3), path).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), i


def test_piece_table_is_bounded():
    e = PieceEncoder(Merges(public_tokenizers.path("byte_bpe_50k.json")), max_pieces=3)
    for text in ("a b c d e", "f g h", "i j k l"):
        e.encode([text])
        assert len(e.table) <= 3 + 5  # the bound and one call
    e = PieceEncoder(Merges(public_tokenizers.path("byte_bpe_50k.json")), max_bytes=1000)
    for i in range(20):
        e.encode([f"{i}" + "日本" * 300])
        assert e.held <= 1000 + 2500


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_encode_decode_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark, TEXTS)
    back = token_digests.decode(token_digests.encode(docs, path), path).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert token_digests.round_trip(docs.limit(0), path).collect() == []


@pytest.mark.parametrize("ids", [[], [7], [0] * 600, [2**32 - 1, 0, 5], list(range(2000)), [3] * 511 + [70000]])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    docs, ends, blocks, n = token_files.from_bytes(token_files.to_bytes(ids, [None, 4], np.array([0, len(ids)])))
    assert (token_files.unpack(blocks)[:n] == ids).all() and docs == [None, 4] and ends.tolist() == [0, len(ids)]
    if n > 512:
        assert (token_files.unpack(blocks, 1, 2) == token_files.unpack(blocks)[512:1024]).all()


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark, TEXTS).repartition(5)
    manifest = token_files.write(docs, path, 0, f"file://{tmp_path}/t", tokens_per_file=1000)
    assert manifest.count() > 1
    got = {r.doc_id: r for r in token_files.read(manifest).collect()}
    library, start = Tokenizer.from_file(path), 0
    for i, text in enumerate(TEXTS):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = token_files.read(token_files.write(docs.limit(0), path, 0, f"file://{tmp_path}/e"))
    assert empty.collect() == []


def test_token_files_of_one_hot_id(spark, tmp_path):
    """Rows of one doc_id and of none fill many files, in order."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(7, f"text {i:04d} of many words") for i in range(300)] + [(None, f"none {i:03d}") for i in range(60)] + [(9, "last"), (1, "first")]
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), path, 0, f"file://{tmp_path}/h", tokens_per_file=100)
    assert manifest.count() > 15 and manifest.agg({"n_tokens": "max"}).first()[0] < 120
    got = sorted(token_files.read(manifest).collect(), key=lambda r: r.start)
    library, start = Tokenizer.from_file(path), 0
    for (doc, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])), got, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_karmarkar_karp_is_near_equal():
    sizes = [8, 7, 6, 5, 4]
    loads = sorted(sum(sizes[i] for i in w) for w in packing.karmarkar_karp(sizes, 2))
    assert loads == [14, 16]
    assert sorted(i for w in packing.karmarkar_karp(list(range(1, 50)), 7) for i in w) == list(range(49))


def test_packing_keeps_every_id_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(documents(spark, TEXTS * 9).repartition(2), path, capacity=64, block_windows=4).collect()
    library = Tokenizer.from_file(path)
    used, by_doc = {}, {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(TEXTS * 9):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = padding = 0
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
        total += at
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding < 0.1 * total
    assert packing.pack(documents(spark, []), path).collect() == []
