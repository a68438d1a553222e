"""Edit-aware counts against counting the whole text again."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from clausemill.llm import token_counts
from clausemill.llm.bpe import encoder
from tests.llm.test_tokens import TEXTS, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_random_edits():
    library, pieces, r = Tokenizer.from_file(PATH), encoder(PATH), random.Random(6)
    for _ in range(60):
        text = "".join(r.choice(["word", "it's ", " ", "  ", "\n", ".", "é", "<|endoftext|>", "12 "]) for _ in range(r.choice([0, 1, 5, 60, 900])))
        tree = token_counts.TokenTree.of(text, pieces)
        for _ in range(25):
            a = r.randint(0, len(text) + 2)
            b = a + r.choice([0, 1, 7, 200])
            new = r.choice(["", " ", "x", "\n\n", " two words ", "y " * 150, "<|endoftext|>"])
            before = tree.encoded
            tree.edit(a, b, new)
            text = text[:a] + new + text[max(a, b) :]
            assert tree.text == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
            assert tree.encoded - before <= len(token_counts.cut(new, pieces)) + 16
            assert tree.n_tokens == sum(c for _, own in tree.pages for c in own)


def test_table(spark):
    got = {r.doc_id: r for r in token_counts.edited_counts(documents(spark, TEXTS).repartition(3), PATH).collect()}
    library = Tokenizer.from_file(PATH)
    for i, text in enumerate(TEXTS):
        text = text or ""
        new = text
        for a, b, x in token_counts.spread_edits(len(text)):
            new = new[:a] + x + new[max(a, b) :]
        r = got[i]
        assert (r.n_chars, r.n_tokens) == (len(text), len(library.encode(text, add_special_tokens=False).ids))
        assert (r.edited_n_chars, r.edited_n_tokens) == (len(new), len(library.encode(new, add_special_tokens=False).ids))
        assert r.n_reencoded <= 24
    assert token_counts.edited_counts(documents(spark, []), PATH).collect() == []


def test_texts_without_white_space_are_cut_and_edited_in_part():
    """Signs, digits, contractions and added tokens, parts of them too, in texts of one chunk; each edit encodes a bounded part."""
    library, pieces, r = Tokenizer.from_file(PATH), encoder(PATH), random.Random(12)
    parts = ["abc", "12", "'s", "'", "'ll", ".", "--", "é", "<|endoftext|>", "<|", "endoftext", "|>", "x", "/path", "=", "漢字"]
    for _ in range(60):
        text = "".join(r.choices(parts, k=r.choice([20, 300])))
        tree = token_counts.TokenTree.of(text, pieces)
        for _ in range(25):
            a = r.randint(0, len(text))
            b = a + r.choice([0, 1, 7, 40])
            new = "".join(r.choices(parts, k=r.randrange(4)))
            before = tree.encoded
            tree.edit(a, b, new)
            text = text[:a] + new + text[max(a, b) :]
            assert tree.text == text and tree.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
            assert tree.encoded - before <= 24
    long = "".join(f"word{i}." for i in range(100_000))
    tree = token_counts.TokenTree.of(long, pieces)
    before = tree.encoded
    tree.edit(300_000, 300_004, "new")
    assert before > 10_000 and tree.encoded - before <= 5


def test_edits_of_a_stored_table_encode_what_they_touch(spark, tmp_path):
    """Trees outlive a run: they are written, read again and edited; edited rows equal whole counts, others are untouched."""
    library, r = Tokenizer.from_file(PATH), random.Random(4)
    rows = [(i % 190 if i < 195 else None, " ".join(r.choices(["word", "it's", "12", "\n", "<|endoftext|>", "é"], k=r.choice([0, 3, 2_000]))) if i % 7 else None, "mine", "mine") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits string, n_tokens string").repartition(4)
    token_counts.store(docs, PATH).write.parquet(f"{tmp_path}/stored")
    stored = spark.read.parquet(f"{tmp_path}/stored")
    assert stored.columns == ["doc_id", "text", "edits", *token_counts.STORED] and {x.edits for x in stored.collect()} == {"mine"}
    edits = [(d, k, r.randrange(60), r.randrange(80), r.choice(["", "new words", "x", None])) for d in (1, 2, 3, 8, 191, 9_999) for k in range(3)] + [(1, 1, 0, 0, "tie "), (None, 0, 0, 5, "x")]
    out = token_counts.apply(stored, spark.createDataFrame(edits, "doc_id long, seq long, start long, end long, replacement string").repartition(3), PATH)
    assert out.columns == [*stored.columns, "n_encoded"]

    def edited(doc, text):
        text = text or ""
        for _, a, b, new in sorted((s, a, b, n or "") for d, s, a, b, n in edits if d == doc and d is not None):
            a = max(0, min(a, len(text)))
            text = text[:a] + new + text[max(a, min(b, len(text))) :]
        return text

    got = sorted((x.doc_id if x.doc_id is not None else -1, x.text or "") for x in out.collect())
    assert got == sorted((d if d is not None else -1, edited(d, t)) for d, t, *_ in rows)
    for x in out.collect():
        assert x.n_tokens == len(library.encode(x.text or "", add_special_tokens=False).ids)
        assert x.n_encoded == 0 if x.doc_id not in (1, 2, 3, 8) else x.n_encoded <= 40
    again = token_counts.apply(out, spark.createDataFrame([(2, 0, 1, 2, "again")], "doc_id long, seq long, start long, end long, replacement string"), PATH)
    assert again.columns == out.columns and again.count() == 200
    assert token_counts.apply(stored.limit(0), spark.createDataFrame(edits, "doc_id long, seq long, start long, end long, replacement string"), PATH).count() == 0
