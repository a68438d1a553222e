"""BPE encoding and decoding of a document table (operator 7).

An empty table gives an empty result.  Only doc_id and text are read, so further columns do not matter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from clausemill.llm.bpe import encoder
from clausemill.llm.common import steps


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row; null text has no ids, repeated rows stay repeated.

    Row-local: no shuffle, and a task holds one step of texts plus the bounded piece table.
    """

    def run(batches):
        e = encoder(tokenizer)
        for batch in steps(batches):
            ids, counts = e.encode(batch.column("text").to_pylist())
            ends = pa.array([0, *counts.cumsum().tolist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches):
        e = encoder(tokenizer)
        for batch in batches:
            ids = batch.column("ids").fill_null([])
            texts = e.decode(ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encodes, then decodes the ids again."""

    def run(batches):
        e = encoder(tokenizer)
        spelled = [str(i) for i in range(e.merges.size)]
        for batch in steps(batches):
            ids, counts = e.encode(batch.column("text").to_pylist())
            digests, at = [], 0
            for n in counts:
                digests.append(hashlib.sha256(",".join([spelled[i] for i in ids[at : at + n].tolist()]).encode()).hexdigest())
                at += n
            back = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in e.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
