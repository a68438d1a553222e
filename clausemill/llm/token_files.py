"""Token-id files in patched frame-of-reference blocks (operator 6).

A file holds the ids of consecutive documents.  Ids are cut into blocks of 512.
From each block its minimum is subtracted; the differences are packed at the width
of that percentile (of 50, 75, 90, 95, 99 and 100) for which the block is smallest,
and what does not fit goes into exception lists.  Block starts are indexed, so any
run of ids is read from the blocks that hold it.

Layout, little-endian: magic ``CMPF``; counts of ids, blocks, documents and
exceptions (u64); per block: minimum u32, width u8, number of exceptions u16, byte
start of the payload u64; per document: doc_id i64, null flag u8, id end u64; the
exceptions' places (u16) and high bits (u32); the payload, per block ``width`` bit
planes of 64 bytes.

Files are written under names of their own per task attempt and are known only
through the manifest, a table that Spark commits; so a retried or a speculative
task leaves at most a file that nothing refers to.

Null texts count as empty and are their end id alone; rows that repeat are written each for itself, in
order of their text where they share a doc_id; an empty table gives an empty result.  Only doc_id
and text are read, so further columns do not matter.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.bpe import encoder, segments
from clausemill.llm.common import shared_dir, steps

BLOCK = 512
PERCENTILES = (50, 75, 90, 95, 99, 100)
MAGIC = b"CMPF"
MANIFEST = "path string, part int, place int, first_doc long, n_docs long, n_tokens long"
#: Ids that a task reads back, about.
READ_TOKENS = 8_000_000


def bits(values: np.ndarray) -> np.ndarray:
    """Bit lengths of non-negative integers."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of an id array; the last block is filled up with its minimum."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    if blocks:
        grid[n:] = ids[(blocks - 1) * BLOCK :].min()
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(1) if blocks else np.zeros(0, np.uint32)
    rest = grid - low[:, None]
    order = np.sort(rest, axis=1)
    widths = np.stack([bits(order[:, min(BLOCK - 1, p * BLOCK // 100)]) for p in PERCENTILES]) if blocks else np.zeros((1, 0), np.int64)
    over = np.stack([(order >> np.minimum(w, 31)[:, None].astype(np.uint32) > 0).sum(1) for w in widths])
    best = np.argmin(widths * BLOCK + over * 48, axis=0)
    width = np.take_along_axis(widths, best[None], 0)[0]
    high = rest >> np.minimum(width, 31)[:, None].astype(np.uint32)
    row, place = np.nonzero(high)
    payload = np.zeros(int(width.sum()) * (BLOCK // 8), np.uint8)
    start = segments(width * (BLOCK // 8))
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        for bit in range(w):
            plane = np.packbits((rest[own] >> np.uint32(bit) & 1).astype(np.uint8), axis=1)
            at = start[own] + bit * (BLOCK // 8)
            payload[at[:, None] + np.arange(BLOCK // 8)] = plane
    return {"low": low, "width": width.astype(np.uint8), "patched": np.bincount(row, minlength=blocks).astype(np.uint16), "start": start[:-1].astype(np.uint64), "place": place.astype(np.uint16), "high": high[row, place].astype(np.uint32), "payload": payload}


def unpack(p: dict[str, np.ndarray], first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks ``first`` to ``last`` (exclusive), the fill included."""
    last = len(p["low"]) if last is None else last
    width, start = p["width"][first:last].astype(np.int64), p["start"][first:last].astype(np.int64)
    grid = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        part = np.zeros((len(own), BLOCK), np.uint32)
        for bit in range(w):
            plane = p["payload"][(start[own] + bit * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)]
            part |= np.unpackbits(plane, axis=1).astype(np.uint32) << np.uint32(bit)
        grid[own] = part
    ends = segments(p["patched"].astype(np.int64))
    row = np.repeat(np.arange(last - first), p["patched"][first:last].astype(np.int64))
    own = slice(ends[first], ends[last])
    grid[row, p["place"][own]] |= p["high"][own] << width[row].astype(np.uint32)
    return (grid + p["low"][first:last, None]).ravel()


_BLOCK_COLUMNS = (("low", "<u4"), ("width", "<u1"), ("patched", "<u2"), ("start", "<u8"))
_DOC_COLUMNS = (("doc", "<i8"), ("null", "<u1"), ("end", "<u8"))
_PATCH_COLUMNS = (("place", "<u2"), ("high", "<u4"))


def to_bytes(ids: np.ndarray, docs: list[int | None], ends: np.ndarray) -> bytes:
    p = pack(ids) | {"doc": np.array([d or 0 for d in docs]), "null": np.array([d is None for d in docs]), "end": ends}
    head = np.array([len(ids), len(p["low"]), len(docs), len(p["place"])], "<u8").tobytes()
    columns = (*_BLOCK_COLUMNS, *_DOC_COLUMNS, *_PATCH_COLUMNS, ("payload", "<u1"))
    return b"".join([MAGIC, head, *(np.ascontiguousarray(p[k], kind).tobytes() for k, kind in columns)])


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, dict[str, np.ndarray], int]:
    """doc ids, id ends, blocks and the number of ids of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    n, blocks, docs, patches = np.frombuffer(data, "<u8", 4, 4).tolist()
    at, p = 36, {}
    for size, columns in ((blocks, _BLOCK_COLUMNS), (docs, _DOC_COLUMNS), (patches, _PATCH_COLUMNS)):
        for k, kind in columns:
            p[k] = np.frombuffer(data, kind, size, at)
            at += p[k].nbytes
    p["payload"] = np.frombuffer(data, "<u1", -1, at)
    return [None if z else int(d) for d, z in zip(p["doc"], p["null"], strict=True)], p["end"].astype(np.int64), p, n


def _files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, tokens_per_file: int = 4_000_000) -> DataFrame:
    """Encodes and writes all documents in ascending doc_id order; returns the manifest, one row per file.

    Null text counts as empty (its ids: the end id alone), a null doc_id comes first,
    rows that share a doc_id come in order of their text.  An empty table gives no
    file.  A range shuffle by doc_id moves the texts once; a task holds one file's
    ids at most, beside a step of texts, also where very many rows share a doc_id.
    Files come in the order of ``part`` (the task) and ``place``.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-files")

    def run(batches):
        e = encoder(tokenizer)
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        docs_, ids_, size, place = [], [], 0, 0
        part = TaskContext.get().partitionId()

        def flush():
            nonlocal place
            place += 1
            lengths = np.array([len(x) for x in ids_], np.int64)
            name = f"{base}/{uuid.uuid4().hex}.tok"
            with files.open_output_stream(name) as out:
                out.write(to_bytes(np.concatenate(ids_), docs_, np.cumsum(lengths)))
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name.rpartition('/')[2]}", "part": part, "place": place, "first_doc": docs_[0], "n_docs": len(docs_), "n_tokens": int(lengths.sum())}], pa.schema([("path", pa.string()), ("part", pa.int32()), ("place", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in steps(batches):
            ids, counts = e.encode(batch.column("text").to_pylist())
            ends = segments(counts)
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                if docs_ and size >= tokens_per_file:
                    yield flush()
                    docs_, ids_, size = [], [], 0
                docs_.append(doc)
                ids_.append(np.append(ids[ends[k] : ends[k + 1]], end_id))
                size += len(ids_[-1])
        if docs_:
            yield flush()

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    path = f"{folder}-manifest"
    ranged.mapInArrow(run, MANIFEST).write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    Running sums go over a task's files, and over one row for each writing task.  Files
    are spread over tasks of about ``READ_TOKENS`` ids.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("part", F.coalesce(F.sum("size").over(ahead.orderBy("part")), F.lit(0)).alias("first"))
    own = F.coalesce(F.sum("n_tokens").over(ahead.partitionBy("part").orderBy("place")), F.lit(0))
    tasks = 1 + (manifest.agg(F.sum("n_tokens")).first()[0] or 0) // READ_TOKENS

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("file_start").to_pylist(), strict=True):
                files, name = _files(path)
                with files.open_input_stream(name) as f:
                    docs, ends, blocks, n = from_bytes(f.read())
                ids = unpack(blocks)[:n].astype("<u4")
                starts = np.concatenate(([0], ends[:-1]))
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.withColumn("own", own).join(first, "part").select("path", (F.col("first") + F.col("own")).alias("file_start")).repartition(int(tasks))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
