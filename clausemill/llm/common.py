"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from clausemill.plans.stages import spread

#: Bytes of text and rows that one Python step takes at most (one longer text is a step of its own).
STEP_BYTES, STEP_ROWS = 1_000_000, 2_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in steps of bounded text size, whatever Spark put into a batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        at = 0
        while at < len(sizes):
            to, total = at, 0
            while to < len(sizes) and (to == at or to - at < STEP_ROWS and total + sizes[to] <= STEP_BYTES):
                total += sizes[to]
                to += 1
            yield batch.slice(at, to - at)
            at = to


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "4m"):
    """Jobs started inside send at most so many rows and bytes at once to Python; for tables with wide binary columns."""
    kept = {}
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        kept[key] = spark.conf.get(key)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def trim() -> None:
    """Gives memory that this Python process has freed back to the system, where that can be asked for."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary one if all runs in one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and (hadoop := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        root = hadoop.get()
    return f"{(root or _own_dir(spark.sparkContext.master)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _own_dir(master: str) -> str:
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="clausemill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
