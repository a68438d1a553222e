"""A sink of plain text files: one file a document, no folder of its own for each.

    spark.dataSource.register(folder.TextFiles)
    told = folder.write(docs, root)               # root/domain/source_doc.txt
    folder.read(told, root)                       # what the files hold

Every document is written under a temporary name and then renamed, so a reader sees whole files only,
and an attempt that is repeated, or runs twice at once, ends in the same files.  Each task has a hidden
folder of its own for that, where tasks do not wait for each other; what it has written is listed there.
When the job commits, ``_SUCCESS`` tells how many files there are; when it fails, what it wrote goes.  Two documents of one place are an error before anything is written.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from clausemill.plans.stages import cut
from clausemill.sources.arrays import opened

#: Documents of a task, about; rows and bytes of a batch of what is read.
PER_TASK, BATCH, BATCH_BYTES = 2_000, 1_000, 1 << 24


@dataclass
class Placed(WriterCommitMessage):
    """How many files one task has written, and the hidden folder that lists them."""

    folder: str
    n: int


class Writer(DataSourceArrowWriter):
    """Files of (place, text); texts are UTF-8, a null text is an empty file."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = opened(self.path)
        own, n, known = f".{uuid.uuid4().hex}", 0, set()
        system.create_dir(f"{root}/{own}", recursive=True)
        try:
            with system.open_output_stream(f"{root}/{own}/places") as places:
                for batch in batches:
                    for place, text in zip(batch.column("place").to_pylist(), batch.column("text").to_pylist(), strict=True):
                        folder = place.rsplit("/", 1)[0]
                        if folder not in known:
                            system.create_dir(f"{root}/{folder}", recursive=True)
                            known.add(folder)
                        with system.open_output_stream(f"{root}/{own}/next") as stream:
                            stream.write((text or "").encode("utf-8", "surrogatepass"))
                        system.move(f"{root}/{own}/next", f"{root}/{place}")
                        places.write(f"{place}\n".encode("utf-8", "surrogatepass"))
                        n += 1
        except BaseException:
            system.delete_dir(f"{root}/{own}")
            raise
        return Placed(own, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_SUCCESS") as stream:
            stream.write(f"{sum(m.n for m in messages if m)}\n".encode())
        for message in filter(None, messages):
            system.delete_dir(f"{root}/{message.folder}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.path)
        for message in filter(None, messages):
            with system.open_input_stream(f"{root}/{message.folder}/places") as stream:
                for line in io.TextIOWrapper(stream, "utf-8", "surrogatepass", newline="\n"):
                    place = line.removesuffix("\n")
                    if system.get_file_info(f"{root}/{place}").type == fs.FileType.File:
                        system.delete_file(f"{root}/{place}")
            system.delete_dir(f"{root}/{message.folder}")


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "place string, text string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def _part(c: Column) -> Column:
    """A name that is one part of a path: other signs than letters, digits, ``._-`` and blanks, and leading periods, become ``%`` with their hexadecimal UTF-8 bytes."""
    c = F.replace(c, F.lit("%"), F.lit("%25"))
    strange = F.regexp_extract_all(c, F.lit(r"^\.|[^\p{L}\p{N}._ %-]"), F.lit(0))
    return F.aggregate(F.array_distinct(strange), c, lambda acc, x: F.when(x == ".", F.regexp_replace(acc, r"^\.", "%2E")).otherwise(F.replace(acc, x, F.concat(F.lit("%"), F.hex(F.encode(x, "UTF-8"))))))


def dealt(rows: DataFrame, n: int, key: str) -> DataFrame:
    """n rows in tasks of about ``PER_TASK``; more tasks stay as they are. A file takes a time of its own, so the rows count and not their bytes."""
    tasks = -(-n // PER_TASK)
    return rows.repartition(tasks, key) if rows.rdd.getNumPartitions() < tasks else rows


def write(docs: DataFrame, root: str, extension: str = ".txt") -> DataFrame:
    """Writes (domain, source_doc, text) as root/domain/source_doc.txt; returns the table (domain, source_doc, place, n_bytes, no_text) of what was asked for. Null names become ``_``."""
    docs.sparkSession.dataSource.register(TextFiles)
    name = [F.when(F.coalesce(c, F.lit("")) == "", F.lit("_")).otherwise(_part(c)) for c in (F.col("domain"), F.col("source_doc"))]
    rows = docs.select("domain", "source_doc", F.concat(name[0], F.lit("/"), name[1], F.lit(extension)).alias("place"), "text")
    counts = rows.groupBy("place").count()
    total: Row = counts.agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    if (total.most or 0) > 1:
        twice: list[Row] = counts.where("count > 1").limit(3).collect()
        raise ValueError(f"several documents of one place: {[r.place for r in twice]}")
    dealt(rows.select("place", "text"), total.n or 0, "place").write.format("text_files").mode("append").save(root)
    return rows.select("domain", "source_doc", "place", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"), F.col("text").isNull().alias("no_text"))


def read(told: DataFrame, root: str) -> DataFrame:
    """(domain, source_doc, place, content) of the files that ``write`` has told of, empty ones too; content is null where the text was.

    Tasks open the files by their places.  Spark's file sources would list them all in the driver, and leave out empty ones.
    """
    spark, kind = told.sparkSession, "domain string, source_doc string, place string, content binary"
    held = cut(told, "places")

    def run(batches):
        system, base = opened(root)
        rows, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                content = None
                if not row.pop("no_text"):
                    with system.open_input_stream(f"{base}/{row['place']}") as stream:
                        content = stream.read()
                rows.append(row | {"content": content})
                size += len(content or b"")
                if len(rows) >= BATCH or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("domain", pa.string()), ("source_doc", pa.string()), ("place", pa.string()), ("content", pa.binary())])
    least = spark.sparkContext.defaultParallelism
    tasks = max(least, -(-held.count() // PER_TASK))
    return held.select("domain", "source_doc", "place", "no_text").repartition(tasks, "place").mapInArrow(run, kind)


def name_of(place: str) -> str:
    """The name that ``write`` has put into a part of a path."""
    return re.sub("((?:%[0-9A-F]{2})+)", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(), place)
