"""CSV files with quoted line breaks, one file read by many tasks.

Spark reads such files with ``multiLine``, one task a file.  Here lines are read in ranges of bytes
as any text file is.  Whether a line begins inside of quotes is not known in the middle of a file,
so each range is followed from both states; what it does to the state is one row, and a prefix pass
over these few rows tells in which state each range begins.  A second pass over the lines puts
records together; only pieces that run over the end of a range are shuffled.

A field is quoted if its first character is a quote; inside, two quotes are one.  Quotes within other
fields are ordinary.  Records end with a line feed, or a carriage return and one.  Empty lines
between records are left out, as Spark does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill.plans.stages import cut


def ends_inside(line: str, inside: bool, separator: str = ",") -> bool:
    """Whether the line ends inside of quotes, given whether it begins there."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            at += 1
            if line[at : at + 1] == '"':
                at += 1
                continue
            inside = False
        else:
            if line[at : at + 1] == '"':
                inside = True
                at += 1
                continue
        at = line.find(separator, at)
        if at < 0:
            return False
        at += 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): lines with the file and the first byte of the range that they are read in, in order within it."""
    own = spark.read.option("lineSep", "\n").text(path)
    return own.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """The lines of a partition, in batches of one range each; a partition may hold several ranges."""
    for batch in batches:
        files, starts, rows = (batch.column(c).to_pylist() for c in ("file", "start", "line"))
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and (files[to], starts[to]) == (files[at], starts[at]):
                to += 1
            yield (files[at], starts[at]), rows[at:to]
            at = to


def _effects(separator: str):
    def run(batches):
        key, state = None, (False, True)

        def row():
            return pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "outside": state[0], "within": state[1]}])

        for own, rows in _ranges(batches):
            if own != key:
                if key:
                    yield row()
                key, state = own, (False, True)
            for line in rows:
                if '"' in line:
                    state = tuple(ends_inside(line, s, separator) for s in state)
        if key:
            yield row()

    return run


def _pieces(begins: dict[tuple[str, int], bool], separator: str):
    """Records, and at either end of a range the pieces of those that other ranges share. Columns: file, start, place (0 a head, 1 a whole record, 2 a tail), n (its order), text."""

    def run(batches):
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("text", pa.string())])
        key, inside, held, place, n = None, False, [], 1, 0
        out: list[dict] = []

        def put(kind: int) -> None:
            out.append({"file": key[0], "start": key[1], "place": kind, "n": n, "text": "\n".join(held)})

        for own, rows in _ranges(batches):
            if own != key:
                if held:
                    put(2 if place == 1 else 3)
                key, inside, held, n = own, begins[own], [], 0
                place = 0 if inside else 1
            for line in rows:
                held.append(line)
                inside = ends_inside(line, inside, separator)
                if not inside:
                    put(place)
                    held, place, n = [], 1, n + 1
            if len(out) > 1_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if held:
            put(2 if place == 1 else 3)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(file, start, n, text): every record of the files, with line breaks inside of quotes; ``start`` and ``n`` give their order."""
    own = lines(spark, path)
    effects = own.mapInArrow(_effects(separator), "file string, start long, outside boolean, within boolean").collect()  # one row a range
    begins: dict[tuple[str, int], bool] = {}
    state, last = False, None
    for r in sorted(effects):
        state = False if r.file != last else state
        begins[r.file, r.start] = state
        state, last = (r.within if state else r.outside), r.file
    found = cut(own.mapInArrow(_pieces(begins, separator), "file string, start long, place long, n long, text string"), "records")
    # a tail (2) begins a record that ranges without an end (3) go on with and a head (0) ends
    parts = found.where("place <> 1")
    order = Window.partitionBy("file").orderBy("start", F.when(F.col("place") == 2, 1).otherwise(0))
    tails = parts.withColumn("record", F.sum((F.col("place") == 2).cast("int")).over(order))
    joined = tails.groupBy("file", "record").agg(F.min("start").alias("start"), F.max("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return found.where("place = 1").select("file", "start", "n", "text").unionByName(joined.select("file", "start", "n", "text"))


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """The rows of CSV files with a header, as Spark's ``multiLine`` reader has them; the schema is given. The order of rows is not kept."""
    found = records(spark, path, separator)
    text = F.regexp_replace("text", r"\r$", "")
    rows = found.where((F.col("start") > 0) | (F.col("n") > 0)).where(text != "")
    return rows.select(_parsed(text, schema, separator).alias("r")).select("r.*")


def _parsed(text: Column, schema: str, separator: str) -> Column:
    return F.from_csv(text, schema, {"escape": '"', "sep": separator, "multiLine": "true", "mode": "PERMISSIVE"})
