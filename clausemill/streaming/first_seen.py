"""First-seen texts of a stream, by stateful processing with event-time timers.

Each text (lower-cased and stripped, by its SHA-256) has a state.  The earliest row of the text is
held until the watermark has passed it, so late rows within the delay still win; then it goes out,
once.  Its state stays for ``keep`` longer, in which further rows of the text are dropped, and is then
cleared, so the state holds the texts of that span and no more.  Rows of one text are not gathered: a
batch's rows are reduced to the earliest as they come.

The state needs Spark's RocksDB provider (``spark.sql.streaming.stateStore.providerClass``).  A stream
gives what ``clean.drop_exact_duplicates`` gives by (time, order) on the same rows as a table, so long
as none is later than the delay and the span between first and last row of a text is within ``keep``.
Null texts count as empty; rows without a time are dropped, as they have no place in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from clausemill.functions.text import strip
from clausemill.operators import clean

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Earliest(StatefulProcessor):
    """State of one text: its earliest row, when that was, and whether it has gone out."""

    def __init__(self, given: list[str], columns: list[str], state: StructType, order: list[str], keep: int):
        self.given, self.columns, self.state_type, self.order, self.keep = given, columns, state, order, keep  # Spark renames some of the given columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("earliest", self.state_type)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for own in rows:
            first = own.set_axis(self.given, axis=1).sort_values(["_at", *self.order], kind="stable").iloc[0]
            if best is None or self._rank(first) < self._rank(best):
                best = first
        out = []
        if best is not None:
            at = int(best["_at"])
            known = self.state.get() if self.state.exists() else None
            held = dict(zip(self.columns, known, strict=False)) if known else {}
            if known is None:
                self._put(best)
                self.handle.registerTimer(at)
            elif at > held["_at"] + self.keep:  # its time is over, though the timer has not told so yet
                self.handle.deleteTimer(held["_at"] + self.keep if known[-1] else held["_at"])
                out += [] if known[-1] else [known]
                self._put(best)
                self.handle.registerTimer(at)
            elif not known[-1] and self._rank(best) < self._rank(held):
                self._put(best)
                self.handle.deleteTimer(held["_at"])
                self.handle.registerTimer(at)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        if known is None:
            yield self._frame([])
        elif known[-1]:
            self.state.clear()
            yield self._frame([])
        else:
            self.state.update((*known[:-1], True))
            self.handle.registerTimer(int(known[self.columns.index("_at")]) + self.keep)
            yield self._frame([known])

    def close(self) -> None:
        pass

    def _frame(self, rows: list) -> pd.DataFrame:
        """Rows as plain objects, whatever string type pandas prefers."""
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(self.columns)})

    def _rank(self, row) -> tuple:
        return (int(row["_at"]), *(row[c] for c in self.order))

    def _put(self, row) -> None:
        self.state.update((*(x.item() if hasattr(x, "item") else x for x in (row[c] for c in self.columns)), False))


def first_seen(rows: DataFrame, text: str, time: str, order: list[str], keep: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """The rows of each text that came first by (time, order); ``order`` names columns that tell rows of one time apart."""
    kept = rows.where(F.col(time).isNotNull())
    if not rows.isStreaming:
        return clean.drop_exact_duplicates(kept, text, [time, *order])
    span = int(rows.sparkSession.sql(f"SELECT CAST(timestamp_millis(0) + INTERVAL {keep} AS DOUBLE) * 1000").first()[0])
    timed = kept.withColumn("_at", F.unix_millis(time)).withColumn("_key", F.sha2(F.lower(strip(F.coalesce(F.col(text), F.lit("")))), 256))
    out = StructType([*(f for f in rows.schema.fields if f.name != time), StructField("_at", LongType())])
    processor = Earliest(timed.columns, out.names, StructType([*out.fields, StructField("_gone", BooleanType())]), order, span)
    made = timed.withWatermark(time, delay).groupBy("_key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
    return made.withColumn(time, F.timestamp_millis("_at")).select(rows.columns)
