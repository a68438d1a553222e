"""First-seen texts: stream equals batch with late and repeated rows, over a restart, and time-outs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clausemill.streaming import first_seen
from clausemill.streaming.clauses import scored_stream

SCHEMA = "id long, domain string, source_doc string, text string, ts timestamp"
START = dt.datetime(2024, 1, 1, 12)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(key)
    spark.conf.set(key, first_seen.PROVIDER)
    yield spark
    spark.conf.set(key, kept)


def run(spark, folder, checkpoint, out, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    found = first_seen.first_seen(stream, "text", "ts", ["id"], **how)
    query = found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(240)


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def minutes(n):
    return START + dt.timedelta(minutes=n)


def test_stream_equals_batch_over_a_restart(rocks, tmp_path):
    spark, r = rocks, random.Random(5)
    rows = [(i, "hr", f"d{i % 5}", r.choice([f"Text {i % 23} must be paid.", f" TEXT {i % 23} must be paid. ", None, ""]), minutes(i // 3 - r.choice([0, 0, 5, 40]))) for i in range(240)]
    rows.append((999, "hr", "x", "no time", None))
    batches = [rows[:80], rows[80:81] * 3, rows[80:160], rows[160:], [(1000, "hr", "end", "the end", minutes(10_000))]]
    (tmp_path / "in").mkdir()
    for k, own in enumerate(batches[:3]):
        put(spark, tmp_path / "in", own, f"b{k}")
    flat = lambda: str(tmp_path / "in" / "*")
    run(spark, flat(), tmp_path / "c", tmp_path / "out")
    for k, own in enumerate(batches[3:], 3):
        put(spark, tmp_path / "in", own, f"b{k}")
    run(spark, flat(), tmp_path / "c", tmp_path / "out")  # goes on from its checkpoint
    got = sorted(map(tuple, spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()))
    table = spark.createDataFrame(sum(batches[:4], []), SCHEMA)
    want = sorted(map(tuple, first_seen.first_seen(table.distinct(), "text", "ts", ["id"]).collect()))
    assert [x for x in got if x[0] != 1000] == want and len(want) == 24
    scored = scored_stream(spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")))
    assert scored.columns[-2:] == ["risk_score", "risk_label"]


def test_states_time_out(rocks, tmp_path):
    """After ``keep`` a text is new again; within it, and within the delay, it is not."""
    spark = rocks
    for k, (i, text, at) in enumerate([(1, "a", 0), (2, "a", 50), (3, "b", 100), (4, "c", 300), (5, "a", 310), (6, "z", 900), (7, "z2", 1900)]):
        put(spark, tmp_path / "in", [(i, "hr", "d", text, minutes(at))], f"b{k}")
    run(spark, str(tmp_path / "in" / "*"), tmp_path / "c", tmp_path / "out", keep="2 hours", delay="10 minutes")
    got = spark.read.schema(SCHEMA).parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in got.where(F.col("id") < 6).collect()) == [1, 3, 4, 5]
