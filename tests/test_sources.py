"""Array files and text files as data sources: round trips, ranges, retries."""

import io
import pickle

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausemill.plans import catalog, stored  # noqa: F401  stored registers queries
from clausemill.sources import arrays, files, folder


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(arrays.ArraySource)
    return spark


def load(spark, path, **options):
    return spark.read.format("arrays").options(**options).load(str(path))


def back(rows):
    return np.array([r.vector for r in sorted(rows, key=lambda r: r.row)])


def test_matrices_of_numpy_are_read_by_many_tasks(source, tmp_path):
    r = np.random.default_rng(1)
    held = {"a": r.normal(size=(1_003, 8)), "f32": r.normal(size=(50, 3)).astype("<f4"), "big": r.integers(-5, 5, (20, 2)).astype(">i4"), "labels": r.integers(0, 4, 77), "flags": np.array([True, False]), "none": np.zeros((0, 5)), "one": np.asfortranarray(r.normal(size=(9, 1)))}
    for name, x in held.items():
        np.save(tmp_path / f"{name}.npy", x)
    np.savez(tmp_path / "both.npz", first=held["a"], second=held["labels"])
    np.savez_compressed(tmp_path / "small.npz", third=held["f32"])
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "x.npy").write_bytes(b"half a file")
    (tmp_path / "note.txt").write_text("x")
    df = load(source, tmp_path, rowsPerTask=100)
    assert df.where("file LIKE '%/a.npy'").rdd.getNumPartitions() > 11
    rows = df.collect()
    for name, x in held.items():
        own = [v for v in rows if v.file.endswith(f"/{name}.npy")]
        assert len(own) == len(x) and sorted(v.row for v in own) == list(range(len(x)))
        if len(x):
            assert np.array_equal(back(own), x.reshape(len(x), -1).astype(float))
    for member, x in (("first", held["a"]), ("second", held["labels"]), ("third", held["f32"])):
        assert np.array_equal(back([v for v in rows if v.member == member]), x.reshape(len(x), -1).astype(float))
    assert load(source, tmp_path / "a.npy").count() == 1_003


@pytest.mark.parametrize("array", [np.array([{}], object), np.array(["x"]), np.zeros((2, 2, 2)), np.asfortranarray(np.ones((3, 2)))])
def test_what_cannot_be_cut_is_refused(source, tmp_path, array):
    np.save(tmp_path / "x.npy", array, allow_pickle=True)
    with pytest.raises(Exception, match="only vectors|not numbers"):
        load(source, tmp_path).collect()


def test_truncated_files_are_errors(source, tmp_path):
    out = io.BytesIO()
    np.save(out, np.ones((100, 4)))
    (tmp_path / "x.npy").write_bytes(out.getvalue()[:-8])
    with pytest.raises(Exception, match="ends within its data"):
        load(source, tmp_path).collect()


def test_round_trip_and_overwrite(source, tmp_path):
    rows = source.range(2_500).repartition(3).select(F.array(F.col("id").cast("double"), F.rand(1), F.lit(-0.5)).alias("vector"))
    want = sorted(tuple(r.vector) for r in rows.collect())
    path = str(tmp_path / "out")
    rows.write.format("arrays").mode("append").option("rowsPerFile", 400).save(path)
    files = list((tmp_path / "out").iterdir())
    assert len(files) >= 7 and all(f.suffix == ".npy" for f in files) and sum(len(np.load(f)) for f in files) == 2_500
    assert sorted(tuple(r.vector) for r in load(source, path, rowsPerTask=90).collect()) == want
    rows.limit(10).write.format("arrays").mode("overwrite").option("kind", "float32").save(path)
    again = [np.load(f) for f in (tmp_path / "out").iterdir()]
    assert sum(map(len, again)) == 10 and {x.dtype for x in again} == {np.dtype("float32")}
    with pytest.raises(Exception, match="one length"):
        source.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>").coalesce(1).write.format("arrays").mode("append").save(path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == []


def test_attempts_that_do_not_commit_leave_nothing(tmp_path):
    batch = pa.RecordBatch.from_pylist([{"vector": [1.0, 2.0]}] * 5)
    writer = arrays.Writer(str(tmp_path), 2, "float64", False)
    writer.write(iter([batch]))  # lost
    writer.commit([writer.write(iter([batch])), None])
    assert sum(len(np.load(f)) for f in tmp_path.iterdir()) == 5 and not (tmp_path / "_temporary").exists()
    writer.write(iter([batch]))
    writer.abort([])
    assert sum(len(np.load(f)) for f in tmp_path.iterdir()) == 5


def test_a_hundred_thousand_documents_are_as_many_files(spark, tmp_path):
    docs = spark.range(100_000).select(F.concat(F.lit("d"), F.col("id") % 4).alias("domain"), F.concat(F.lit("doc-"), "id").alias("source_doc"), F.concat(F.lit("text é "), "id").alias("text"))
    told = folder.write(docs, str(tmp_path / "out"))
    kinds = [p for d in (tmp_path / "out").iterdir() if d.is_dir() for p in d.iterdir()]
    assert len(kinds) == 100_000 and all(p.is_file() and p.suffix == ".txt" for p in kinds)
    assert (tmp_path / "out" / "d1" / "doc-4321.txt").read_text() == "text é 4321" and (tmp_path / "out" / "_SUCCESS").read_text() == "100000\n"
    assert told.where("source_doc = 'doc-7'").first().n_bytes == len("text é 7".encode())


def test_names_repeats_and_retries(spark, tmp_path):
    names = ["a/b", "../x", ".hidden", "50% of :", "é ü", "a%2Fb", "", None, "x\ny"]
    docs = spark.createDataFrame([("hr/..", n, f"t{i}") for i, n in enumerate(names[:7])] + [(None, "x\ny", None)], "domain string, source_doc string, text string")
    rows = folder.write(docs, str(tmp_path)).collect()
    assert len({r.place for r in rows}) == 8 and all(r.place.count("/") == 1 and not r.place.split("/")[1].startswith(".") for r in rows)
    for r in rows:
        assert folder.name_of(r.place.split("/")[1].removesuffix(".txt")) == (r.source_doc or "_")
        assert (tmp_path / r.place).exists()
    assert all(p.resolve().is_relative_to(tmp_path) for p in tmp_path.rglob("*.txt")) and len(list(tmp_path.rglob("*.txt"))) == 8
    with pytest.raises(ValueError, match="several documents"):
        folder.write(docs.union(docs.limit(1)), str(tmp_path))
    writer = folder.Writer(str(tmp_path / "again"))
    batch = pa.RecordBatch.from_pylist([{"place": "d/x.txt", "text": "one"}, {"place": "d/y.txt", "text": None}])
    writer.write(iter([batch]))
    writer.commit([writer.write(iter([batch])), None])
    assert sorted(p.name for p in (tmp_path / "again" / "d").iterdir()) == ["x.txt", "y.txt"]
    writer.abort([writer.write(iter([batch]))])
    assert list((tmp_path / "again" / "d").iterdir()) == []


def test_lossy_decoding_keeps_replacement_characters_of_the_text(spark):
    cases = {b"a\xffb": "ab", "a\ufffdb".encode(): "a\ufffdb", b"\xef\xbf": "", b"\xef\xbf\xbd\xbd": "\ufffd", "é漢\U0001f600".encode() + b"\xe6\xbc": "é漢\U0001f600", b"": ""}
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "c binary")
    assert {bytes(r.c): r.t for r in df.select("c", files.decode_lossy(F.col("c")).alias("t")).collect()} == cases


def test_text_files_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Tasks were those of the scan, however many documents each had; what a task tells the driver does not grow with its files."""
    monkeypatch.setattr(folder, "PER_TASK", 50)
    docs = spark.range(1_000).coalesce(1).select(F.lit("a").alias("domain"), F.col("id").cast("string").alias("source_doc"), F.lit("x").alias("text"))
    folder.write(docs, str(tmp_path / "out"))
    read = files.scan(spark, str(tmp_path / "out"))
    assert read.count() == 1_000 and not [x for x in (tmp_path / "out").iterdir() if x.is_dir() and x.name != "a"]
    assert read.rdd.getNumPartitions() <= 32
    assert folder.dealt(docs, 1_000, "source_doc").rdd.getNumPartitions() == 20 and folder.dealt(docs, 40, "source_doc").rdd.getNumPartitions() == 1
    writer = folder.Writer(str(tmp_path / "again"))
    told = [writer.write(iter([pa.record_batch({"place": [f"d/{i}.txt" for i in range(n)], "text": ["x"] * n})])) for n in (1, 500)]
    assert [m.n for m in told] == [1, 500] and len(pickle.dumps(told[1])) < len(pickle.dumps(told[0])) + 10
    writer.abort(told)
    assert not list((tmp_path / "again").rglob("*.txt"))


def test_extraction_opens_each_file_once(spark, tmp_path):
    """Text and PDF files were two scans of the whole folder."""
    (tmp_path / "a").mkdir()
    for name, data in {"x.txt": b"one  two", "y.pdf": b"no pdf", "z.TEXT": b"three", "w.csv": b"1,2"}.items():
        (tmp_path / "a" / name).write_bytes(data)
    read = files.extract(files.scan(spark, str(tmp_path)))
    assert read._jdf.queryExecution().executedPlan().toString().count("Scan binaryFile") == 1
    got = {r.filename: (r.text, bytes(r.content)) for r in read.collect()}
    assert got == {"x.txt": ("one two", b"one  two"), "y.pdf": (None if not files.pdf_library() else "", b"no pdf"), "z.TEXT": ("three", b"three")}
    plan = files.documents(read)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^\\x20-\\x7E\\n\\t]") == 1  # one of the cleaning's patterns


def test_empty_and_null_texts_and_null_names_come_back_from_files(spark, tmp_path, monkeypatch):
    """Spark's file sources leave out empty files and folders named _, and list all files in the driver (F3, F4, F7, F8, F9)."""
    rows = [(1, "word " * 60, "en"), (2, "", "en"), (3, None, "fr"), (4, "gap\n" * 60, None), (5, "short", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(folder, "BATCH", 2)
    monkeypatch.setattr(files, "scan", None)
    for name in ("s13_text_files", "s16_manifest", "s01_documents"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        known = duckdb.connect()
        known.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = known.execute(catalog.SQL[name])
        order = [x[0] for x in want.description]
        assert sorted(map(str, (tuple(r) for r in got.select(order).collect()))) == sorted(map(str, want.fetchall())), name
