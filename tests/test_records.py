"""Quoted CSV in ranges of bytes against Spark's own multiLine reader and Python's csv."""

import csv
import io
import random

import pytest

from clausemill.sources import files, records

SCHEMA = "id string, text string, note string"
PIECES = ["a", "b c", '"', '""', "\n", "\r\n", ",", "é", "\U0001f600", " ", "'", "x" * 30, "\n\n", '",', ',"', '"\n"']


def rows_of(seed, n):
    r = random.Random(seed)
    return [(f"r{i}", "".join(r.choices(PIECES, k=r.randrange(1, 12))), r.choice(["", "n", 'say "hi"', "two\nlines", "l\n" * 40])) for i in range(n)]


def written(path, rows, quoting, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, quoting=quoting, lineterminator=end)
        out.writerow(["id", "text", "note"])
        out.writerows(rows)


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "0"}
    kept = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,quoting,end", [(1, csv.QUOTE_MINIMAL, "\n"), (2, csv.QUOTE_ALL, "\n"), (3, csv.QUOTE_MINIMAL, "\r\n"), (4, csv.QUOTE_ALL, "\r\n")])
def test_equals_the_multiline_reader(spark, tmp_path, small_ranges, seed, quoting, end):
    rows = rows_of(seed, 300)
    (tmp_path / "d").mkdir()
    for k in range(2):
        written(tmp_path / "d" / f"{k}.csv", rows[k::2], quoting, end)
    assert records.lines(spark, str(tmp_path / "d")).rdd.getNumPartitions() > 10
    got = sorted(tuple(r) for r in records.read_csv(spark, str(tmp_path / "d"), SCHEMA).collect())
    want = sorted(tuple(x or None for x in r) for r in rows)
    assert got == want
    whole = sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "d"), SCHEMA).collect())
    assert [tuple((x or "").replace("\r\n", "\n") for x in r) for r in whole] == [tuple((x or "").replace("\r\n", "\n") for x in r) for r in got]


def test_records_over_many_ranges_and_the_order(spark, tmp_path, small_ranges):
    """A field of many ranges, all of it quotes and breaks; order by range and number is that of the file."""
    rows = [("a", "first", ""), ("b", '"\n' * 3_000, "x"), ("c", "\n" * 5_000, ""), ("d", "last", "")]
    written(tmp_path / "x.csv", rows, csv.QUOTE_MINIMAL)
    found = records.records(spark, str(tmp_path / "x.csv")).orderBy("start", "n").collect()
    assert [next(csv.reader(io.StringIO(r.text, newline="")))[0] for r in found] == ["id", "a", "b", "c", "d"]
    assert sorted(tuple(x or "" for x in r) for r in records.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA).collect()) == rows


def test_quotes_in_plain_fields_empty_lines_and_empty_files(spark, tmp_path, small_ranges):
    (tmp_path / "x.csv").write_text('id,text,note\n1,5" nails,a"b\n\n\n2,"x\n\ny",\n3,,""\n')
    assert sorted(tuple(r) for r in records.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA).collect()) == [("1", '5" nails', 'a"b'), ("2", "x\n\ny", None), ("3", None, None)]
    (tmp_path / "y.csv").write_text("")
    (tmp_path / "z.csv").write_text("id,text,note")
    for name in ("y", "z"):
        assert records.read_csv(spark, str(tmp_path / f"{name}.csv"), SCHEMA).collect() == []


def test_every_line_from_both_states():
    cases = {("a,b", False): False, ('a,"b', False): True, ('a,"b"', False): False, ('a,"b""', False): True, ('x"y,z', False): False, ('",a', True): False, ('""', True): True, ('"', True): False, ("", True): True, ('"",""', False): False, ('a""b,"', False): True}
    for (line, inside), want in cases.items():
        assert records.ends_inside(line, inside) == want, (line, inside)
