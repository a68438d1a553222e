"""Shared folders, rows of null domain, splits, quartiles, PDF status and result cards."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clausemill.functions import dom
from clausemill.operators import clean, ngrams, report, sample, vectors
from clausemill.plans import corpus, stages
from clausemill.sources import files


def test_no_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            stages._own_folder.__wrapped__(master)
    assert stages._own_folder.__wrapped__("local[4]").startswith("file:///")


def test_near_duplicates_of_a_null_domain(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(None, 1, " ".join(base)), (None, 2, " ".join([*base[:39], "x"])), (None, 3, "other words"), ("a", 4, " ".join(base)), ("a", 5, " ".join([*base[:38], "y"])), (None, 6, None), (None, 7, "")]
    out = clean.drop_near_duplicates(spark.createDataFrame(rows, "domain string, place long, text string"), "domain", "place", "text")
    assert sorted(r.place for r in out.collect()) == [1, 3, 4, 6, 7]


def test_split_is_stratified_and_whole(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), f"t{i % 70}", i) for i in range(300)]
    out = sample.stratified_split(spark.createDataFrame(rows, "label string, text string, i int"), "label", ["text"], 0.25).collect()
    assert len(out) == 300
    for label in ("a", "b", None):
        texts = {x.text for x in out if x.label == label}
        test = {x.text for x in out if x.label == label and x.is_test}
        assert len(test) == len(texts) // 4 and not test & {x.text for x in out if x.label == label and not x.is_test}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 200])
def test_summary(spark, n):
    values = [random.Random(n).randrange(50) + 0.5 for _ in range(n)]
    one = report.summary(spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3), "v").first()
    assert one["count"] == n
    if n:
        assert np.allclose([one["p25"], one["p50"], one["p75"], one["mean"], one["min"], one["max"]], [*np.percentile(values, [25, 50, 75]), np.mean(values), min(values), max(values)])
    else:
        assert one["p50"] is None and one["mean"] is None


def test_terms_are_counted_without_a_shuffle_of_terms(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "doc long, text string")
    counts = ngrams.term_counts(rows, "doc", ngrams.ngrams(ngrams.tokens(F.col("text"), ngrams.WORD_TOKEN.replace(r"\w\w+", r"\w+")), 1, 2))
    assert {(r.key, r.term, r.tf) for r in counts.collect()} == {(1, "a", 2), (1, "b", 1), (1, "a b", 1), (1, "b a", 1)}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_a_missing_pdf_library_shows_in_the_manifest(spark, tmp_path, monkeypatch):
    (tmp_path / "legal").mkdir()
    (tmp_path / "legal" / "a.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "legal" / "b.txt").write_text("word " * 60)
    monkeypatch.setattr(files, "pdf_library", lambda: None)
    found = files.manifest(files.extract(files.scan(spark, f"file://{tmp_path}")), f"{tmp_path}/out")
    assert {(r.filename, r.status) for r in found.collect()} == {("a.pdf", "no_pdf_library"), ("b.txt", "ok")}
    assert files.online_pdf(files.scan(spark, f"file://{tmp_path}").where("extension = 'pdf'")).first().text is None


def test_result_cards(spark):
    text = "The employee shall pay a penalty and may be terminated if any of these rules is broken by them; the company may also provide a desk to each of its people in the office"
    head, cards = report.cards(corpus.analyze(spark, text))
    assert head.first().total == cards.count() > 0 and cards.columns[:3] == ["doc", "rank", "clause"]


def test_too_many_labels_are_not_crossed(spark):
    rows = spark.range(10_002).select(F.col("id").alias("label"), F.array(F.lit(1.0)).alias("v"), "id")
    with pytest.raises(ValueError, match="too many"):
        vectors.cross_similarity(rows, "label", "v", "id")


def test_a_scan_of_one_file_uses_all_cores(spark, tmp_path):
    spark.range(100).withColumn("text", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/t")
    scan = spark.read.parquet(f"{tmp_path}/t")
    out = stages.spread(scan)
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and out.count() == 100
    assert stages.spread(out) is out
    plan = stages.spread(scan).where("id > 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in plan


def test_ids_and_tokens_as_their_sql_has_them(spark, tmp_path):
    """Six digits are cut as lpad cuts them, no tokens are null, cannot is one run of letters."""
    rows = spark.range(100_001).select("id", F.lit("a").alias("source"), F.when(F.col("id") == 0, "12 34").when(F.col("id") == 1, "We cannot İx").when(F.col("id") == 2, "").otherwise("b").alias("text"))
    rows.withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    found = {n: {r.doc_id: r for r in entry.queries()[n](spark, str(tmp_path)).where("doc_id < 3 OR doc_id > 99997").collect()} for n in ("b05_numbered_ids", "n05_token_set", "n06_modal_tokens", "n07_plain_tokens")}
    assert [found["b05_numbered_ids"][k].clause_id for k in (0, 99_998, 99_999, 100_000)] == ["C00001", "C99999", "C10000", "C10000"]
    assert [(found["n06_modal_tokens"][k].n, found["n06_modal_tokens"][k].tokens) for k in (0, 1, 2)] == [(0, None), (3, "we cannot ix"), (0, None)]
    assert found["n07_plain_tokens"][2].tokens is None is found["n05_token_set"][2].tokens


def test_pages_of_a_batch_are_not_python_strings_at_once():
    """A worker held a batch of 10,000 pages, and their texts, as Python strings."""
    pages = pa.array([f"<nav>x</nav><p>{i} {'word ' * 4_000}</p>" for i in range(1_500)] + [None])
    tracemalloc.start()
    got = dom.stripped(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000 < 20_000 * 1_500
    assert got.to_pylist() == [dom.visible_text(x) for x in pages.to_pylist()]
