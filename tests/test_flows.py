"""Reports, samples, ranks, vectors, n-grams, files, models and whole flows on small tables."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clausemill.functions.lexicon import LABELS
from clausemill.operators import ml, ngrams, rank, report, sample, vectors
from clausemill.plans import catalog, corpus
from clausemill.sources import files
from clausemill.streaming.clauses import label_counts, scored_stream

CLAUSES = [
    "Employees must never share their passwords and any failure to comply will result in immediate termination of employment",
    "A student who is found to have cheated shall be subject to expulsion and criminal prosecution by the authorities",
    "Participants may be given a formal warning if they miss more than two of the weekly meetings in the term",
    "The committee will monitor the use of the rooms and may note any issue in the yearly report it makes",
    "Visitors are welcome to walk in the garden and they can take pictures of the flowers and trees there",
    "Members should consider using the online form because it is the simplest way to request a new card",
]


def docs(spark):
    rows = [(d, f"doc{k}", "\n\n".join(f"{c} item {k} {d}" for c in CLAUSES[k % 3 :])) for k in range(6) for d in ("hr", "legal")]
    return spark.createDataFrame([*rows, ("hr", "copy", rows[0][2]), ("hr", "none", None)], "domain string, source_doc string, text string")


def test_metrics_of_a_known_matrix(spark):
    matrix = [[180, 11, 0, 9], [0, 185, 5, 10], [0, 0, 197, 3], [0, 8, 22, 170]]
    names = ["Critical", "High", "Low", "Medium"]
    rows = spark.createDataFrame([(a, p, n) for a, row in zip(names, matrix) for p, n in zip(names, row)], "a string, p string, n int").withColumn("_", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1))))).where("n > 0")
    m = {r.label: r for r in report.class_metrics(rows, "a", "p").collect()}
    assert m["accuracy"].precision == pytest.approx(0.9150) and m["Critical"].precision == 1.0 and m["Critical"].recall == pytest.approx(0.9) and m["Critical"].f1 == pytest.approx(0.9474, abs=1e-4) and m["macro avg"].support == 800
    c = {r.a: r for r in report.confusion(rows, "a", "p").collect()}
    assert (c["Medium"].High, c["Medium"].Low, c["Low"].Critical) == (8, 22, 0)
    assert report.mistakes_by_class(rows, "a", "p").agg(F.sum("n")).first()[0] == 68


def test_reports(spark):
    rows = spark.createDataFrame([("a", "High", 1.0), ("a", "High", 3.0), ("b", "Critical", 5.0), (None, "Medium", 11.0)], "d string, l string, v double")
    p = {r.d: r for r in report.pivot(rows, "d", "l").collect()}
    assert p["a"].High == 2 and p["a"].Low == 0 and p[None].Medium == 1
    s = report.summary(rows, "v").first()
    assert (s["count"], s["mean"], s.p25, s.p50, s.p75, s["sum"]) == (4, 5.0, 2.5, 4.0, 6.5, 20.0)
    assert {r.d: r.share for r in report.counts(rows, "d").collect()} == {"a": 50.0, "b": 25.0, None: 25.0}
    assert report.imbalance(rows, "l").first().ratio == 2
    ratio = spark.createDataFrame([(1, 4), (5, 8)], "a int, b int")
    assert report.compression(ratio, "a", "b").first().ratio == 0.5
    assert [r.removed for r in report.funnel({"x": rows, "y": rows.limit(1)}).orderBy("ord").collect()] == [0, 3]
    assert report.label_summary(rows, "l").first().asDict() == {"Critical": 1, "High": 2, "Medium": 1, "Low": 0}
    ready = rows.withColumn("vec", F.array(F.lit(0.5)))
    checks = {r.check: r.passed for r in report.readiness(ready, "l", "vec", F.col("d"), 2000, ["v"], 1).collect()}
    assert checks == {"labels": False, "rows": True, "numbers": True, "aligned": False, "terms": True, "features": True, "ratio": False, "all": False}
    assert rows.select(report.bar(F.lit(7), 3)).first()[0] == "██"
    assert report.segmentation_check(spark.range(5).withColumn("word_count", F.lit(20))).first().average_ok


def test_samples_and_ranks(spark):
    rows = spark.createDataFrame([("A", i, 0.9 if i < 2 else 0.8) for i in range(5)] + [("B", 100 + i, 0.1) for i in range(3)], "l string, id int, s double")
    assert [r.id for r in sample.top_per_class(rows, "l", "s", ["id"], 2).where("l = 'A'").orderBy("id").collect()] == [0, 1]
    out = sample.balance(rows, "l", "s", ["id"], 10).collect()
    for name, ids in (("A", range(5)), ("B", range(100, 103))):
        own = [r.id for r in out if r.l == name]
        assert len(own) == 10 and set(own) <= set(ids) and max(own.count(i) for i in ids) <= 10 // len(ids) + 1
    split = sample.stratified_split(spark.range(50).withColumn("l", F.col("id") % 2), "l", ["id"]).groupBy("l").agg(F.count_if("is_test").alias("n")).collect()
    assert [r.n for r in split] == [5, 5]
    a = [r.id for r in sample.shuffled(rows.repartition(1), ["id"]).collect()]
    assert a == [r.id for r in sample.shuffled(rows.repartition(17), ["id"]).collect()] and a != sorted(a)
    assert sample.preview(rows, ["id"], 1, label="l").count() == 2 and sample.preview(rows, ["id"], 3).count() == 3
    assert spark.range(1).select(rank.composite(F.lit("Critical"), F.lit(0.5))).first()[0] == pytest.approx(2.6)
    online = spark.createDataFrame([(0, 0, "High", 90.0), (0, 1, "Critical", 60.0), (0, 2, "High", 95.0)], "doc int, pos int, label string, confidence double")
    assert {r.pos: r["rank"] for r in rank.ranked_online(online, ["doc"], "pos").collect()} == {1: 1, 2: 2, 0: 3}
    big = spark.range(1000).withColumn("risk_score", (F.col("id") * 37 % 101) / 101.0).withColumn("label", F.lit("High")).repartition(9)
    got = rank.ranked(big, "label", "risk_score", ["id"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [(-r.risk_score, r.id) for r in got] == sorted((-r.risk_score, r.id) for r in got)
    assert rank.only_label(online, "label", "High").count() == 2 and rank.only_label(online, "label", "All").count() == 3


def test_vectors(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 2.0]), ("b", 2, [3.0, 0.0]), ("b", 3, [1.0, 0.0]), ("c", 4, [float("nan"), 0.0])], "l string, id int, v array<double>")
    assert {r.label: r.cohesion for r in vectors.cohesion(rows.where("l <> 'c'"), "l", "v", "id").collect()} == {"a": 0.0, "b": 0.5}
    assert [r.similarity for r in vectors.cross_similarity(rows.where("l <> 'c'"), "l", "v", "id").collect()] == [0.5]
    assert vectors.norm_report(rows, "v").first().any_nan and not vectors.norm_report(rows.limit(2), "v").first().any_nan
    assert {(r.id, r.side) for r in vectors.unaligned(rows.where("id > 0"), rows.where("id < 4"), "id").collect()} == {(0, "right"), (4, "left")}


def test_ngrams(spark):
    rows = spark.createDataFrame([(1, "the cat sat"), (2, "The cat ran a"), (3, None)], "id int, t string")
    grams = ngrams.ngrams(ngrams.tokens(F.col("t"), ngrams.COUNT_TOKEN), 1, 3)
    v = {r.term: (r.df, r.tf) for r in ngrams.vocabulary(ngrams.term_counts(rows, "id", grams)).collect()}
    assert v == {"the": (2, 2), "cat": (2, 2), "the cat": (2, 2)}
    assert spark.createDataFrame([("ab c",)], "t string").select(ngrams.char_ngrams(F.col("t"))).first()[0] == [" ab", "ab ", " ab ", " c "]
    counts = ngrams.term_counts(rows.limit(2), "id", ngrams.ngrams(ngrams.tokens(F.col("t"), ngrams.WORD_TOKEN), 1, 1))
    w = {(r.key, r.term): r.weight for r in ngrams.tfidf(counts, ngrams.vocabulary(counts, 1, None), 2).collect()}
    rare, common = math.log(3 / 2) + 1, 1.0
    assert w[(1, "sat")] == pytest.approx(rare / math.sqrt(rare**2 + 2 * common**2))


def test_files(spark, tmp_path):
    for domain, name, data in (("hr", "a.txt", ("word " * 60).encode()), ("hr", "b.txt", b"short"), ("legal", "c.TEXT", "café ".encode("latin-1") * 60), ("legal", "d.pdf", b"%PDF"), ("legal", "e.doc", b"x")):
        (tmp_path / "in" / domain).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / domain / name).write_bytes(data)
    got = files.extract(files.scan(spark, f"file://{tmp_path}/in"))
    m = {r.filename: r for r in files.manifest(got, "/out").collect()}
    assert {k: r.status for k, r in m.items()} == {"a.txt": "ok", "b.txt": "skipped_too_short", "c.TEXT": "ok", "d.pdf": "skipped_too_short" if files.pdf_library() else "no_pdf_library"} and m["a.txt"].output_path == "/out/hr/a.txt" and m["a.txt"].domain == "hr"
    assert {r.source_doc for r in files.documents(got).collect()} == {"a", "c"}
    files.write_documents(files.documents(got), f"{tmp_path}/docs")
    assert spark.read.parquet(f"{tmp_path}/docs").count() == 2
    files.write_text_files(files.documents(got), f"{tmp_path}/text")
    assert (tmp_path / "text" / "domain=hr" / "source_doc=a").exists()
    assert report.extraction_summary(files.manifest(got, "/out")).where("domain = 'hr'").first().skipped == 1
    table = spark.createDataFrame([("C1", 'a "quoted"\nline, with comma', 2)], "clause_id string, raw_text string, word_count int")
    files.write_csv(table, f"{tmp_path}/csv")
    assert files.read_csv(spark, f"{tmp_path}/csv", "clause_id string, raw_text string, word_count int").collect() == table.collect()
    assert spark.createDataFrame([(b"a\xffb",)], "c binary").select(files.decode_lossy(F.col("c"))).first()[0] == "ab"
    assert files.remote_records(spark.createDataFrame([(7, "w " * 30), (8, "w")], "i int, t string"), "t", "i").first().source_doc == "ledgar_0007"
    assert files.scraped(spark.createDataFrame([("<b>" + "w " * 151 + "</b>",), ("x",)], "h string"), "h").count() == 1
    assert files.usable(files.literal_documents(spark, {("hr", "x"): " y " * 40, ("hr", "z"): "a"})).count() == 1
    files.write_report({"r": table}, f"{tmp_path}/report")


def test_master_and_models(spark, tmp_path):
    rows = corpus.master(docs(spark), balanced=20)
    assert tuple(rows.columns) == corpus.MASTER
    table = rows.collect()
    by = {x: sum(r.risk_label == x for r in table) for x in LABELS}
    assert all(n in (0, 20) for n in by.values()) and by["Critical"] == 20 and len({r.clause_id for r in table}) == len(table)
    model = ml.fit(rows, "clean_text", trees=5, boosts=2, n_words=60, n_chars=60)
    out = model.transform(rows)
    assert out.select(F.avg((F.col("risk_label") == F.col("predicted_risk_label")).cast("int"))).first()[0] > 0.8
    assert all(abs(sum(r.probabilities) - 1) < 1e-6 for r in out.limit(5).collect())
    model.save(f"file://{tmp_path}/model")
    again = ml.Ensemble.load(spark, f"file://{tmp_path}/model")
    assert again.transform(rows).select("clause_id", "predicted_risk_label").orderBy("clause_id").collect() == out.select("clause_id", "predicted_risk_label").orderBy("clause_id").collect()
    assert model.importance(spark).count() == 15
    assert ml.predict_one(model, spark, "must result in termination", {"modal_score": "0.9", "word_count": ""}).count() == 1
    errors = corpus.error_analysis(model, rows, ["clause_id"])
    assert set(errors) == {"errors", "top", "breakdown", "metrics"} and errors["errors"].count() == errors["breakdown"].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    assert corpus.predictions(model, rows).first().confidence.endswith("%")
    online = corpus.analyze(spark, "\n\n".join(CLAUSES), model=model).orderBy("rank").collect()
    assert [r["rank"] for r in online] == [1, 2, 3, 4, 5, 6]


def test_analyze_without_model(spark):
    rows = corpus.analyze(spark, "\n\n".join(CLAUSES)).orderBy("rank").collect()
    assert rows[0].label == "Critical" and rows[0].badge == "critical" and rows[-1].label == "Low"
    with pytest.raises(ValueError):
        corpus.analyze(spark)
    assert corpus.analyze(spark, "").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    stamped = docs(spark).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    stamped.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(stamped.schema).parquet(f"{tmp_path}/in")
    query = scored_stream(stream, time="ts").writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.raw_text, r.risk_label) for r in spark.table("scored").collect()}
    assert got == {(r.raw_text, r.risk_label) for r in scored_stream(stamped).collect()} and got
    assert label_counts(scored_stream(stamped, time="ts"), "ts").agg(F.sum("n")).first()[0] == len(got)


def test_the_members_have_the_sizes_asked_for(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ml.T, "boost", lambda data, rounds, **given: seen.append((rounds, given)))
    monkeypatch.setattr(ml.T, "randomised", lambda data, trees, **given: seen.append((trees, given)))
    ml.fit(corpus.master(docs(spark), balanced=20), "clean_text", n_words=20, n_chars=20)
    assert seen == [(300, {"depth": 8, "l2": 0.5, "row_share": 0.9, "feature_share": 0.8, "seed": 42}), (300, {"depth": 8, "leaves": 31, "l2": 0.0, "few": 5, "seed": 42}), (300, {"few": 2, "seed": 42})]


def test_char_tfidf_against_brute_force_and_its_sql(spark, tmp_path):
    import duckdb

    texts = {1: "The old mill, the river.", 2: "a Mill by é ñandú", 3: None, 4: "  ", 5: "the the the ab abc abcd"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tf = {i: Counter(x[k : k + n] for w in (t or "").lower().split() for x in [f" {w} "] for n in (3, 4, 5) for k in range(len(x) - n + 1)) for i, t in texts.items()}
    df = Counter(g for c in tf.values() for g in c)
    raw = {i: {g: (1 + math.log(k)) * (math.log(6 / (1 + df[g])) + 1) for g, k in c.items()} for i, c in tf.items()}
    want = {(i, g): w / math.sqrt(sum(x * x for x in own.values())) for i, own in raw.items() for g, w in own.items()}
    got = {(r.doc_id, r.term): r.weight for r in catalog.QUERIES["n11_char_tfidf"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = {(i, g): w for i, g, w in db.execute(catalog.SQL["n11_char_tfidf"]).fetchall()}
    assert {len(g) for _, g in got} == {3, 4, 5} and got.keys() == want.keys() == sql.keys()
    assert all(abs(got[k] - w) < 2e-5 and abs(sql[k] - w) < 2e-5 for k, w in want.items())


def _below_the_deal(plan: str) -> list[str]:
    """The filters of a physical plan that stand below the first exchange."""
    at = next(i for i, line in enumerate(plan.splitlines()) if "REPARTITION_BY_NUM" in line)
    return [line for line in plan.splitlines()[at:] if "- Filter " in line]


@pytest.mark.parametrize("name", ["g14_numbered", "g06_definitions", "g08_numbered_whole", "g07_privacy_sections", "g05_hr_bullets", "g13_lettered", "g09_bullets", "g04_sentences", "g17_online"])
def test_texts_are_cut_after_rows_are_dealt(spark, name):
    """A filter on the clauses, inferred or written, would be computed by the few tasks of the scan."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not _below_the_deal(plan)


def test_top_terms_are_those_of_all_counts(spark, monkeypatch):
    """With any number of buckets: a few that terms share, and the usual ones; ties, and terms of one row."""
    rows = spark.createDataFrame([(i, " ".join(f"w{'abcdefghij'[(i * k) % 10]}{'xy'[k % 2]}" for k in range(1 + i % 9))) for i in range(60)], "id long, t string")
    grams = ngrams.ngrams(ngrams.tokens(F.col("t"), ngrams.COUNT_TOKEN), 1, 3)
    for most in (3, 10, 10_000):
        wanted = ngrams.vocabulary(ngrams.term_counts(rows, "id", grams), 2, most).collect()
        for buckets in (7, 1 << 20):
            monkeypatch.setattr(ngrams, "BUCKETS", buckets)
            assert ngrams.top_terms(rows, grams, 2, most).collect() == wanted
