"""The pipeline on a small table, against its stages stated plainly."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from clausemill.llm import pii, quality
from tests.llm.test_ngram_join import plain_classes

PROSE = "the report says that {} people came to the old town hall on a cold day in march and that most of them left again before the speech about {} had ended"


def rows():
    out = [(i, PROSE.format(f"w{i}", " ".join(f"x{i}y{k}" for k in range(12))), "en", "s", 0) for i in range(12)]
    out += [(20, out[3][1], None, None, None), (21, out[4][1].replace("march", "may"), "en", "s", 0), (22, None, "en", "s", 0), (23, "12 34 !", "en", "s", 0)]
    out += [(24, "word " * 40, "en", "s", 0), (25, out[5][1] + " write to ann@mail.example.org or +1 (743) 555-3824 " + " ".join(f"q{k}" for k in range(30)), "en", "s", 0)]
    return out


def test_pipeline(spark, tmp_path):
    table = rows()
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {i: t for i, t, *_ in table if t and any(c.isalpha() for c in t)}
    texts = {i: t for i, t in texts.items() if not any(r.rejects(quality.Document(t)) for r in quality.rules())}
    groups = plain_classes(list(texts.items()))
    field = pii.learn(sorted(t for i, t in texts.items() if groups[i][1] == i))
    texts = {i: pii.mask(t, field) for i, t in texts.items() if groups[i][1] == i}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert {r.doc_id: r.doc_tokens for r in got} == want
    assert {20, 22, 23, 24}.isdisjoint(want) and 25 in want and "ann@" not in texts[25]


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


def test_language_stage_rejects_what_no_filter_knows(spark):
    russian, greek = "это простой текст о погоде и старой мельнице у реки", "η παλιά πόλη δίπλα στο ποτάμι"
    # 107 and 108 are held out, so nothing is learnt from them
    more = [(100, russian, None, "s", 0), (107, f"{russian} и {russian} the", "en", "s", 0), (108, greek, "el", "s", 0), (103, "12 34", "el", "s", 0), (104, PROSE, None, "s", 0), (105, "the town hall", None, "s", 0)]
    docs = spark.createDataFrame(rows() + more, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert {100, 107, 103}.isdisjoint(got) and [got[i] for i in (108, 104, 105)] == ["el", "en", "en"]
    assert {i for i in got if i < 100} == {i for i, t, *_ in rows() if t and any(c.isalpha() for c in t)}


def test_columns_with_the_operators_names_stay(spark):
    docs = spark.createDataFrame([(*r, 777.0, f"p{r[0]}") for r in rows()], "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[-2:] == ["score", "lang_pred"]
    assert {(r.score, r.lang_pred == f"p{r.doc_id}") for r in docs.collect()} == {(777.0, True)}


def test_columns_of_any_name(spark):
    names = ("once", "often", "set", "set_", "component", "component_id", "n", "whole", "id", "hash", "sample")
    table = [(*r, *names) for r in rows()] + [(None, rows()[3][1], "en", "s", 0, *names), (7, rows()[8][1], "en", "s", 0, *names)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[5:] == list(names)
    assert {tuple(r)[5:] for r in docs.collect()} == {names}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count() > 5
