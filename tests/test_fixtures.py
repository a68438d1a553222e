"""Hand-worked cases for cleaning, segmentation, filters, scores and features."""

import pytest
from pyspark.sql import functions as F

from clausemill.functions import dom
from clausemill.functions import text as T
from clausemill.functions.lexicon import FEATURES, POLICY
from clausemill.operators import clean, score, segment

PASS1 = [
    ("We must trust each other", 0.9, 0, 0, 1, 0.0338, "Low"),
    ("Violations must result in termination", 0.9, 1.0, 0.85, 1, 0.9375, "Critical"),
    ("Termination may follow a reasonable review", 0.3, 1.0, 0, 0.8, 0.6, "High"),
    ("A minor breach is strictly handled", 0, 0.8, 0, 0.7, 0.28, "Medium"),
    ("Gross misconduct leads to dismissal", 0, 1.0, 0, 1.35, 1.0, "Critical"),
    ("The determination is final", 0, 1.0, 0, 1, 0.75, "Critical"),
    ("Terms are defined below", 0, 0.85, 0, 1, 0.425, "Medium"),
    ("This agreement is made in London", 0, 0.2, 0, 1, 0.1, "Medium"),
    ("Students are encouraged to attend office hours", 0.1, 0.1, 0, 0.65, 0.0488, "Low"),
    ("Employees shall not share passwords and must not reuse them", 0.9, 0, 0.85, 1, 0.4375, "Medium"),
    ("The obligation and the fine", 0, 0.85, 0, 1, 0.425, "Medium"),
    ("Late work attracts a deduction unless excused", 0, 0.45, 0.5, 1, 0.35, "Medium"),
]
FEATURE = [
    ("We must trust each other", (0.9, 0, 0, 0, 5, 1, 0)),
    ("Violations must result in termination", (0.9, 1.0, 0.85, 0, 5, 1, 1)),
    ("The obligation and the fine", (0, 0.45, 0, 0, 5, 0, 0)),
    ("Employees shall not share passwords and must not reuse them", (0.9, 0, 0.85, 1, 10, 2, 0)),
    ("A minor breach is strictly handled", (0, 0.8, 0, 0, 6, 0, 1)),
    ("Terms are defined below", (0, 0.85, 0, 0, 4, 0, 1)),
]


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def apply(spark, texts, f):
    return [r.x for r in table(spark, texts).select("id", f(F.col("text")).alias("x")).orderBy("id").collect()]


def test_first_pass(spark):
    rows = score.first_pass(table(spark, [p[0] for p in PASS1]), "text", POLICY).withColumn("s", score.rounded(F.col("p1"))).withColumn("label", score.label(F.col("s"))).orderBy("id").collect()
    for r, (_, modal, cons, cond, amp, s, label) in zip(rows, PASS1, strict=True):
        assert (r.modal, r.cons, r.cond, r.amp, r.label) == (modal, cons, cond, amp, label), r
        assert abs(r.s - s) < 1.01e-4


def test_second_pass(spark):
    df = spark.createDataFrame([("termination x", 0.75), ("termination x", 0.9375), ("termination x", 0.0), ("zero tolerance x", 0.5), ("other", 0.3), (None, 0.3)], "t string, p double")
    phrases = score.eligible(POLICY, {"termination", "zero tolerance", "note"})
    assert phrases == {"termination": 1.0, "zero tolerance": 0.8}
    got = [r.x for r in df.select(score.second_pass(F.col("t"), F.col("p"), phrases).alias("x")).collect()]
    assert got == pytest.approx([0.875, 0.9375, 0.0, 0.65, 0.3, 0.3])


def test_features(spark):
    rows = score.features(table(spark, [f[0] for f in FEATURE]), "text", FEATURES).orderBy("id").collect()
    for r, (_, want) in zip(rows, FEATURE, strict=True):
        assert tuple(r)[2:] == want
    empty = score.features(table(spark, [None, ""]), "text", FEATURES).collect()
    assert all(tuple(r)[2:] == (0, 0, 0, 0, 0, 0, 0) for r in empty)


def test_phrase_hits_join(spark):
    hits = score.phrase_hits(table(spark, ["termination and a fine", "nothing"]), "id", "text", score.lexicon_table(spark, POLICY)).collect()
    assert {(r.id, r.kind, r.weight) for r in hits} == {(0, "consequence", 1.0)}


def test_noise_filters(spark):
    texts = ["1 2 3 4 5 abc is", "this alphabetical sentence _______ is here", "this alphabetical sentence _ _ _ _ _ _ _ is here", "quick brown foxes jumping lazily", "the island document because", "", None, "x is 12 3.5 7% (8)"]
    assert apply(spark, texts, clean.is_clean)[:6] == [False, False, True, False, True, False]
    assert apply(spark, ["buy an outlet today is good", "plain", "Console.log"], clean.has_code) == [True, False, True]
    assert apply(spark, ["a 12 3.5 b"], clean.number_ratio) == [0.5]


def test_text_cleaning(spark):
    assert apply(spark, ["Page Header\nx\nPage Header\ny\nPage Header", "abcde\nabcde\nabcde", "", "a\r\nb"], T.drop_repeated_lines) == ["x\ny", "abcde\nabcde\nabcde", "", "a\r\nb"]
    assert apply(spark, ["a\n12\nb"], T.drop_page_numbers) == ["a\n\nb"]
    assert apply(spark, ["x • y\r"], lambda c: T.collapse_spaces(T.drop_unprintable(c))) == ["x y "]
    assert apply(spark, [" ;a b., "], T.clean_clause) == ["a b"]
    assert apply(spark, ["See HTTP://x.y/z or www.a.b: Café!"], T.preprocess) == ["see or caf"]
    assert apply(spark, ["<P class=x>a&nbsp;b</P><script>var x</script>c"], T.strip_html) == [" a b c"]
    assert apply(spark, ["a <b>c</b>   d   &amp; e"], T.strip_scraped) == ["a  c\n\nd\n\ne"]
    assert apply(spark, ["<param>", "<b>x</b>", "<BODY>"], T.is_html) == [True, False, True]
    assert apply(spark, ["a  b b", None, "  "], T.word_count) == [3, 0, 0]
    assert apply(spark, ["You cannot, MUST not"], T.modal_tokens) == [["you", "can", "not", "must", "not"]]
    assert apply(spark, ["the rules must be read"], lambda c: T.content_tokens(c, ["the", "be", "must"], ("must",), {"rules": "rule"})) == [["rule", "must", "read"]]


def test_dom(spark):
    page = "<html><header>h</header><p>a &amp; <b>b</b></p><script>x</script><nav><p>n</p></nav>c"
    assert apply(spark, [page, None, "plain"], dom.strip_html_dom) == ["a & \nb\nc", "", "plain"]


def segments(spark, text, f):
    return [tuple(c) for c in apply(spark, [text], f)[0]]


def test_segmentation(spark):
    hr = segment.numbered_paragraph
    assert segments(spark, "1. Leave\n- Must ask first\nmore text\n- Must wait", hr) == [("Leave: Must ask first", "semi_clause_bullet"), ("Leave more text: Must wait", "semi_clause_bullet")]
    assert segments(spark, "1. Leave\nStaff may ask", hr) == [("Leave Staff may ask", "numbered_clause")]
    assert segments(spark, "1. Leave\n-- Must ask first", hr) == [("Leave: -- Must ask first", "semi_clause_bullet")]
    assert segments(spark, "1. Leave\n- Must ask\ntail", hr) == [("Leave: Must ask", "semi_clause_bullet")]
    assert segments(spark, "1. Leave", hr) == [("Leave", "numbered_clause")]
    assert segments(spark, "1. alpha beta 2.1. gamma", segment.legal) == [("alpha beta", "numbered_clause"), ("gamma", "numbered_clause")]
    assert segments(spark, "company (a division of X) here", segment.legal) == [("company (a division of X) here", "paragraph")]
    assert segments(spark, "(a) first one here\n(b) second", segment.legal) == [("first one here", "lettered_subclause"), ("second", "lettered_subclause")]
    assert segments(spark, '"Data" means all of it', segment.legal) == [('"Data" means all of it', "definition_clause")]
    assert segments(spark, "EXHIBIT A\n\nInitials ___ then some more words", segment.legal) == [("then some more words", "paragraph")]
    assert segments(spark, "- one two three\n* four five six", segment.academic_hr) == [("one two three", "bullet_clause"), ("four five six", "bullet_clause")]
    assert segments(spark, "Section 1 We give notice of all claims\nArticle II Other things are said here", segment.privacy) == [("We give notice of all claims", "legal_keyword_clause"), ("Other things are said here", "section_clause")]
    assert segments(spark, "we share no data with others", segment.privacy) == [("we share no data with others", "paragraph")]
    long = "This is one. " * 20
    assert {c[1] for c in segments(spark, long, segment.academic_hr)} == {"spacy_sentence"}
    eight = "one two three four five six seven eight"
    assert apply(spark, [f"{eight}; {eight}; {eight}", f"1. {eight}\n2) {eight}", "short", f"a) {eight}; {eight}", f"{eight} x. " * 20], segment.online) == [[eight] * 3, [eight] * 2, [], [f"{eight}; {eight}"], [f"{eight} x."] * 20]


def test_clause_table(spark):
    valid = "word " * 10
    doc = "\n\n".join(["too short"] + [valid + f"n{i}" for i in range(125)] + ["w " * 121])
    docs = spark.createDataFrame([("hr", "a", doc), ("hr", "b", "x"), ("hr", "c", None), (None, "d", "y " * 60)], "domain string, source_doc string, text string")
    rows = segment.clauses(docs).collect()
    a = [r for r in rows if r.source_doc == "a"]
    assert len(a) == 120 and [r.pos for r in a] == list(range(120)) and {r.word_count for r in a} == {11}
    assert {r.source_doc for r in rows} == {"a", "d"}
    ids = segment.numbered_ids(segment.clauses(docs).repartition(7), ["source_doc", "pos"]).orderBy("source_doc", "pos").collect()
    assert [r.clause_id for r in ids] == [f"C{i + 1:06d}" for i in range(len(ids))]


def near(spark, partitions):
    w = [f"w{i}" for i in range(1, 23)]
    rows = [("x", 0, w[:20]), ("x", 1, w[1:21]), ("x", 2, w[2:22]), ("x", 3, w[:17]), ("x", 4, ["--"]), ("y", 5, w[:20]), ("x", 6, w[:20]), ("x", 7, ["--"])]
    return spark.createDataFrame([(d, i, " ".join(t)) for d, i, t in rows], "domain string, pos int, text string").repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 5])
def test_near_duplicates_are_greedy(spark, partitions):
    kept = clean.drop_near_duplicates(near(spark, partitions), "domain", "pos", "text")
    assert {r.pos for r in kept.collect()} == {0, 2, 4, 5, 7}


def test_near_duplicates_equal_a_plain_model(spark):
    import random

    r = random.Random(3)
    rows, words = [], [f"w{i}" for i in range(60)]
    base = r.sample(words, 20)
    for i in range(90):
        if i % 9 == 0:
            base = r.sample(words, 20)
        base = list(base)
        base[r.randrange(20)] = r.choice(words)
        rows.append((r.choice("ab"), i, " ".join(base)))
    kept = []
    for d, i, t in rows:
        s = set(t.split())
        if not any(e == d and 20 * len(s & u) >= 17 * len(s | u) for e, _, u in kept):
            kept.append((d, i, s))
    df = spark.createDataFrame(rows, "domain string, pos int, text string")
    assert {x.pos for x in clean.drop_near_duplicates(df, "domain", "pos", "text").collect()} == {i for _, i, _ in kept}


def test_exact_duplicates_and_cap(spark):
    df = spark.createDataFrame([(2, "A b "), (1, " a B"), (3, "c"), (4, None), (5, "")], "pos int, text string")
    assert {r.pos for r in clean.drop_exact_duplicates(df, "text", ["pos"]).collect()} == {1, 3, 4}
    many = spark.createDataFrame([("d", i) for i in range(125)], "doc string, pos int")
    assert {r.pos for r in clean.cap_per_document(many, ["doc"], ["pos"]).collect()} == set(range(120))
