"""Operator 13: URL rules, the blocked Bloom filter and the exact join, against plain Python."""

from pyspark.sql import functions as F

from clausemill.llm import url_filter as u


def plain(url, rules, listed):
    """(host, path, rule, verdict) of one URL, in plain Python; ``listed`` holds canonical forms."""
    head, found, rest = (url or "").partition("://")
    rest = rest if found else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in rules:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best[0] if best else "block" if found and listed and plain_key(url) in listed else "allow"


def plain_key(url):
    host, path, _, _ = plain(url, (), ())
    host = host.removeprefix("www.")
    host = host.removesuffix(":80") if host.endswith(":80") else host.removesuffix(":443")
    tail = url.split("://", 1)[1].split("#")[0]
    query = tail.partition("?")[2]
    told = "&".join(sorted(p for p in query.split("&") if p and not (p.partition("=")[0] == "ref" or p.startswith("utm_"))))
    return host + path.rstrip("/") + ("?" + told if told else "")


URLS = [
    "http://a.example.com/en/1", "http://www.example.com/en/1", "http://x.www.example.com/en/", "https://badexample.com/en/", "http://example.com/english", "http://EXAMPLE.com/en/", "http://n.net/es/", "http://n.net/ES/", "http://net/fr/x?y#z", "http://n.org/es/",
    "http://example.com", "http://example.com?x=/en/", "http://example.com#/en/", "noscheme.com/en/", "", None, "://", "http://", "a://b://c.com/en/", "http://İ.com/", "http://w.org/a/?b=2&a=1&utm_source=f", "https://www.w.org:443/a?a=1&ref=x&b=2#t", "http://w.org/a?b=2", "http://long.org/" + "x" * 200_000,
]


def test_equals_plain_python(spark):
    pages = spark.createDataFrame([(i, x) for i, x in enumerate(URLS + [None, URLS[20]])], "page_id long, url string")
    listed = spark.createDataFrame([("http://w.org/a?a=1&b=2",), (None,), ("nothing",), ("http://www.example.com/en/1",), ("http://long.org/" + "x" * 200_000,)], "url string")
    keys = {plain_key(x.url) for x in listed.collect() if x.url and "://" in x.url}
    got = {r.page_id: tuple(r)[1:] for r in u.judge(pages, u.RULES, listed).collect()}
    assert got == {r.page_id: plain(r.url, u.RULES, keys) for r in pages.collect()}
    assert got[20][3] == got[21][3] == "block" and got[22][3] == "allow" and got[23][3] == "block" and got[1][3] == "allow"


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(none, u.RULES, none).columns == ["page_id", "host", "path", "rule", "verdict"] and u.judge(none, u.RULES, none).count() == 0
    pages = spark.createDataFrame([(None, "http://w.org/"), (1, "http://w.org")], "page_id long, url string")
    for name in ("key", "host", "path", "rule", "verdict", "block", "passes", "salt", "w0"):
        pages = pages.withColumn(name, F.lit("mine"))
    assert sorted((str(r.page_id), r.verdict) for r in u.judge(pages, u.RULES, none).collect()) == [("1", "allow"), ("None", "allow")]
    assert {r.verdict for r in u.judge(pages, u.RULES, u.contested(pages)).collect()} == {"block"}


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    made = u.bloom(keys)
    assert made[1] == 1 + 20_000 // u.PER_BLOCK
    assert u.may_hold(keys, made).where("NOT passes").isEmpty()
    wrong = u.may_hold(spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("key")), made).where("passes").count()
    assert 0 < wrong < 400


def test_a_full_filter_and_a_hot_url_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(u, "MOST_BLOCKS", 1)
    pages = spark.range(9_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://hot.org/x/").otherwise(F.concat(F.lit("http://c.org/"), F.col("id") % 700)).alias("url"))
    listed = spark.createDataFrame([("https://www.hot.org/x",)] + [(f"http://c.org/{i}/",) for i in range(300)], "url string")
    got = u.judge(pages, u.RULES, listed)
    assert got.count() == 9_000
    want = pages.where("url = 'http://hot.org/x/' OR CAST(substring(url, 14, 9) AS INT) < 300").count()
    assert got.where("verdict = 'block'").count() == want
