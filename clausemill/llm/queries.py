"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clausemill.llm import collocations, conversations, fingerprints, html_text, language, ngram_join, packing, pii, quality, token_counts, token_digests, token_files, url_filter
from clausemill.llm.common import read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.measure(docs, quality.plan(docs, quality.rules()))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text, before and after edits at a quarter, half and three quarters of it."""
    return token_counts.edited_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.predictions(docs, language.fit(docs))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.texts(read(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is that of addresses that several pages claim."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, url_filter.RULES, url_filter.contested(pages))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_quality, op3_token_counts, op4_fingerprints, op5_pii, op6_token_files, op7_bpe, op8_language, op9_html, op10_ngram_join, op11_collocations, op12_conversations, op13_urls)}


#: op2: lists of words and lines per text; windows by position.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
v AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i+4]) AS n FROM v),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines, len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i-1])) AS n_stutter,
             length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 2 * n_upper > n_letters OR 100 * n_stutter > 30 * n_words) AS kept
FROM f"""


#: op11: all phrases of one to three words by text, every cut of those of two and three.
OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
u AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
o AS (SELECT lang, ws[i] AS x, ws[i+1] AS y, ws[i+2] AS z FROM u),
g AS (SELECT lang, x AS phrase, count(*) AS f FROM o GROUP BY ALL UNION ALL SELECT lang, x || ' ' || y, count(*) FROM o WHERE y IS NOT NULL GROUP BY ALL),
t AS (SELECT lang, x, y, z, count(*) AS f FROM o WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY lang),
d AS (SELECT lang, x || ' ' || y AS phrase, count(*) AS f, x AS hx, y AS hy FROM o WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, phrase, f AS a, 1 AS j, hx AS p, hy AS q FROM d UNION ALL SELECT lang, x || ' ' || y || ' ' || z, f, 1, x, y || ' ' || z FROM t UNION ALL SELECT lang, x || ' ' || y || ' ' || z, f, 2, x || ' ' || y, z FROM t),
s AS (SELECT c.lang, c.phrase, a, j, left_part.f AS l, right_part.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(left_part.f AS HUGEINT) * right_part.f) AS BIGINT) AS score
      FROM c JOIN g AS left_part ON left_part.lang = c.lang AND left_part.phrase = c.p JOIN g AS right_part ON right_part.lang = c.lang AND right_part.phrase = c.q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT lang, pair, max(f) AS f FROM (SELECT lang, x || ' ' || y AS pair, f FROM t UNION ALL SELECT lang, y || ' ' || z, f FROM t) GROUP BY lang, pair),
kept AS (SELECT b.lang, b.phrase, a, l, r, score FROM b LEFT JOIN held ON held.lang = b.lang AND held.pair = b.phrase WHERE held.f IS NULL OR 100 * held.f < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""

#: op13: the rules by length, then the addresses that several pages claim.
OP13_SQL = r"""
WITH r AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))), '&') AS told FROM h),
k AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN told = '' THEN '' ELSE '?' || told END END AS key FROM q),
listed AS (SELECT key FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
v AS (SELECT page_id, host, path, key, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM k)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM v"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": OP2_SQL, "op11_collocations": OP11_SQL, "op13_urls": OP13_SQL}
