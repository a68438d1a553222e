"""Queries over texts built from whole table columns, for what the tables themselves lack.

The documents hold no page numbers, lists, lettered items, definitions or sections.  Here
every text is carried over whole, with such marks put around its words; the SQL states
what must come out from how the text was built, not by the segmenters' patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions import lemmas
from clausemill.functions import text as T
from clausemill.functions.lexicon import FIXTURE
from clausemill.operators import boundaries, clean, ngrams, report, score, segment
from clausemill.plans import catalog, corpus
from clausemill.plans.catalog import _add, documents, embeddings, sql_text
from clausemill.plans.stages import exploded

# One expression, the same in both dialects, makes the input


def _built(name: str, made: str, f, sql: str, out: str = "text") -> None:
    _add(name, lambda s, d: documents(s, d).select("doc_id", F.expr(made).alias("text")).select("doc_id", f(F.col("text")).alias(out)), f"WITH b AS (SELECT doc_id, {made} AS text FROM documents) SELECT doc_id, {sql} AS {out} FROM b")


_built("t01_page_numbers", "replace(text, chr(10), chr(10) || '  17 ' || chr(10) || 'p 3' || chr(10) || '1234' || chr(10) || '9' || chr(10))", T.drop_page_numbers, r"regexp_replace(text, '(?m)^\s*\d{1,3}\s*$', '', 'g')")
_built("t03_blank_lines", "replace(text, chr(10), chr(10) || chr(10) || chr(10) || chr(10) || 'x' || chr(10) || chr(10))", T.collapse_blank_lines, r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')")
_built("t05_spaces", "replace(text, ' ', ' ' || chr(9) || ' ')", T.collapse_spaces, r"regexp_replace(text, '[ \t]{2,}', ' ', 'g')")
_built("t07_is_html", "CASE lang WHEN 'en' THEN '<p class=x>' || text WHEN 'fr' THEN text || '<TABLE>' WHEN 'de' THEN '<b>' || text ELSE text END", T.is_html, r"regexp_matches(text, '(?i)<(html|body|div|p|head|span|table)[^>]*>')", "is_html")
_built("f07_repeated_char", "CASE lang WHEN 'en' THEN text || ' zzzzzzz' WHEN 'fr' THEN text || ' zzzzzz' ELSE text END", clean.has_run, f"regexp_matches(text, '{catalog._RUNS}')", "run")
_built("f09_code", "CASE lang WHEN 'en' THEN text || ' Console.log' WHEN 'fr' THEN text || ' variant' WHEN 'de' THEN text || ' LET x' ELSE text END", clean.has_code, " OR ".join(f"contains(lower(text), {sql_text(c)})" for c in clean.CODE), "code")
_built("g16_legal_words", "CASE lang WHEN 'en' THEN text || ' Terminated' WHEN 'fr' THEN text || ' disclosure' WHEN 'de' THEN text || ' unclaimed' ELSE text END", lambda c: c.rlike(segment.LEGAL_WORDS), rf"regexp_matches(text, '{segment.LEGAL_WORDS.replace('(?iU)', '(?i)')}')", "legal")
_MARKED = """text || chr(10) || CASE lang WHEN 'en' THEN '"Fee" means' WHEN 'fr' THEN 'Exhibit B.1' WHEN 'de' THEN 'INITIALS ___' ELSE 'exhibit c' END"""
_built("g12_definition", _MARKED, lambda c: c.rlike(segment.DEFINITION), r"""regexp_matches(text, '(?m)^\s*["“][A-Z][^"”]{1,60}["”]\s+(means|shall mean|refers to|is defined as)')""", "found")
_built("g10_exhibit", _MARKED, lambda c: F.regexp_replace(c, segment.EXHIBIT, ""), r"regexp_replace(text, '(?m)^\s*[Ee][Xx][Hh][Ii][Bb][Ii][Tt]\s+[\dA-Z][\d\.]*\s*$', '', 'g')")
_built("g11_initials", _MARKED, lambda c: F.regexp_replace(c, segment.INITIALS, ""), r"regexp_replace(text, '(?i)initials?\s*[_\-]{2,}', '', 'g')")


# Segmenters: all words of a text, thirty to an item

ITEM = 30
PREFACE = "Preface of this document about everything else in it"  # over fifty characters, under ten words


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, items: every word of the text in runs of thirty; none of a text without words."""
    rows = documents(spark, sf_dir).select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    # no filter on the words: it would match them in the few tasks of the scan
    return rows.select("doc_id", F.expr(f"if(size(w) > 0, transform(sequence(0, (size(w) - 1) div {ITEM}), i -> array_join(slice(w, i * {ITEM} + 1, {ITEM}), ' ')), cast(array() as array<string>))").alias("items"))


ITEM_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents),
k AS (SELECT doc_id, list_transform(range(0, CAST(ceil(len(w) / {ITEM}.0) AS BIGINT)), lambda i: array_to_string(w[{ITEM} * i + 1 : {ITEM} * i + {ITEM}], ' ')) AS items FROM d),
e AS (SELECT doc_id, generate_subscripts(items, 1) - 1 AS i, unnest(items) AS item FROM k),
n AS (SELECT *, len(string_split(item, ' ')) AS words FROM e)"""


def _segmented(name: str, domain: str, made, text: str, label: str, more: int = 0) -> None:
    """Clauses of texts that ``made`` builds of the items; ``text`` and ``label`` state one item's clause of ``more`` words over the item's."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _items(spark, sf_dir).select(F.lit(domain).alias("domain"), F.col("doc_id").cast("string").alias("source_doc"), F.concat(F.lit(f"{PREFACE}\n\n"), made(F.col("items"))).alias("text"))
        return segment.clauses(docs).select(F.col("source_doc").cast("long").alias("doc_id"), "pos", "raw_text", "word_count", "pattern_label")

    _add(name, query, f"{ITEM_SQL} SELECT doc_id, CAST(i AS INTEGER) AS pos, {text} AS raw_text, CAST(words + {more} AS INTEGER) AS word_count, {label} AS pattern_label FROM n WHERE words + {more} >= 10 AND i < {segment.MAX_CLAUSES}")


def _joined(items: Column, each, between: str) -> Column:
    return F.array_join(F.transform(items, each), between)


_segmented("g05_hr_bullets", "hr", lambda x: F.concat(F.lit("1. Rules for all staff\n"), _joined(x, lambda v, i: F.concat(F.element_at(F.array(*map(F.lit, ("- ", "* ", "→ ", " • "))), (i % 4 + 1).cast("int")), v), "\n")), "'Rules for all staff: ' || item", "'semi_clause_bullet'", 4)
_segmented("g09_bullets", "academic", lambda x: _joined(x, lambda v, i: F.concat(F.when(i % 2 == 0, "▪ ").otherwise("-- "), v), "\n"), "item", "'bullet_clause'")
_segmented("g08_numbered_whole", "hr", lambda x: _joined(x, lambda v, i: F.concat((i + 1).cast("string"), F.lit(".2. "), v), "\n\n"), "item", "'numbered_clause'")
_segmented("g13_lettered", "legal", lambda x: F.concat(F.lit("The parties agree\n"), _joined(x, lambda v, i: F.concat(F.lit("("), F.expr("chr(97)") if i is None else F.element_at(F.array(*(F.lit(chr(97 + k)) for k in range(26))), (i % 26 + 1).cast("int")), F.lit(") "), v), "\n")), "item", "'lettered_subclause'")
_segmented("g14_numbered", "legal", lambda x: _joined(x, lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v), " "), "item", "'numbered_clause'")
_segmented("g06_definitions", "legal", lambda x: _joined(x, lambda v, i: F.concat(F.lit('Exhibit A\n"Term" means '), v, F.lit(" Initials ____")), "\n\n"), """'"Term" means ' || item""", "'definition_clause'", 2)
_segmented("g07_privacy_sections", "privacy", lambda x: _joined(x, lambda v, i: F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(" "), v, F.when(i % 2 == 0, " penalty").otherwise(" gardens")), "\n"), "item || CASE WHEN i % 2 = 0 THEN ' penalty' ELSE ' gardens' END", f"CASE WHEN i % 2 = 0 OR regexp_matches(item, '{segment.LEGAL_WORDS.replace('(?iU)', '(?i)')}') THEN 'legal_keyword_clause' ELSE 'section_clause' END", 1)


def _online(made) -> catalog.Query:
    return lambda s, d: exploded(_items(s, d), ["doc_id"], segment.online(made(F.col("items"))), "clause", "pos")


_add("g17_online_semicolons", _online(lambda x: _joined(x, lambda v, i: v, ";  ")), f"{ITEM_SQL} SELECT doc_id, CAST(i AS INTEGER) AS pos, item AS clause FROM n WHERE words >= 8")
_add("g17_online_numbers", _online(lambda x: F.concat(F.lit("0) first\n"), _joined(x, lambda v, i: F.concat((i % 9 + 1).cast("string"), F.lit(") "), v), "\n"))), f"{ITEM_SQL} SELECT doc_id, CAST(i AS INTEGER) AS pos, item AS clause FROM n WHERE words >= 8")


# Learnt sentence boundaries: texts in which abbreviations stand for common words

ABBREVIATED = "replace(replace(replace(text, ' the ', ' e.g. '), ' la ', ' art. '), ' und ', ' z.B. ')"
_EDGES = r"""^[\p{Ps}\p{Pi}"'']+|[\p{Pe}\p{Pf}"'',;:]+$"""
_ENDS = "'[.!?]+$', ''"
LEARNT_SQL = rf"""w AS (SELECT doc_id, regexp_extract_all({ABBREVIATED}, '\S+') AS w FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w),
k AS (SELECT doc_id, i, w[i] AS raw, w[i+1] AS behind, lower(regexp_replace(w[i], '{_EDGES}', '', 'g')) AS t, lower(regexp_replace(w[i+1], '{_EDGES}', '', 'g')) AS f FROM u),
b AS (SELECT *, regexp_replace(t, {_ENDS}) AS own, regexp_replace(f, {_ENDS}) AS follows, regexp_matches(t, '(^|[^.!?])[.]$') AS closed FROM k),
n AS (SELECT sum(closed::INT) / count(*)::DOUBLE AS share FROM b),
y AS (SELECT own AS type, CAST(sum(closed::INT) AS BIGINT) AS closed, CAST(sum((NOT closed)::INT) AS BIGINT) AS open, length(replace(own, '.', '')) AS letters FROM b WHERE regexp_matches(own, '\p{{L}}') GROUP BY own),
a AS (SELECT type, closed, open, -2 * (closed * ln(share) + open * ln(greatest(1 - share, 1e-12)) - closed * ln(0.99) - open * ln(0.01)) * exp(-letters) * (length(type) - letters + 1) * pow(letters::DOUBLE, -open::DOUBLE) AS score FROM y, n WHERE closed > 0),
abbreviated AS (SELECT * FROM a WHERE score >= 0.3),
e AS (SELECT own, CASE WHEN regexp_matches(t, '[.!?]$') AND own <> '' AND own NOT IN (SELECT type FROM abbreviated) THEN follows END AS follows FROM b),
c AS (SELECT type, CAST(sum(after) AS BIGINT) AS after, CAST(sum(1 - after) AS BIGINT) AS times FROM (SELECT own AS type, 0 AS after FROM e UNION ALL SELECT follows, 1 FROM e WHERE follows IS NOT NULL) GROUP BY type),
z AS (SELECT sum(after)::DOUBLE AS a, sum(times)::DOUBLE AS n FROM c),
l AS (SELECT type, after, times, -2 * (after * ln(greatest(times / n, 1e-12)) + (a - after) * ln(greatest(1 - times / n, 1e-12)) + (times - after) * ln(greatest(times / n, 1e-12)) + (n - a - times + after) * ln(greatest(1 - times / n, 1e-12))
   - after * ln(greatest(after / a, 1e-12)) - (a - after) * ln(greatest(1 - after / a, 1e-12)) - (times - after) * ln(greatest((times - after) / (n - a), 1e-12)) - (n - a - times + after) * ln(greatest(1 - (times - after) / (n - a), 1e-12))) AS score, a, n FROM c, z WHERE regexp_matches(type, '^\p{{L}}') AND after > 0),
starting AS (SELECT type, after, times, score FROM l WHERE score >= 30 AND n / a > times / after)"""


def _abbreviated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.expr(ABBREVIATED).alias("text"))


def _starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _abbreviated(spark, sf_dir)
    return boundaries.starters(docs, "text", boundaries.abbreviations(docs, "text")).withColumn("score", F.round("score", 4))


def _learnt_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of texts with abbreviations, by boundaries learnt from these texts."""
    docs = _abbreviated(spark, sf_dir)
    known = boundaries.abbreviations(docs, "text")
    rows, model = boundaries.with_lists(docs, "text", known, boundaries.starters(docs, "text", known))
    return exploded(rows, ["doc_id"], segment.sentences(T.collapse(F.col("text")), model), "sentence", "pos")


_add("g04_abbreviations", lambda s, d: boundaries.abbreviations(_abbreviated(s, d), "text").withColumn("score", F.round("score", 4)), f"WITH {LEARNT_SQL} SELECT type, closed, open, round(score, 4) AS score FROM abbreviated")
_add("g04_starters", _starters, f"WITH {LEARNT_SQL} SELECT type, after, times, round(score, 4) AS score FROM starting")
_add("g04_learnt_sentences", _learnt_sentences, rf"""WITH {LEARNT_SQL},
s AS (SELECT doc_id, i, raw, CASE WHEN lag(raw) OVER o IS NULL OR NOT regexp_matches(lag(raw) OVER o, '[.!?]$') THEN 0
        WHEN lag(closed) OVER o AND (lag(own) OVER o IN (SELECT type FROM abbreviated) OR regexp_matches(lag(own) OVER o, '^\p{{L}}$')) AND NOT (own IN (SELECT type FROM starting) AND regexp_matches(regexp_replace(raw, '{_EDGES}', '', 'g'), '^\p{{Lu}}')) THEN 0 ELSE 1 END AS cut FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM s)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, string_agg(raw, ' ' ORDER BY i) AS sentence FROM g GROUP BY doc_id, pos""")


# Tokens, features and reports

_STOP, _KEEP, _LEMMAS = ["the", "of", "and", "not", "de", "la"], ("not",), {"the": "a", "und": "and", "les": "le"}
_add("n02_content_tokens", lambda s, d: documents(s, d).select("doc_id", F.array_join(T.content_tokens(F.col("text"), _STOP, _KEEP, _LEMMAS), " ").alias("tokens")), f"SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(list_filter(string_split({catalog.PREPROCESSED}, ' '), lambda w: w <> '' AND w NOT IN ('the', 'of', 'and', 'de', 'la')), lambda w: CASE w WHEN 'und' THEN 'and' WHEN 'les' THEN 'le' ELSE w END), lambda w: length(w) > 1), ' '), '') AS tokens FROM documents")


# Lemmas: endings put on the words of the texts, so that rules and exceptions have work to do

INFLECTED = "lower(replace(replace(replace(replace(text, 'er ', 'ing '), 'e ', 'ed '), 'n ', 'nning '), 's ', 'sses '))"


def _lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.expr(f"regexp_extract_all({INFLECTED}, '[a-z]+', 0)").alias("w"))
    rows = lemmas.with_exceptions(docs, F.col("w"), lemmas.exceptions(exploded(docs, [], F.col("w"), "word")), "learnt")
    return rows.select("doc_id", F.array_join(F.transform("w", lambda w: lemmas.lemma(w, F.col("learnt"))), " ").alias("lemmas"))


def _rule_sql(w: str) -> str:
    parts = [f"WHEN regexp_matches({w}, '{p}') THEN " + (f"left(regexp_extract({w}, '{p}', 1), -1)" if e == "-" else f"regexp_extract({w}, '{p}', 1) || '{e}'") for p, e in lemmas.RULES]
    return f"CASE WHEN length({w}) <= 3 THEN {w} {' '.join(parts)} ELSE {w} END"


_BARE = f"regexp_extract(word, '{lemmas.OPEN}', 1)"
#: The lemma of every word of a table t(word), as table r.
LEMMAS_OF_T = f"""n AS (SELECT word, count(*) AS n FROM t GROUP BY word),
irregular(word, lemma) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in lemmas.IRREGULAR.items())}),
s AS (SELECT word, unnest([0, 1, 2, 3]) AS place, unnest([{_rule_sql('word')}, {_BARE}, {_BARE} || 'e', CASE WHEN right({_BARE}, 1) = left(right({_BARE}, 2), 1) AND length({_BARE}) > 1 THEN left({_BARE}, -1) ELSE {_BARE} END]) AS stem
      FROM n WHERE regexp_matches(word, '{lemmas.OPEN}') AND length(word) > 3 AND word NOT IN (SELECT word FROM irregular)),
b AS (SELECT s.word, s.stem, s.place, n.n FROM s JOIN n ON n.word = s.stem QUALIFY row_number() OVER (PARTITION BY s.word ORDER BY n.n DESC, s.place) = 1),
x AS (SELECT b.word, stem AS lemma FROM b WHERE n >= 5 AND stem <> {_rule_sql('word')}),
r AS (SELECT word, coalesce(irregular.lemma, x.lemma, {_rule_sql('word')}) AS lemma FROM n LEFT JOIN irregular USING (word) LEFT JOIN x USING (word))"""
LEMMA_SQL = f"""w AS (SELECT doc_id, regexp_extract_all({INFLECTED}, '[a-z]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w), t AS (SELECT doc_id, i, w[i] AS word FROM u), {LEMMAS_OF_T}"""
_add("n03_lemmas", _lemmas, f"WITH {LEMMA_SQL}, g AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY i) AS lemmas FROM t JOIN r USING (word) GROUP BY doc_id) SELECT doc_id, coalesce(lemmas, '') AS lemmas FROM documents LEFT JOIN g USING (doc_id)")
_add("n03_exceptions", lambda s, d: lemmas.exceptions(exploded(documents(s, d), [], F.expr(f"regexp_extract_all({INFLECTED}, '[a-z]+', 0)"), "word")), f"WITH {LEMMA_SQL} SELECT word, lemma FROM x")
_add("r21_online_features", lambda s, d: score.features(catalog.clauses(s, d), "clause", FIXTURE, tokens=T.plain_tokens).select("doc_id", "pos", "obligation_count", "word_count_f"), rf"""WITH {catalog.CLAUSE_SQL} SELECT doc_id, pos, CAST(len(list_filter(regexp_extract_all(lower(clause), '\S+'), lambda w: w IN ({', '.join(map(sql_text, FIXTURE.obligations))}))) AS INTEGER) AS obligation_count, CAST(len(regexp_extract_all(clause, '\S+')) AS INTEGER) AS word_count_f FROM c""")
_add("a11_readiness", lambda s, d: report.readiness(embeddings(s, d), "label", "embedding", F.col("label"), 2000, ["vec_id", "label"], 20), """
WITH c AS (SELECT label, count(*) AS n, bool_or(len(list_filter(embedding, lambda x: isnan(x))) > 0) AS nan, count(label) AS al FROM embeddings GROUP BY label),
o AS (SELECT count(*) = 4 AS a, min(n) >= 20 AS b, NOT bool_or(nan) AS c, sum(al) = sum(n) AS d, max(n) / min(n) < 2.0 AS g FROM c)
SELECT unnest(['labels', 'rows', 'numbers', 'aligned', 'terms', 'features', 'ratio', 'all']) AS "check", unnest([a, b, c, d, true, true, g, a AND b AND c AND d AND g]) AS passed FROM o""")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("lang").alias("domain"), T.word_count(F.col("text")).alias("word_count"))
    return rows.withColumn("status", F.when(F.col("word_count") >= 50, "ok").otherwise("skipped_too_short"))


_add("a13_extraction_summary", lambda s, d: report.extraction_summary(_manifest(s, d)).withColumn("average_words", F.round("average_words", 6)), r"""
WITH m AS (SELECT lang AS domain, len(regexp_extract_all(text, '\S+')) AS w FROM documents)
SELECT domain, count(*) FILTER (w >= 50) AS ok, count(*) FILTER (w < 50) AS skipped, CAST(coalesce(sum(w) FILTER (w >= 50), 0) AS BIGINT) AS words, round(avg(w) FILTER (w >= 50), 6) AS average_words, coalesce(avg(w) FILTER (w >= 50) < 200, true) AS thin FROM m GROUP BY domain""")
_add("a14_collection_summary", lambda s, d: report.collection_summary(documents(s, d).select(F.col("source").alias("domain"))), "SELECT source AS domain, count(*) AS files, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM documents GROUP BY source")
_add("s18_result_counts", lambda s, d: report.cards(score.scored(catalog.clauses(s, d), "clause", FIXTURE).withColumnRenamed("risk_label", "label"))[0], f"{catalog.FIXTURE_SQL}, g AS (SELECT {catalog.LABEL_SQL} AS y FROM f) SELECT count(*) AS total, count(*) FILTER (y = 'Critical') AS critical, count(*) FILTER (y = 'High') AS high, count(*) FILTER (y = 'Medium') AS medium, count(*) FILTER (y = 'Low') AS low FROM g")
_add("n08_unigrams", lambda s, d: ngrams.vocabulary(ngrams.term_counts(documents(s, d), "doc_id", ngrams.tokens(F.col("text"), ngrams.COUNT_TOKEN)), 2, None), r"WITH u AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) AS term FROM documents), t AS (SELECT doc_id, term, count(*) AS tf FROM u WHERE regexp_full_match(term, '[a-z]{2,}') GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM t GROUP BY term HAVING count(*) >= 2")


def corpus_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow, from documents to the balanced master table; languages stand for the four domains."""
    domain = F.when(F.col("lang") == "en", "legal").when(F.col("lang") == "fr", "privacy").when(F.col("lang") == "de", "hr").otherwise("academic")
    docs = documents(spark, sf_dir).select(domain.alias("domain"), F.col("doc_id").cast("string").alias("source_doc"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return corpus.master(docs, balanced=100)


_add("corpus_master", corpus_master)
