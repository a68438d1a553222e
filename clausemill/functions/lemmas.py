"""English lemmas: suffix rules, fixed irregular forms, and exceptions learnt from counts of word pairs.

The rules take plural, past and -ing endings off.  For most words that settles it; whether ``rat-ed``
or ``rat-e``, ``hopp`` or ``hop`` is meant, no rule can tell.  There the corpus decides: each word with
such an ending has up to three stems, and where one of them occurs more often than the one the rule
takes, word and stem become an exception.  Learning is an aggregation of word counts and a join of
stems with them; applying is a chain of expressions and a map of the exceptions, all of them if they
are few (``learn``), else those that a row needs (``with_exceptions``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.plans.stages import exploded

#: Irregular forms, by lemma.
IRREGULAR_BY_LEMMA = {
    "be": "am are is was were been being", "have": "has had having", "do": "does did done", "go": "goes went gone", "give": "gave given",
    "take": "took taken", "make": "made", "hold": "held", "pay": "paid", "say": "said", "see": "saw seen", "find": "found", "bind": "bound",
    "keep": "kept", "leave": "left", "lose": "lost", "send": "sent", "write": "wrote written", "know": "knew known", "get": "got gotten",
    "begin": "began begun", "break": "broke broken", "withhold": "withheld", "child": "children", "person": "people", "man": "men", "woman": "women",
}
IRREGULAR = {form: lemma for lemma, forms in IRREGULAR_BY_LEMMA.items() for form in forms.split()}
#: Most exceptions that go into an expression.
MOST = 10_000

_VOWEL = "[aeiouy]"
#: Endings in order, as (pattern with the part to keep as first group, what follows it); the first that matches decides.
RULES = (
    (r"^(.*(?:ss|us|is))$", ""),
    (r"^(.{2,})ies$", "y"),
    (r"^(.+(?:ch|sh|x|z|ss))es$", ""),
    (r"^(.{2,}[^s])s$", ""),
    (r"^(.{2,})ied$", "y"),
    (rf"^(.*{_VOWEL}.*[^aeiouyc]ee)d$", ""),
    (r"^(.*eed)$", ""),
    (rf"^(.*{_VOWEL}.*(?:bb|dd|gg|mm|nn|pp|rr|tt))(?:ed|ing)$", "-"),
    (rf"^(.*{_VOWEL}.*(?:[cvzu]|iz|bl|dg|rg))(?:ed|ing)$", "e"),
    (r"^(.*[^aeiou]at)(?:ed|ing)$", "e"),
    (rf"^(.*{_VOWEL}.+)(?:ed|ing)$", ""),
)
#: Words whose stem the corpus may correct.
OPEN = rf"^(.*{_VOWEL}.+)(?:ed|ing)$"


def by_rule(word: Column) -> Column:
    """The lemma that the rules give a lower-case word; '-' stands for the last letter taken off. All rules are for words that end in s, d or g."""
    out = word
    for pattern, ending in reversed(RULES):
        kept = F.regexp_extract(word, pattern, 1)
        made = F.substring(kept, F.lit(1), F.length(kept) - 1) if ending == "-" else F.concat(kept, F.lit(ending))
        out = F.when(word.rlike(pattern), made).otherwise(out)
    return F.when((F.length(word) > 3) & F.right(word, F.lit(1)).isin("s", "d", "g"), out).otherwise(word)


def stems(word: Column) -> Column:
    """What may be meant by a word with an open ending: by rule, bare, with e, with one letter less."""
    bare = F.regexp_extract(word, OPEN, 1)
    return F.array_distinct(F.array(by_rule(word), bare, F.concat(bare, F.lit("e")), F.when(F.substring(bare, -1, 1) == F.substring(bare, -2, 1), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)))


def exceptions(words: DataFrame, word: str = "word", least: int = 5) -> DataFrame:
    """(word, lemma) where another stem than the rule's occurs ``least`` times or more, and more often; words of irregular forms left out. Of equal counts the first stem, as listed, is taken."""
    counts = words.where(F.col(word) != "").groupBy(F.col(word).alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    open_ones = counts.where(F.col("stem").rlike(OPEN) & (F.length("stem") > 3) & ~F.col("stem").isin(*IRREGULAR)).select(F.col("stem").alias("word"), F.posexplode(stems(F.col("stem"))).alias("place", "stem"))
    found = open_ones.join(counts, "stem", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = found.groupBy("word").agg(F.max(F.struct("n", (-F.col("place")).alias("place"), "stem")).alias("best"))
    return best.where(f"best.n >= {least} AND best.place < 0").select("word", F.col("best.stem").alias("lemma"))


def learn(words: DataFrame, word: str = "word", least: int = 5) -> dict[str, str]:
    """The exceptions of a corpus for expressions; at most ``MOST``."""
    rows = exceptions(words, word, least).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} exceptions: raise least")
    return {r.word: r.lemma for r in sorted(rows)}


def with_exceptions(rows: DataFrame, words: Column, table: DataFrame, name: str) -> DataFrame:
    """Rows with a map of those exceptions (word, lemma) of ``table`` that their words need, null for none; for ``lemma``, whatever the size of the table.

    Rows are known by a hash of their words: where two share one, either has more exceptions than it needs.
    """
    keyed = rows.withColumn("_words", F.xxhash64(words))
    wanted = exploded(keyed, ["_words"], F.array_distinct(F.filter(words, lambda w: w.rlike(OPEN))), "word").drop("_pos")
    found = wanted.join(table, "word").groupBy("_words").agg(F.map_from_entries(F.collect_set(F.struct("word", "lemma"))).alias(name))
    return keyed.join(found, "_words", "left").drop("_words")


def lemma(word: Column, learnt: dict[str, str] | Column | None = None) -> Column:
    """The lemma of a lower-case word: irregular, learnt (a table, or a map of the row), else by rule."""
    known = IRREGULAR if isinstance(learnt, Column) else {**(learnt or {}), **IRREGULAR}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    other = F.coalesce(F.try_element_at(learnt, word), by_rule(word)) if isinstance(learnt, Column) else by_rule(word)
    return F.when(word.isin(*known), F.try_element_at(table, word)).otherwise(other)  # a set first: maps are searched entry by entry
