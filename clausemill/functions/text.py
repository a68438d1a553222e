"""Text cleaning, tokens and counts as Column expressions.

All run inside the JVM.  ``(?U)`` gives Java's classes their Unicode meaning, ``(?d)``
makes the line feed the only line end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\S+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def word_count(c: Column) -> Column:
    """White-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0))


# Cleaning of extracted documents


def drop_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?mdU)^\s*\d{1,3}\s*$", "")


def drop_repeated_lines(c: Column, times: int = 3, shortest: int = 5, longest: int = 80) -> Column:
    """Drops all lines whose stripped length is strictly between the limits and that occur ``times`` times or more."""

    def inside(lines: Column) -> Column:
        short = F.array_sort(F.filter(F.transform(lines, strip), lambda x: (F.length(x) > shortest) & (F.length(x) < longest)))
        # in sorted order an element that occurs often enough equals the one times - 1 places on
        repeated = F.transform(F.array(short), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + (times - 1)) == x)))[0]
        return F.transform(F.array(repeated), lambda r: F.array_join(F.filter(lines, lambda x: ~F.array_contains(r, strip(x))), "\n"))[0]

    return F.transform(F.array(F.split(c, "\n")), inside)[0]


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def drop_unprintable(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x20-\x7E\n\t]", " ")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t]{2,}", " ")


def clean_extracted(c: Column) -> Column:
    """The six cleaning steps of extracted documents, in order."""
    for step in (drop_page_numbers, drop_repeated_lines, collapse_blank_lines, drop_unprintable, collapse_spaces, strip):
        c = step(c)
    return c


def is_html(c: Column) -> Column:
    return c.rlike(r"(?i)<(html|body|div|p|head|span|table)[^>]*>")


def strip_html(c: Column) -> Column:
    """Without script and style blocks; tags and named references become spaces."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return F.regexp_replace(c, r"&[a-z]+;", " ")


def strip_scraped(c: Column) -> Column:
    """Tags and references become spaces, wide gaps paragraph breaks."""
    c = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"&[a-z]+;", " ")
    return strip(F.regexp_replace(c, r"(?U)\s{3,}", "\n\n"))


def clean_clause(c: Column) -> Column:
    """White space collapsed; blanks and ``.,;:`` stripped at both ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" \t\n\r.,;:"))


def drop_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)http\S+|www\S+", " ")


def drop_specials(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^a-z0-9\s]", " ")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def preprocess(c: Column) -> Column:
    """Lower case without URLs and special characters (the serving variant)."""
    return collapse(drop_specials(drop_urls(F.lower(c))))


# Tokens


def token_set(c: Column) -> Column:
    """Distinct word tokens of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))


def modal_tokens(c: Column, parted: str | None = r"\bcannot\b") -> Column:
    """Letter runs of the lower-cased text, with "cannot" as two tokens, or, where ``parted`` is None, as one."""
    low = F.lower(c)
    return F.regexp_extract_all(F.regexp_replace(low, parted, "can not") if parted else low, F.lit("[a-z]+"), F.lit(0))


def plain_tokens(c: Column) -> Column:
    """White-space separated tokens of the lower-cased text (the serving variant)."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def content_tokens(c: Column, stop_words: list[str], keep: tuple[str, ...], lemmas: dict[str, str] | Callable[[Column], Column] | None = None) -> Column:
    """Preprocessed tokens without stop words (but for ``keep``), as lemmas of two letters and more.

    Lemmas come from a small table, in which a word that it lacks is its own lemma, or from
    an expression (``lemmas.lemma``).
    """
    drop = F.array(*(F.lit(w) for w in stop_words if w not in keep)) if stop_words else F.array().cast("array<string>")
    tokens = F.filter(F.split(preprocess(c), " "), lambda w: (w != "") & ~F.array_contains(drop, w))
    if callable(lemmas):
        tokens = F.transform(tokens, lambda w: lemmas(w))
    elif lemmas:
        table = F.create_map(*(F.lit(x) for pair in lemmas.items() for x in pair))
        tokens = F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.filter(tokens, lambda w: F.length(w) > 1)
