"""Sentence boundaries learnt from the texts themselves, without labels.

Which tokens are abbreviations follows from how firmly a token and a closing period belong
together (a log-likelihood ratio, weighted by length and inner periods, after Kiss and Strunk,
"Unsupervised Multilingual Sentence Boundary Detection", 2006); which words start sentences, from
how much more often they follow a period that ends one.  Both are aggregations over
(token, next token): counts combine in every task, and one row a type is shuffled.  What is learnt
is two lists, put into expressions if they are short (``learn``), else joined to the texts that have
their entries (``with_lists``); texts are then split by Column expressions, row by row.

Null and empty texts have no tokens.  A corpus without periods has no abbreviations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.text import WORD
from clausemill.plans.stages import exploded

#: Thresholds of the paper, and the most entries of a list that goes into expressions.
ABBREVIATION, STARTER, MOST = 0.3, 30.0, 10_000
_EDGES = r"(?U)^[\p{Ps}\p{Pi}\"']+|[\p{Pe}\p{Pf}\"',;:]+$"
_TINY = 1e-12


@dataclass(frozen=True)
class Boundaries:
    """Lower-case abbreviations without their last period, and lower-case words that start sentences; whole lists, or array columns with those of each row's text (``with_lists``)."""

    abbreviations: tuple[str, ...] | Column = ()
    starters: tuple[str, ...] | Column = ()


def _among(name: Column, listed: tuple[str, ...] | Column) -> Column:
    return F.coalesce(F.array_contains(listed, name), F.lit(False)) if isinstance(listed, Column) else name.isin(*listed, "\0")


def bare(token: Column) -> Column:
    """A token in lower case, without brackets, quotes and commas around it."""
    return F.lower(F.regexp_replace(token, _EDGES, ""))


def base(token: Column) -> Column:
    """Without closing sentence marks, too."""
    return F.regexp_replace(bare(token), r"[.!?]+$", "")


def pairs(docs: DataFrame, text: str) -> DataFrame:
    """(token, follows): every token and the one behind it in its text, null at the end."""
    words = docs.select(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)).alias("w"))
    both = F.transform("w", lambda w, i: F.struct(bare(w).alias("token"), F.get("w", i + 1).alias("follows")))
    return exploded(words, [], both, "p").select("p.token", "p.follows")


def _types(docs: DataFrame, text: str) -> DataFrame:
    """(type, closed, open): how often each type with a letter stands with one closing period and how often without; the row of a null type has the totals."""
    closed = F.col("token").rlike(r"(?<![.!?])\.$")
    name = F.regexp_replace("token", r"[.!?]+$", "")
    rows = pairs(docs, text).select(F.when(name.rlike(r"\p{L}"), name).alias("type"), closed.alias("closed"))
    counts = rows.groupBy("type").agg(F.count_if("closed").alias("closed"), F.count_if(~F.col("closed")).alias("open"))
    return counts


def abbreviations(docs: DataFrame, text: str, threshold: float = ABBREVIATION) -> DataFrame:
    """(type, closed, open, score) of the types that score ``threshold`` or more."""
    types = _types(docs, text)
    totals = types.agg(F.sum("closed").alias("periods"), (F.sum("closed") + F.sum("open")).alias("tokens"))
    rows = types.where("type IS NOT NULL AND closed > 0").crossJoin(F.broadcast(totals))  # totals are one row
    share = F.col("periods") / F.col("tokens")
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    chance = F.col("closed") * F.log(share) + F.col("open") * F.log(F.greatest(1 - share, F.lit(_TINY)))
    bound = F.col("closed") * F.log(F.lit(0.99)) + F.col("open") * F.log(F.lit(0.01))
    weight = F.exp(-letters) * (F.length("type") - letters + 1) * F.pow(letters.cast("double"), -F.col("open").cast("double"))
    return rows.withColumn("score", -2 * (chance - bound) * weight).where(F.col("score") >= threshold).select("type", "closed", "open", "score")


def starters(docs: DataFrame, text: str, known: tuple[str, ...] | DataFrame, threshold: float = STARTER) -> DataFrame:
    """(type, after, times, score): words that stand after sentence ends more than chance has it; ``known`` are the abbreviations, listed or as a table with their types."""
    ends = F.col("token").rlike(r"[.!?]$") & (F.regexp_replace("token", r"[.!?]+$", "") != "") & F.col("follows").isNotNull()
    rows = pairs(docs, text).select(F.regexp_replace("token", r"[.!?]+$", "").alias("own"), F.when(ends, base(F.col("follows"))).alias("follows"))
    seen = rows.groupBy("own", "follows").count()  # combined before the two views of it are counted
    if isinstance(known, DataFrame):
        seen = seen.join(known.select(F.col("type").alias("own"), F.lit(True).alias("short")), "own", "left")
    else:
        seen = seen.withColumn("short", F.col("own").isin(*known, "\0"))
    seen = seen.withColumn("follows", F.when(~F.coalesce("short", F.lit(False)), F.col("follows")))
    both = seen.select(F.explode(F.array(F.struct(F.col("own").alias("type"), F.lit(0).alias("after")), F.struct(F.col("follows").alias("type"), F.lit(1).alias("after")))).alias("x"), "count").select("x.*", "count")
    types = both.groupBy("type").agg(F.sum(F.when(F.col("after") == 1, F.col("count")).otherwise(0)).alias("after"), F.sum(F.when(F.col("after") == 0, F.col("count")).otherwise(0)).alias("times"))
    totals = types.agg(F.sum(F.when(F.col("type").isNotNull(), F.col("after"))).alias("ends"), F.sum("times").alias("tokens"))
    rows = types.where(F.col("type").rlike(r"^\p{L}") & (F.col("after") > 0)).crossJoin(F.broadcast(totals))
    a, b, n, k = (F.col(c).cast("double") for c in ("ends", "times", "tokens", "after"))

    def part(hits: Column, misses: Column, share: Column) -> Column:
        log = lambda x: F.log(F.greatest(x, F.lit(_TINY)))
        return hits * log(share) + misses * log(1 - share)

    score = -2 * (part(k, a - k, b / n) + part(b - k, n - a - b + k, b / n) - part(k, a - k, k / a) - part(b - k, n - a - b + k, (b - k) / (n - a)))
    return rows.where("times < tokens AND ends < tokens").withColumn("score", score).where((F.col("score") >= threshold) & (n / a > b / k)).select("type", "after", "times", "score")


def learn(docs: DataFrame, text: str = "text") -> Boundaries:
    """Boundaries of a corpus; its lists must have at most ``MOST`` entries."""

    def listed(table: DataFrame) -> tuple[str, ...]:
        rows = table.select("type").limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"more than {MOST} entries: raise the threshold")
        return tuple(sorted(r.type for r in rows))

    known = listed(abbreviations(docs, text))
    return Boundaries(known, listed(starters(docs, text, known)))


def with_lists(docs: DataFrame, text: str, known: DataFrame, starting: DataFrame) -> tuple[DataFrame, Boundaries]:
    """Rows with the abbreviations and the starters, of tables with their types, that stand in their texts, and the boundaries by them; for lists of any length.

    Rows are known by a hash of their text: where two share one, either has more entries than it needs.
    """
    keyed = docs.withColumn("_text", F.xxhash64(text))
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    told = F.filter(words, lambda w: bare(w).rlike(r"(?<![.!?])\.$") | F.regexp_replace(w, _EDGES, "").rlike(r"^\p{Lu}"))
    types = exploded(keyed, ["_text"], F.array_distinct(F.transform(told, base)), "type")
    both = known.select("type", F.lit(True).alias("_short")).unionByName(starting.select("type", F.lit(False).alias("_short")))
    lists = types.join(both, "type").groupBy("_text").agg(*(F.collect_set(F.when(F.col("_short") == own, F.col("type"))).alias(name) for own, name in ((True, "_abbreviations"), (False, "_starters"))))
    return keyed.join(lists, "_text", "left").drop("_text"), Boundaries(F.col("_abbreviations"), F.col("_starters"))


def joins(before: Column, after: Column, model: Boundaries) -> Column:
    """Whether no sentence ends between two pieces that a sentence mark and white space part: the first closes with an abbreviation or an initial, and the second does not begin with a capitalised starter."""
    last = F.regexp_extract(before, r"(?U)(\S+)$", 1)
    name = base(last)
    short = bare(last).rlike(r"(?<![.!?])\.$") & (_among(name, model.abbreviations) | name.rlike(r"^\p{L}$"))
    first = F.regexp_extract(after, r"(?U)^(\S+)", 1)
    return short & ~(_among(base(first), model.starters) & F.regexp_replace(first, _EDGES, "").rlike(r"^\p{Lu}"))


def joined(pieces: Column, model: Boundaries) -> Column:
    """Pieces of a text with those put together again between which no sentence ends."""

    def step(acc: Column, piece: Column) -> Column:
        return F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), piece.alias("open"))).when(joins(acc["open"], piece, model), F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(" "), piece).alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), piece.alias("open")))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
