"""Row filters and duplicate removal for clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions.text import strip, token_set, word_count
from clausemill.operators import near
from clausemill.plans.stages import cut

# Fixed patterns
VERBS = r"(?iU)\b(is|are|was|were|will|shall|must|may|should|have|has|had|can|could|would|do|does|did|be|been|require|provide|ensure|comply|result|constitute|mean|include|apply|define|allow|prohibit|subject|contain|establish|determine|render|cause|effect|make|give|take|use|set)\w*\b"
CODE = ("function(", "function (", "getelementbyid", "queryselector", "console.", ".push(", ".map(", "// ", "<?php", "var ", "const ", "let ")


def alpha_ratio(c: Column) -> Column:
    """Letters among all characters; 0 for an empty text."""
    return F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.greatest(F.length(c), F.lit(1))


def number_ratio(c: Column) -> Column:
    """Tokens of digits and number marks among all tokens; 0 without tokens."""
    numbers = F.regexp_count(c, F.lit(r"(?U)(?<!\S)[\d.,%$\-/()]+(?!\S)"))
    return numbers / F.greatest(word_count(c), F.lit(1))


def has_run(c: Column) -> Column:
    """Seven equal characters in a row."""
    return c.rlike(r"(.)\1{6,}")


def has_verb(c: Column) -> Column:
    return c.rlike(VERBS)


def has_code(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for signal in CODE:
        out = out | low.contains(signal)
    return out


def is_clean(c: Column, min_alpha: float = 0.55, max_numbers: float = 0.40) -> Column:
    return (word_count(c) > 0) & (alpha_ratio(c) >= min_alpha) & (number_ratio(c) <= max_numbers) & ~has_run(c) & has_verb(c)


def drop_exact_duplicates(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Keeps the first row, by ``order``, of each lower-cased and stripped text.

    The minimum of the order key is aggregated map-side before the shuffle, so a text
    with very many copies sends one row from each task.
    """
    keyed = rows.withColumn("_key", F.sha2(F.lower(strip(F.coalesce(F.col(text), F.lit("")))), 256))
    first = keyed.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    return keyed.join(first, (keyed["_key"] == first["_key"]) & F.struct(*(keyed[o] for o in order)).eqNullSafe(first["_first"]), "left_semi").drop("_key")


def cap_per_document(rows: DataFrame, document: list[str], order: list[str], most: int = 120) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*document).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def token_sets(rows: DataFrame, domain: str, order: str, text: str) -> DataFrame:
    """(node, domain, order, tokens): the first row of each token set of a domain, rows without tokens left out; a stage table."""
    # a domain as a structure, so that null is a domain like any other
    sets = rows.select(F.struct(F.col(domain).alias("domain")).alias("domain"), F.col(order).alias("order"), F.array_sort(token_set(F.coalesce(F.col(text), F.lit("")))).alias("tokens")).where(F.size("tokens") > 0)
    return cut(sets.groupBy("domain", "tokens").agg(F.min("order").alias("order")).select(F.monotonically_increasing_id().alias("node"), "domain", "order", "tokens"), "token-sets")


def similar_pairs(rows: DataFrame, domain: str, order: str, text: str, num: int = 17, den: int = 20) -> DataFrame:
    """(domain, i < j, overlap, total) of token sets with overlap / total of num / den or more, by their first rows."""
    return plain_domain(near.pairs(token_sets(rows, domain, order, text), num, den))


def plain_domain(found: DataFrame) -> DataFrame:
    """Sets or pairs with the domain itself."""
    return found.withColumn("domain", F.col("domain.domain"))


def drop_near_duplicates(rows: DataFrame, domain: str, order: str, text: str, num: int = 17, den: int = 20, rare: bool = False) -> DataFrame:
    """Greedy near-duplicate removal: within a domain, in ``order``, a kept row removes later ones that are similar.

    Rows with the token set of an earlier row always go; rows without tokens stay.
    ``order`` must be unique within a domain; ``rare`` is for short texts that share phrases.
    """
    sets = token_sets(rows, domain, order, text)
    firsts = plain_domain(sets.select("domain", "order").join(near.dropped(sets, num, den, rare), ["domain", "order"], "left_anti"))
    bare = ~F.coalesce(F.col(text), F.lit("")).rlike(r"(?U)\w")
    with_tokens = rows.where(~bare).join(firsts, rows[domain].eqNullSafe(firsts["domain"]) & (rows[order] == firsts["order"]), "left_semi")
    return with_tokens.unionByName(rows.where(bare))
