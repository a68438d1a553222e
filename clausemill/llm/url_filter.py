"""URL verdicts by rules and a list of URLs (operator 13).

A rule names a host and the start of a path; it fits that host and its subdomains, and the
longest rule that fits decides.  Where none fits, a list of URLs decides: a URL whose canonical
form is listed is blocked, any other is allowed.

The list may be of any length.  Its canonical forms fill a blocked Bloom filter: one hash picks
a block of eight 32-bit words, a second one a bit of each word.  The filter is a table of at most
``MOST_BLOCKS`` rows, so its broadcast is bounded; a longer list only lets more rows pass.  What
passes goes to an exact join on the canonical form, which removes the false positives, and only
these rows are shuffled.  Canonical forms with a large share of them are salted first.

Nulls, and URLs without ``://``, have an empty host and path, fit no rule, are not listed, and
are allowed.  Rows that repeat are each judged; an empty table gives an empty result.  Only
``page_id`` and ``url`` are read, so further columns, whatever their names, do not matter.
All of it is Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import materialise

#: Rules of the registered query: (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Listed URLs to a block of 256 bits, and the most blocks of a filter (8 MB of bits).
PER_BLOCK, MOST_BLOCKS = 16, 1 << 18
WORDS = 8
#: A canonical form is salted where it has one in HOT or more of the rows that pass; there are at most HOT such forms.
HOT, SALTS = 500, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slashes, other parameters than utm_* and ref in order; null without ``://``."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    told = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[^=]*|ref)(=|$)"))), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(name, F.regexp_replace(path(url), r"/+$", ""), F.when(told == "", "").otherwise(F.concat(F.lit("?"), told))))


def rule(at: Column, way: Column, rules: tuple[tuple[str, str], ...], value: int) -> Column:
    """Verdict (``value`` 0) or text (1) of the longest rule that fits; null where none does. Every rule is a branch: long lists belong into the filter."""
    found = F.lit(None).cast("string")
    for each in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]))):  # the longest comes last and so outermost
        name, _, start = each[1].partition("/")
        found = F.when(((at == name) | at.endswith(f".{name}")) & way.startswith(f"/{start}"), each[value]).otherwise(found)
    return found


def _bits(key: Column) -> list[Column]:
    """One bit of each of the eight words of a block."""
    drawn = F.xxhash64(key, F.lit(13))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(drawn, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def bloom(keys: DataFrame) -> tuple[DataFrame, int]:
    """The filter of the distinct values of ``key``: (block, w0 to w7), and its number of blocks. Blocks without a bit have no row."""
    blocks = min(MOST_BLOCKS, 1 + keys.count() // PER_BLOCK)
    masks = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))))
    return masks.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))), blocks


def may_hold(rows: DataFrame, filter_of: tuple[DataFrame, int]) -> DataFrame:
    """The rows with a column ``passes``: False means that their ``key`` is surely not in the filter."""
    table, blocks = filter_of
    own = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    kept = [c for c in own.columns if c != "block"]
    return own.join(F.broadcast(table), "block", "left").select(*kept, F.coalesce(hit, F.lit(False)).alias("passes"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...], listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``; ``listed`` has the blocked URLs in a column ``url``."""
    keys = materialise(listed.select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").distinct(), "listed")
    own = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("key"))
    own = own.select("*", rule(F.col("host"), F.col("path"), rules, 1).alias("rule"), rule(F.col("host"), F.col("path"), rules, 0).alias("verdict"))
    own = may_hold(own.withColumn("key", F.when(F.col("rule").isNull(), F.col("key"))), bloom(keys))
    passed = materialise(own.where("passes").drop("passes"), "passed")  # few rows: possible hits
    return own.where("NOT passes").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")).unionByName(_exact(passed, keys))


def _exact(passed: DataFrame, keys: DataFrame) -> DataFrame:
    """Verdicts of rows that the filter let pass: a join on the canonical form, salted where one form has many rows."""
    least = max(1_000, passed.count() // HOT)
    hot = passed.groupBy(F.xxhash64("key").alias("h")).count().where(F.col("count") > least).select("h", F.lit(True).alias("hot"))  # at most HOT rows
    salted = passed.withColumn("h", F.xxhash64("key")).join(F.broadcast(hot), "h", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).otherwise(0))
    held = keys.withColumn("h", F.xxhash64("key")).join(F.broadcast(hot), "h", "left").select("key", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"), F.lit("block").alias("found"))
    return salted.join(held, ["key", "salt"], "left").select("page_id", "host", "path", "rule", F.coalesce("found", F.lit("allow")).alias("verdict"))


def contested(pages: DataFrame) -> DataFrame:
    """URLs whose canonical form more than one page has: the list of the registered query. Counts are combined before the shuffle."""
    return pages.select("url", canonical(F.col("url")).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url")).where("n > 1").select("url")
