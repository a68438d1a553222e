"""Document fingerprints: bottom-k sketches of word shingles (operator 4, built-in expressions only).

A text's shingles are its runs of five words (``[^\\x20\\x09-\\x0D]+``); a shorter text is
one shingle, a text without words has none.  The sketch keeps the k smallest distinct
48-bit shingle hashes, in order.  Sketches of parts merge into the sketch of the
whole, and estimate resemblance, containment and the number of distinct shingles.

Null text counts as empty.  Two empty sketches resemble each other fully, an empty
and a non-empty one not at all.  Rows of equal doc_id and text are one after the other, in any order,
as their results are equal.  An empty table gives an empty result.  Only doc_id and text are read, so
further columns do not matter.  Everything here is a Column expression; there is no
Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, WORDS, HASH_BITS = 128, 5, 48


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<long>: the k smallest distinct shingle hashes of a text."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingles(own: Column) -> Column:
        n = F.size(own)
        many = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(own, i, words)), 64 - HASH_BITS))
        one = F.array(F.shiftrightunsigned(F.xxhash64(own), 64 - HASH_BITS))
        return F.when(n >= words, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))

    # one lambda over a one-element array, so that the text is split once
    hashes = F.transform(F.array(tokens), shingles)[0]
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two shingle sets, 0 to 1."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    full = (k - 1) * float(1 << HASH_BITS) / F.greatest(F.element_at(a, -1), F.lit(1))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(full)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """The sketch as hexadecimal digits, twelve for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), HASH_BITS // 4, "0")), "")


def _buckets(rows: DataFrame, target: int, coarse: int, fine: int) -> Column:
    """Bucket number of a row by its key: at most ``coarse * fine`` buckets, in key order.

    Approximate quantiles part the keys into intervals of about equal row counts, each
    of which is cut evenly; so far-off ids only concern their own interval.
    """
    marks = F.percentile_approx("key", F.array(*(F.lit(i / coarse) for i in range(1, coarse))), F.lit(1000))
    stats = rows.agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), marks.alias("marks")).first()
    if not stats.n:
        return F.lit(0).cast("bigint")
    starts = sorted({stats.low, *stats.marks})
    parts = max(1, min(fine, -(-stats.n // (coarse * target))))
    out = None
    for i, (a, b) in reversed(list(enumerate(zip(starts, [*starts[1:], stats.high + 1], strict=True)))):
        width = max(1, -(-(b - a) // parts))
        own = F.expr(f"{i * parts}L + least({parts - 1}L, (key - cast('{a}' as bigint)) div {width}L)")
        out = own if out is None else F.when(F.col("key") < F.lit(b), own).otherwise(out)
    return out


def followers(docs: DataFrame, target: int = 256, coarse: int = 64, fine: int = 1024) -> DataFrame:
    """Rows (doc_id, text, print, next_text, next_print): each row with the next one in descending doc_id.

    Rows that share a doc_id come in order of their text; a null doc_id comes last;
    after the last row comes the first.  Rows are dealt into buckets of consecutive
    ids, and each bucket also gets a copy of the row that begins the next bucket, so
    one shuffle of the texts is enough.  Which rows those are is a table of one row a
    bucket, at most ``coarse * fine`` = 65,536 rows of two numbers (1 MB), and so it may
    be broadcast at any size of the input.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)).cast("bigint"))
    rows = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", _buckets(rows.select("key"), target, coarse, fine))
    heads = rows.groupBy("bucket").agg(F.max("key").alias("head"))
    following = heads.selectExpr("bucket as to_bucket", "coalesce(lead(head) over (order by bucket desc), max(head) over ()) as key")
    copies = rows.select("key", "doc_id", "text").join(F.broadcast(following), "key").select("key", "doc_id", "text", F.col("to_bucket").alias("bucket"), F.lit(1).alias("copy"))
    dealt = rows.select("key", "doc_id", "text", "bucket", F.lit(0).alias("copy")).unionByName(copies).withColumn("print", sketch(F.col("text")))
    order = "over (partition by bucket order by copy, key desc, text)"
    return dealt.withColumn("next", F.expr(f"lead(struct(text, print)) {order}")).where("copy = 0").select("doc_id", "text", "print", F.col("next.text").alias("next_text"), F.col("next.print").alias("next_print"))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, whose last third is the beginning of the next document."""
    near = followers(docs).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    new = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next_text"), F.lit(1), third))
    near = near.withColumn("edited", new).withColumn("edited_print", sketch(F.col("edited")))
    return near.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        resemblance(F.col("print"), F.col("edited_print")).alias("near_edited"),
        resemblance(F.col("print"), F.col("next_print")).alias("near_next"),
    )
