"""n-gram vocabularies and TF-IDF weights as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.plans.stages import cut, exploded

#: Buckets that terms are counted in before they are counted themselves.
BUCKETS = 1 << 20
COUNT_TOKEN, WORD_TOKEN, CHUNK = r"(?U)\b[a-z][a-z]+\b", r"(?U)\b\w\w+\b", r"(?U)\S+"


def tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def _run(own: Column, n: int):
    return lambda i: F.concat_ws(" ", *(F.get(own, i + (k - 1)) for k in range(n)))


def _piece(padded: Column, n: int):
    return lambda i: F.substring(padded, i, F.lit(n))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of low to high words, joined by spaces."""

    def runs(own: Column) -> Column:
        out = []
        for n in range(low, high + 1):
            many = own if n == 1 else F.transform(F.sequence(F.lit(1), F.size(own) - (n - 1)), _run(own, n))
            out.append(F.when(F.size(own) >= n, many).otherwise(F.array().cast("array<string>")))
        return F.concat(*out)

    return F.transform(F.array(words), runs)[0]


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside space-padded words; a word shorter than n counts once, whole."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        parts = []
        for n in range(low, high + 1):
            many = F.transform(F.sequence(F.lit(1), size - (n - 1)), _piece(padded, n))
            # a word as long as n or shorter gives itself once, at the first such n
            once = F.when(size == n, F.array(padded)).when((size < n) & F.lit(n == low), F.array(padded)).otherwise(F.array().cast("array<string>"))
            parts.append(F.when(size > n, many).otherwise(once))
        return F.concat(*parts)

    return F.flatten(F.transform(tokens(text, CHUNK), of))


def term_counts(rows: DataFrame, key: str, grams: Column) -> DataFrame:
    """key, term, tf.

    Rows are dealt by key before their terms are exploded, so that texts cross the
    network once and no term does: counts by key and term then need no shuffle.
    """
    return rows.repartition(F.col(key)).select(F.col(key).alias("key"), F.explode(grams).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, min_df: int = 2, most: int | None = 8000) -> DataFrame:
    """term, df, tf: terms of at least min_df documents; the ``most`` largest counts (ties by term)."""
    v = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= min_df)
    return v.orderBy(F.desc("tf"), F.asc("term")).limit(most) if most else v


def top_terms(rows: DataFrame, grams: Column, min_df: int = 2, most: int = 8000) -> DataFrame:
    """The vocabulary (term, df, tf) of rows that are one document each, as ``vocabulary`` has it, without a count of every term.

    Terms are first counted in buckets by hash. Those of the fullest buckets are counted for
    themselves; the count of the last of the ``most`` among them is one that no term of a less full
    bucket can reach, so only the terms of buckets as full as that are left to count.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
    full = cut(exploded(rows, [], grams, "term").select(bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")

    def counted(buckets: DataFrame) -> DataFrame:
        # in sorted order the first of equal terms of a row counts for df
        each = F.transform(F.array(F.sort_array(grams)), lambda g: F.transform(g, lambda x, i: F.struct(x.alias("term"), F.coalesce(F.get(g, i - 1) != x, F.lit(True)).cast("int").alias("first"))))[0]
        own = exploded(rows, [], each, "x").select("x.term", "x.first").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        own = own.join(F.broadcast(buckets.select("bucket")), "bucket", "left_semi")  # BUCKETS rows at most
        return own.groupBy("term").agg(F.sum("first").alias("df"), F.count(F.lit(1)).alias("tf")).where(F.col("df") >= min_df)

    first = full.orderBy(F.desc("n"), "bucket").limit(2 * most)
    found = cut(counted(first), "terms")
    last = found.orderBy(F.desc("tf")).limit(most).agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf")).first()
    rest = full.join(F.broadcast(first.select("bucket")), "bucket", "left_anti")
    rest = rest.where(F.col("n") >= last.tf) if last.n == most else rest
    if not rest.isEmpty():
        found = found.unionByName(counted(rest))
    return found.orderBy(F.desc("tf"), F.asc("term")).limit(most)


def top_char_terms(words: DataFrame, low: int = 3, high: int = 5, most: int = 1000) -> DataFrame:
    """(term, tf): the ``most`` most frequent character n-grams of a column ``word``; those of equal words are made once."""
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return exploded(counts, ["n"], char_ngrams(F.col("word"), low, high), "term").groupBy("term").agg(F.sum("n").alias("tf")).orderBy(F.desc("tf"), F.asc("term")).limit(most)


def known_counts(rows: DataFrame, key: str, grams: Column, vocab: DataFrame) -> DataFrame:
    """key, term, tf of the terms of a vocabulary that is bounded: others leave before anything is held of them. Dealt by key."""
    terms = exploded(rows.repartition(F.col(key)), [F.col(key).alias("key")], grams, "term")
    return terms.join(F.broadcast(vocab.select("term")), "term", "left_semi").groupBy("key", "term").agg(F.count("*").alias("tf"))


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: Column | int, sublinear: bool = False) -> DataFrame:
    """key, term, weight: smoothed idf, L2-normalised per key.

    The vocabulary joins as a table; it is broadcast only where Spark finds it small.
    """
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    tf = 1 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    raw = counts.join(vocab.select("term", "df"), "term").select("key", "term", (tf * idf).alias("w"))
    total = F.sqrt(F.expr("sum(w * w) over (partition by key)"))
    return raw.select("key", "term", (F.col("w") / total).alias("weight"))
