"""Balanced classes, hash-ordered samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.operators.rank import with_rank
from clausemill.plans.stages import cut

#: Rows of chosen keys that go to every task.
CHOSEN = 1_000_000


def hash_order(key: list[str], seed: int) -> Column:
    """A stable pseudo-random order of rows by their key: the MD5 of the key's parts as text and the seed, which any engine can state."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key), F.lit(str(seed))))


def top_per_class(rows: DataFrame, label: str, score: str, key: list[str], k: int) -> DataFrame:
    """The k best-scored rows of each class; they are found by label, score and key alone, so that no other column of the rest is sorted."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.desc(score), *(F.col(c).asc() for c in key)))
    names = list(dict.fromkeys([label, score, *key]))
    first = cut(rows.select(*names).withColumn("_place", place).where(F.col("_place") <= k).drop("_place").distinct(), "chosen")
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"rest.{c}").eqNullSafe(F.col(f"first.{c}"))
    few = F.broadcast(first) if first.count() <= CHOSEN else first
    # rows that agree in all of these are still ranked
    return rows.alias("rest").join(few.alias("first"), same, "left_semi").withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def balance(rows: DataFrame, label: str, score: str, key: list[str], k: int = 1000, seed: int = 42) -> DataFrame:
    """k rows of each class: the best-scored of a large class, and repeated rows of a small one.

    A class of n < k rows is repeated k // n + 1 times and cut to k in hash order, so
    a row appears that often at most.  Adds ``copy`` (0 for a large class).  A class
    without rows gives none.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    known = rows.join(counts, rows[label].eqNullSafe(counts[label])).drop(counts[label])
    large = top_per_class(known.where(F.col("_n") >= k), label, score, key, k).withColumn("copy", F.lit(0))
    copies = known.where(F.col("_n") < k).withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr(f"cast({k} div _n as int)"))))
    place = F.row_number().over(Window.partitionBy(label).orderBy(hash_order([*key, "copy"], seed), *key, "copy"))
    small = copies.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
    return large.unionByName(small).drop("_n")


def shuffled(rows: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """All rows in hash order."""
    return rows.orderBy(hash_order(key, seed), *key)


def preview(rows: DataFrame, key: list[str], n: int, seed: int = 42, label: str | None = None) -> DataFrame:
    """n random rows, or n of each class."""
    if label is None:
        return shuffled(rows, key, seed).limit(n)
    place = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(key, seed), *key))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def stratified_split(rows: DataFrame, label: str, key: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: floor(share * n) rows of each class in hash order of the key.

    Give a key that copies of a row share (such as the text), and split before
    balancing: then no test row has a copy among the training rows.
    """
    groups = rows.select(label, *key).distinct()
    # ranks of the whole order less those before the label: no task sorts a label alone
    placed = with_rank(groups, [F.col(label).asc(), hash_order(key, seed).asc(), *(F.col(k).asc() for k in key)], "_place")
    sizes = placed.groupBy(F.col(label).alias("_label")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    marked = placed.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).withColumn("is_test", F.col("_place") - F.col("_first") < F.floor(F.col("_n") * test_share))
    marked = marked.select(*(F.col(c).alias(f"_{c}") for c in (label, *key)), "is_test")
    same = None
    for c in (label, *key):
        e = rows[c].eqNullSafe(marked[f"_{c}"])
        same = e if same is None else same & e
    return rows.join(marked, same).drop(*(f"_{c}" for c in (label, *key)))
