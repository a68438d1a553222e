"""Vector checks and similarities on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def has_nan(a: Column) -> Column:
    return F.exists(a, F.isnan)


def norm_report(rows: DataFrame, vector: str) -> DataFrame:
    return rows.agg(F.mean(norm(F.col(vector))).alias("mean_norm"), F.coalesce(F.bool_or(has_nan(F.col(vector))), F.lit(False)).alias("any_nan"), F.count("*").alias("n"))


def _unit_sums(rows: DataFrame, label: str, vector: str, key: str, first: int) -> DataFrame:
    """label, n and the sum of unit vectors, of the first rows of each label.

    The mean over all pairs' cosines is the dot product of such sums, so no pairs are
    formed.
    """
    place = F.row_number().over(Window.partitionBy(label).orderBy(key))
    own = rows.select(F.col(label).alias("label"), F.col(vector).alias("v"), place.alias("place")).where(F.col("place") <= first).withColumn("norm", norm(F.col("v")))
    cells = own.select("label", F.posexplode("v").alias("i", "x"), "norm")
    sums = cells.groupBy("label", "i").agg(F.sum(F.when(F.col("norm") > 0, F.col("x").cast("double") / F.col("norm")).otherwise(0.0)).alias("s"))
    whole = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda c: c["s"]).alias("s"))
    sizes = own.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("norm") > 0).alias("nonzero"))
    return whole.join(sizes, "label")


def cohesion(rows: DataFrame, label: str, vector: str, key: str, first: int = 100) -> DataFrame:
    """label, n, cohesion: mean cosine over all n * n pairs with the diagonal counted as 0; labels of one row are left out."""
    u = _unit_sums(rows, label, vector, key, first).where("n >= 2")
    return u.select("label", "n", ((dot(F.col("s"), F.col("s")) - F.col("nonzero")) / (F.col("n") * F.col("n"))).alias("cohesion"))


def cross_similarity(rows: DataFrame, label: str, vector: str, key: str, first: int = 50) -> DataFrame:
    """label_a < label_b, similarity: mean cosine of all pairs between the first rows of two labels."""
    u = _unit_sums(rows, label, vector, key, first)
    a, b = (u.select(F.col("label").alias(f"label_{x}"), F.col("s").alias(f"s_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    if b.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 labels are too many for every pair of them")
    return a.join(F.broadcast(b), F.col("label_a") < F.col("label_b")).select("label_a", "label_b", (dot(F.col("s_a"), F.col("s_b")) / (F.col("n_a") * F.col("n_b"))).alias("similarity"))


def unaligned(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Keys that only one of the tables has, with the side that has them."""
    left = rows.select(key).join(others.select(key), key, "left_anti").select(key, F.lit("left").alias("side"))
    right = others.select(key).join(rows.select(key), key, "left_anti").select(key, F.lit("right").alias("side"))
    return left.unionByName(right)
