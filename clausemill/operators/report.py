"""Counts, shares, summaries and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions.lexicon import LABELS
from clausemill.operators.rank import with_rank


def counts(rows: DataFrame, by: str) -> DataFrame:
    """by, n, share (percent, two decimals)."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def summary(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, std (sample), min, quartiles (interpolated), max, sum.

    Quartiles are read at their ranks in a range-partitioned order, so no task holds
    all distinct values.
    """
    v = F.col(value)
    placed = with_rank(rows.select(v.alias("v")).where(v.isNotNull()), [F.col("v").asc()], "place")
    one = placed.agg(F.count("v").alias("count"), F.mean("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"))
    shares = (0.25, 0.5, 0.75)
    at = {p: 1 + F.lit(p) * (F.col("count") - 1) for p in shares}
    ends = placed.join(F.broadcast(one.select("count"))).agg(*(F.max(F.when(F.col("place") == f(at[p]), F.col("v"))).alias(f"{side}{int(p * 100)}") for p in shares for side, f in (("low", F.floor), ("high", F.ceil))))
    ends = one.join(F.broadcast(ends))  # one row on either side
    parts = {p: F.col(f"low{int(p * 100)}") + (F.col(f"high{int(p * 100)}") - F.col(f"low{int(p * 100)}")) * (at[p] - F.floor(at[p])) for p in shares}
    return ends.select("count", "mean", "std", "min", *(parts[p].alias(f"p{int(p * 100)}") for p in shares), "max", "sum")


def pivot(rows: DataFrame, by: str, label: str, values: tuple[str, ...] = LABELS) -> DataFrame:
    """Counts of each value in a column of its own, 0 where there are none."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(label) == v).alias(v) for v in values))


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, n, removed: row counts of consecutive tables."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("ord"), F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("removed", F.coalesce(F.lag("n").over(Window.orderBy("ord")) - F.col("n"), F.lit(0)))


def imbalance(rows: DataFrame, label: str) -> DataFrame:
    """ratio of the largest class to the smallest."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).agg((F.max("n") / F.min("n")).alias("ratio"))


def compression(rows: DataFrame, part: str, whole: str) -> DataFrame:
    """Ratio of the two columns' means."""
    return rows.agg((F.mean(part) / F.mean(whole)).alias("ratio"))


def readiness(rows: DataFrame, label: str, vector: str, n_labels: Column, n_terms: int, feature_columns: list[str], min_rows: int = 500) -> DataFrame:
    """check, passed: seven predicates on the final table, and their conjunction."""
    c = rows.groupBy(label).agg(F.count("*").alias("n"), F.max(F.exists(vector, F.isnan)).alias("nan"), F.sum(n_labels.isNotNull().cast("long")).alias("aligned"))
    one = c.agg(
        (F.count("*") == 4).alias("labels"),
        (F.min("n") >= min_rows).alias("rows"),
        (~F.max("nan")).alias("numbers"),
        (F.sum("aligned") == F.sum("n")).alias("aligned"),
        F.lit(n_terms > 1000).alias("terms"),
        F.lit(set(feature_columns) <= set(rows.columns)).alias("features"),
        (F.max("n") / F.min("n") < 2.0).alias("ratio"),
    )
    names = ["labels", "rows", "numbers", "aligned", "terms", "features", "ratio"]
    every = F.lit(True)
    for n in names:
        every = every & F.coalesce(F.col(n), F.lit(False))
    return one.withColumn("all", every).select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(False)).alias("passed")) for n in (*names, "all")))).alias("c")).select("c.*")


def segmentation_check(rows: DataFrame, word_count: str = "word_count") -> DataFrame:
    """total, average words, and whether both lie in the expected ranges."""
    one = rows.agg(F.count("*").alias("total"), F.mean(word_count).alias("average"))
    return one.withColumn("total_ok", F.col("total").between(2000, 10000)).withColumn("average_ok", F.col("average").between(10, 50))


def extraction_summary(manifest: DataFrame) -> DataFrame:
    """domain, ok, skipped, words, average_words, thin (average below 200 words)."""
    ok = F.col("status") == "ok"
    out = manifest.groupBy("domain").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("skipped"), F.coalesce(F.sum(F.when(ok, F.col("word_count"))), F.lit(0)).alias("words"), F.mean(F.when(ok, F.col("word_count"))).alias("average_words"))
    return out.withColumn("thin", F.coalesce(F.col("average_words") < 200, F.lit(True)))


def collection_summary(files: DataFrame) -> DataFrame:
    """domain, files, and the share of all files in percent."""
    return counts(files, "domain").select("domain", F.col("n").alias("files"), "share")


def cards(ranked: DataFrame, values: tuple[str, ...] = LABELS) -> tuple[DataFrame, DataFrame]:
    """What a results page shows: one row of counts (total, each label), and the ranked clauses as cards."""
    head = ranked.agg(F.count("*").alias("total"), *(F.count_if(F.col("label") == v).alias(v.lower()) for v in values))
    own = [c for c in ("doc", "rank", "clause", "label", "badge", "confidence") if c in ranked.columns]
    return head, ranked.select(*own)


def label_summary(rows: DataFrame, label: str) -> DataFrame:
    """One row with the count of each label."""
    return rows.agg(*(F.count_if(F.col(label) == v).alias(v) for v in LABELS))


def confusion(rows: DataFrame, actual: str, predicted: str, values: tuple[str, ...] = LABELS) -> DataFrame:
    """actual, and a count column for each predicted label."""
    return pivot(rows, actual, predicted, values)


def class_metrics(rows: DataFrame, actual: str, predicted: str, values: tuple = LABELS) -> DataFrame:
    """label, precision, recall, f1, support of each label, then of "macro avg", "weighted avg" and "accuracy".

    One aggregation over the rows; a ratio without cases is 0.
    """
    a, p = F.col(actual), F.col(predicted)
    one = rows.agg(F.count("*").alias("total"), *(x for i, v in enumerate(values) for x in (F.count_if((a == v) & (p == v)).alias(f"tp{i}"), F.count_if(p == v).alias(f"pp{i}"), F.count_if(a == v).alias(f"ap{i}"))))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(str(v)).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"pp{i}").alias("pp"), F.col(f"ap{i}").alias("support")) for i, v in enumerate(values)))).alias("c")
    m = one.select("total", each).select("total", "c.*")
    m = m.withColumn("precision", F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0)).withColumn("recall", F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0))
    m = m.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    w = F.col("support") / F.greatest(F.sum("support").over(Window.partitionBy()), F.lit(1))
    m = m.withColumn("w", w)
    names = ("precision", "recall", "f1")
    macro = m.agg(*(F.mean(n).alias(n) for n in names), F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    weighted = m.agg(*(F.sum(F.col(n) * F.col("w")).alias(n) for n in names), F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *names, "support")
    share = F.sum("tp") / F.greatest(F.max("total"), F.lit(1))
    accuracy = m.agg(share.alias("precision"), F.max("total").alias("support")).select(F.lit("accuracy").alias("label"), "precision", F.col("precision").alias("recall"), F.col("precision").alias("f1"), "support")
    return m.select("label", *names, "support").unionByName(macro).unionByName(weighted).unionByName(accuracy)


def mistakes_by_class(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual, predicted, n of wrong rows."""
    return rows.where(F.col(actual) != F.col(predicted)).groupBy(actual, predicted).agg(F.count("*").alias("n"))


def bar(n: Column, unit: int) -> Column:
    """A text bar with one block for every ``unit``."""
    return F.expr("repeat('█', 1)") if unit <= 0 else F.repeat(F.lit("█"), F.floor(n / unit).cast("int"))
