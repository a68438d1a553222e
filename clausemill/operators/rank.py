"""Severity, composite scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions.lexicon import BADGE, SEVERITY
from clausemill.plans.stages import cut


def _map(c: Column, table: dict, default) -> Column:
    out = F
    for key, value in table.items():
        out = out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def severity(label: Column) -> Column:
    """1 to 4; 1 for an unknown label."""
    return _map(label, SEVERITY, 1)


def badge(label: Column) -> Column:
    return _map(label, BADGE, "low")


def composite(label: Column, risk_score: Column) -> Column:
    return severity(label) * 0.6 + risk_score * 0.4


def with_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds 1..n in the given total order.

    Rows are numbered inside range partitions and shifted by the counts of earlier
    ones, so that no single task sorts the table.  The ranged table is written once:
    counts and rows must come from the same partitions.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    spread = cut(spread, "ranked")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    shift = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", "_first", shift.alias("_shift"))
    # one row a partition, so this side is small whatever the input
    return spread.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_shift") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_first", "_shift")


def ranked(rows: DataFrame, label: str, risk_score: str, key: list[str]) -> DataFrame:
    """Adds severity_weight, composite_score and rank; equal scores rank by key."""
    out = rows.withColumn("severity_weight", severity(F.col(label))).withColumn("composite_score", composite(F.col(label), F.col(risk_score)))
    return with_rank(out, [F.col("composite_score").desc(), *(F.col(k).asc() for k in key)])


def top(rows: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """The first n rows; a sort with a limit keeps n rows per task."""
    return rows.orderBy(*order).limit(n)


def ranked_online(rows: DataFrame, document: list[str], position: str) -> DataFrame:
    """Adds badge, severity and rank within each document: by severity, then confidence, then position.

    rows have label and confidence.
    """
    out = rows.withColumn("badge", badge(F.col("label"))).withColumn("severity", severity(F.col("label")))
    order = Window.partitionBy(*document).orderBy(F.desc("severity"), F.desc("confidence"), F.asc(position))
    return out.withColumn("rank", F.row_number().over(order))


def confident_mistakes(rows: DataFrame, actual: str, predicted: str, confidence: str, key: list[str], n: int = 20) -> DataFrame:
    """The wrong rows, most confident first; n of them."""
    return top(rows.where(F.col(actual) != F.col(predicted)), [F.col(confidence).desc(), *(F.col(k).asc() for k in key)], n)


def only_label(rows: DataFrame, label: str, wanted: str | None) -> DataFrame:
    """Rows of one label; all for None or "All"."""
    return rows if wanted in (None, "All") else rows.where(F.col(label) == wanted)
