"""Stage boundaries: tables in the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all runs in one process, else an error."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark.sparkContext.master)).rstrip("/")


@lru_cache(maxsize=1)
def _own_folder(master: str) -> str:
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="clausemill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it back, so that later failures and reuse do not compute it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exploded(rows: DataFrame, keep: list, array: Column | str, name: str, pos: str = "_pos") -> DataFrame:
    """``keep``, place and element of every element of an array.

    Of an inner explode Spark makes a filter on the array, computes the array once more for it
    and pushes it below ``spread``, into the few tasks of the scan; of an outer one it does not.
    """
    return rows.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores is dealt over all cores once; a larger one stays as it is.

    A file of a single row group is one task, however many cores are idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
