"""Connected components of an edge table, by alternating large and small stars.

Edges stay distributed, ``PART`` or a few more to a partition.  Every partition replaces
its edges by a spanning star per local component, which settles a graph of one
partition and shortens long chains in others; there large-star and small-star steps
follow, until every node hangs on the smallest of its component.  Smallest neighbours
are aggregated before they are shuffled, so a star of any size costs one row a task.
Each round is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import materialise

#: Edges of a partition, about; a task's memory follows from it.
PART = 200_000


def _stars(batches):
    """Local union-find: (node, root) for every node but the roots."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for at in range(0, len(nodes), 100_000):
        own = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.array([root(x) for x in own], np.int64))], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its smallest node."""
    e = edges.select("u", "v").where("u <> v")
    while True:
        parts = 1 + e.count() // PART
        e = materialise(e.coalesce(parts).mapInArrow(_stars, "u long, v long").distinct(), "edges")
        if parts == 1 or _settled(e):
            break
        both = e.union(e.select("v", "u"))
        large = both.where("v > u").join(both.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = materialise(small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").where("u <> v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _settled(e: DataFrame) -> bool:
    """Whether every node has one parent, which has none."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()
