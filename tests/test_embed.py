"""Distributed subspace iteration against numpy's dense SVD; embeddings of clauses by topic."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clausemill.operators import embed


def matrix(spark, x, parts=5):
    rows = [(i, Vectors.dense(v) if i % 2 else Vectors.sparse(len(v), {j: a for j, a in enumerate(v) if a})) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, StructType([StructField("id", LongType()), StructField("features", VectorUDT())])).repartition(parts)


@pytest.mark.parametrize("rank", [40, 7])
def test_equals_dense_svd(spark, monkeypatch, rank):
    monkeypatch.setattr(embed, "BLOCK", 7)  # several blocks of terms
    r = np.random.default_rng(2)
    x = (r.normal(size=(230, rank)) * 0.7 ** np.arange(rank)) @ r.normal(size=(rank, 40))
    x[:, 5] = 0.0
    x[11] = 0.0
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    found = embed.fit(matrix(spark, x), "features", 40, dimensions=10, more=10)
    k = min(10, rank)
    assert found.vectors.shape == (40, k) and np.allclose(found.values, s[:k], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(found.vectors * vt[:k].T, 0)), 1, atol=1e-6)
    got = np.array([e.e for e in matrix(spark, x).select("id", found.embedding(F.col("features")).alias("e")).orderBy("id").collect()])
    assert np.allclose(got @ got.T, (u[:, :k] * s[:k] ** 2) @ u[:, :k].T, atol=1e-6) and not got[11].any()
    again = embed.fit(matrix(spark, x, 2), "features", 40, dimensions=10, more=10)
    assert np.allclose(again.vectors, found.vectors, atol=1e-6)


def test_zero_matrix_empty_table_and_bounds(spark):
    x = np.zeros((4, 3))
    for df in (matrix(spark, x, 1), matrix(spark, x, 1).limit(0)):
        assert embed.fit(df, "features", 3).vectors.shape == (3, 0)
    with pytest.raises(ValueError, match="smaller vocabulary"):
        embed.fit(matrix(spark, x, 1), "features", 10**6)


def test_clauses_of_a_topic_lie_together(spark):
    r = np.random.default_rng(3)
    topics = {"pay": "payment invoice amount due fee interest".split(), "data": "personal record privacy consent access storage".split()}
    rows = [(i, t, " ".join(r.choice(topics[t], 8)) + " the party of this") for i, t in enumerate(["pay", "data"] * 60)] + [(500, "pay", None), (501, "data", "")]
    df = spark.createDataFrame(rows, "id long, label string, clause string")
    made = embed.fit_text(df, "clause", dimensions=4).transform(df, "clause")
    assert made.columns == ["id", "label", "clause", "embedding"] and not any(made.where("id = 500").first().embedding)
    e = {x.id: np.array(x.embedding) for x in made.where("id < 500").collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in e.items()}
    same = np.mean([unit[i] @ unit[j] for i in range(0, 120, 7) for j in range(0, 120, 5) if i % 2 == j % 2 and i != j])
    other = np.mean([unit[i] @ unit[j] for i in range(0, 120, 7) for j in range(0, 120, 5) if i % 2 != j % 2])
    assert same > other + 0.3


def test_texts_are_cut_into_words_once_for_all_steps_after_the_vocabulary(spark):
    """Weights, matrix and embeddings each cut the texts into words again."""
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 7} w{i % 5}") for i in range(60)], "doc_id long, text string")
    made = embed.embedded(docs, "text", terms=20, dimensions=4)
    assert made.columns == ["doc_id", "embedding"] and made.count() == 60
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()
