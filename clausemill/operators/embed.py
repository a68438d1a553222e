"""Clause embeddings from the clauses themselves: the leading singular vectors of their TF-IDF matrix.

A stand-in for a sentence encoder, which needs a trained model.  The matrix A has a row a clause and a
column a term of the vocabulary, and stays distributed.  Subspace iteration from a random basis V finds
its right singular vectors: each pass adds up A'(AV) over the rows, in every task for itself and then
by blocks of terms, and the driver orthonormalises it; both sides have terms times dimensions values,
a bound that is checked.  A clause's embedding is its row times the basis.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.operators.ngrams import WORD_TOKEN, ngrams, tokens
from clausemill.plans.stages import cut

#: Most values of a basis (terms times dimensions), and terms of a block.
MOST, BLOCK = 8_000_000, 4_096


def parts(features: Column) -> tuple[Column, Column]:
    """Indices and values of a vector column."""
    v = F.unwrap_udt(features)
    return F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1)), v["values"]


def _times(f: pa.Array, v: pa.Array, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of all entries, and the product of the rows and the basis; terms beyond the basis count nothing."""
    rows = np.repeat(np.arange(len(f)), np.diff(f.offsets.to_numpy()))
    terms, values = f.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
    known = terms < len(basis)
    rows, terms, values = rows[known], terms[known], values[known]
    out = np.zeros((len(f), basis.shape[1]))
    if len(rows):
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        out[rows[first]] = np.add.reduceat(values[:, None] * basis[terms], first, 0)
    return rows, terms, values, out


@dataclass(frozen=True)
class Basis:
    """Right singular vectors (terms by dimensions) and singular values, the greatest first."""

    vectors: np.ndarray
    values: np.ndarray

    def embedding(self, features: Column) -> Column:
        """An array of the dimensions for a vector column; zeros for a clause without known terms."""

        @F.arrow_udf("array<double>")
        def run(f: pa.Array, v: pa.Array) -> pa.Array:
            out = _times(f, v, self.vectors)[3]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

        return run(*parts(features))


def applied(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) over the rows (f, v): partial sums of each task, added up by blocks of terms."""
    wide = basis.shape[1]

    def add(batches):
        total = np.zeros(basis.shape)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own = batch.slice(at, 500)
                rows, terms, values, product = _times(own.column("f"), own.column("v"), basis)
                order = np.argsort(terms, kind="stable")
                if len(order):
                    found, first = np.unique(terms[order], return_index=True)
                    total[found] += np.add.reduceat(values[order, None] * product[rows[order]], first, 0)
        for at in range(0, len(total), BLOCK):
            if total[at : at + BLOCK].any():
                yield pa.RecordBatch.from_pylist([{"block": at, "part": total[at : at + BLOCK].tobytes()}])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True):
                own = np.frombuffer(part).reshape(-1, wide)
                held[block] = held[block] + own if block in held else own
        for block, own in held.items():
            yield pa.RecordBatch.from_pylist([{"block": block, "part": own.tobytes()}])

    out = np.zeros(basis.shape)
    blocks = -(-len(basis) // BLOCK)
    for r in rows.mapInArrow(add, "block long, part binary").repartition(blocks, "block").mapInArrow(merge, "block long, part binary").collect():
        own = np.frombuffer(r.part).reshape(-1, wide)
        out[r.block : r.block + len(own)] = own
    return out


def fit(rows: DataFrame, features: str, size: int, dimensions: int = 64, more: int = 16, passes: int = 6, seed: int = 42) -> Basis:
    """The basis of a table's vector column of ``size`` terms; ``more`` dimensions are carried and dropped at the end. Fewer where the matrix has a lower rank."""
    wide = min(size, dimensions + more)
    if size * wide > MOST:
        raise ValueError(f"a basis of {size} terms and {wide} dimensions is too large for the driver: choose a smaller vocabulary")
    f, v = parts(F.col(features))
    own = cut(rows.where(F.col(features).isNotNull()).select(f.alias("f"), v.alias("v")), "matrix")
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, wide)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(applied(own, basis))[0]
    squares, turn = np.linalg.eigh(basis.T @ applied(own, basis))
    order = np.argsort(-squares)[:dimensions]
    kept = [i for i in order if squares[i] > 1e-10 * max(squares.max(), 1e-300)]
    vectors = basis @ turn[:, kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(kept))]) if kept else np.ones(0)
    return Basis(vectors * signs, np.sqrt(squares[kept]))


@dataclass(frozen=True)
class Model:
    """Terms and their weights, and the basis."""

    terms: PipelineModel
    basis: Basis

    def transform(self, rows: DataFrame, text: str, name: str = "embedding") -> DataFrame:
        """Adds the embeddings of a text column."""
        made = self.terms.transform(rows.withColumn("_words", _grams(text)))
        return made.withColumn(name, self.basis.embedding(F.col("_words_v"))).drop("_words", "_words_tf", "_words_w", "_words_v")


def _grams(text: str) -> Column:
    return ngrams(tokens(F.coalesce(F.col(text), F.lit("")), WORD_TOKEN), 1, 1)


def fit_text(rows: DataFrame, text: str, terms: int = 20_000, dimensions: int = 64, least: int = 2, **how) -> Model:
    """Embeddings of a text column: TF-IDF (smoothed, unit length) of up to ``terms`` words that ``least`` rows have, then the basis."""
    return _fitted(rows.select(_grams(text).alias("_words")), terms, dimensions, least, how)[0]


def embedded(rows: DataFrame, text: str, terms: int = 20_000, dimensions: int = 64, least: int = 2, name: str = "embedding", **how) -> DataFrame:
    """The other columns of the rows and the embeddings of a text column fitted on these rows; texts are cut into words twice, for the vocabulary and for the counts, and not for each step."""
    model, counted = _fitted(rows.withColumn("_words", _grams(text)).drop(text), terms, dimensions, least, how)
    made = counted
    for stage in model.terms.stages[1:]:
        made = stage.transform(made)
    return made.withColumn(name, model.basis.embedding(F.col("_words_v"))).drop("_words_tf", "_words_w", "_words_v")


def _fitted(grams: DataFrame, terms: int, dimensions: int, least: int, how: dict) -> tuple[Model, DataFrame]:
    """The model, and a stage table of the rows with their counts of terms."""
    counter = CountVectorizer(inputCol="_words", outputCol="_words_tf", vocabSize=terms, minDF=float(least)).fit(grams)
    counted = cut(counter.transform(grams).drop("_words"), "counted")
    idf = IDF(inputCol="_words_tf", outputCol="_").fit(counted).idf
    stages = [counter, ElementwiseProduct(inputCol="_words_tf", outputCol="_words_w", scalingVec=Vectors.dense([x + 1 for x in idf.toArray()])), Normalizer(inputCol="_words_w", outputCol="_words_v", p=2.0)]
    weighted = stages[2].transform(stages[1].transform(counted))
    return Model(PipelineModel(stages), fit(weighted, "_words_v", len(counter.vocabulary), dimensions, **how)), counted
