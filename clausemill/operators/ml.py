"""Features, ensemble and scoring for clause labels.

The three members are boosted trees grown by level, boosted trees grown leaf by leaf, and
extremely randomised trees (``trees``); their class probabilities are averaged.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IDF, Normalizer, SQLTransformer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import trees as T
from clausemill.operators.ngrams import CHUNK, WORD_TOKEN, char_ngrams, ngrams, tokens
from clausemill.plans.stages import cut, exploded

NUMERIC = ("modal_score", "consequence_score", "conditional_score", "has_negation", "obligation_count", "penalty_flag", "word_count")


def codes(labels) -> dict[str, int]:
    """Alphabetical label codes."""
    return {label: i for i, label in enumerate(sorted(labels))}


def prepare(rows: DataFrame, text: str) -> DataFrame:
    """Adds word (1-2) and character (3-5) n-grams; stop words leave before word n-grams form."""
    stop = F.array(*(F.lit(w) for w in StopWordsRemover.loadDefaultStopWords("english")))
    words = F.filter(tokens(F.col(text), WORD_TOKEN), lambda w: ~F.array_contains(stop, w))
    return rows.withColumn("_words", ngrams(words, 1, 2)).withColumn("_chars", char_ngrams(F.col(text)))


def scale_statement(rows: DataFrame, columns: tuple[str, ...]) -> str:
    """SQL that centres columns and divides them by their population deviation (by 1 where that is 0)."""
    one = rows.agg(*(x for c in columns for x in (F.mean(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first()
    parts = [f"(coalesce({c}, 0) - {float(one[f'm_{c}'] or 0)!r}D) / {float(one[f's_{c}'] or 1) or 1.0!r}D AS _z_{c}" for c in columns]
    return f"SELECT *, {', '.join(parts)} FROM __THIS__"


def fit_features(rows: DataFrame, text: str, n_words: int = 2000, n_chars: int = 1000, numeric: tuple[str, ...] = NUMERIC) -> PipelineModel:
    """Word and character TF-IDF (smoothed idf, L2) and scaled numbers in one vector, fitted on these rows only; of terms as frequent the first by name are kept."""
    grams = prepare(rows, text)
    stages = []
    for source, size in (("_words", n_words), ("_chars", n_chars)):
        counts = exploded(grams, [], source, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        terms = [r.term for r in counts.orderBy(F.desc("n"), F.asc("term")).limit(size).collect()]
        counter = CountVectorizerModel.from_vocabulary(terms, inputCol=source, outputCol=f"{source}_tf")
        idf = IDF(inputCol=f"{source}_tf", outputCol="_").fit(counter.transform(grams)).idf
        weights = ElementwiseProduct(inputCol=f"{source}_tf", outputCol=f"{source}_w", scalingVec=Vectors.dense([x + 1 for x in idf.toArray()]))
        stages += [counter, weights, Normalizer(inputCol=f"{source}_w", outputCol=f"{source}_v", p=2.0)]
    stages.append(SQLTransformer(statement=scale_statement(rows, numeric)))
    stages.append(VectorAssembler(inputCols=["_words_v", "_chars_v", *(f"_z_{c}" for c in numeric)], outputCol="features"))
    return PipelineModel(stages)


#: Tokens and cells that ``TokenVectors`` holds at once.
TOKENS, CELLS = 500_000, 1 << 22


@dataclass
class TokenVectors:
    """What the stages of ``fit_features`` make of a batch of tokens: the same numbers, summed in the same order, without a string for each n-gram.

    Equal tokens of a batch are looked up once. Character n-grams lie within a token, so its share of
    the counts is one list of places, made once; a pair of words is a number made of the places that
    its parts have in the vocabulary's pairs.
    """

    words: list[str]
    chars: list[str]
    weights: tuple[np.ndarray, np.ndarray]
    stop: frozenset[str]
    held: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self):
        self.char = {t: i for i, t in enumerate(self.chars)}
        pairs = [(*t.split(" "), i) for i, t in enumerate(self.words) if " " in t]
        first, second = ({t: i for i, t in enumerate(dict.fromkeys(p[k] for p in pairs))} for k in (0, 1))
        self.first, self.second = list(first), list(second)
        keys = np.array([first[a] * len(second) + second[b] for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.places = keys[order], np.array([i for *_, i in pairs], np.int64)[order]

    @staticmethod
    def of(features: PipelineModel) -> TokenVectors:
        word, word_weights, _, char, char_weights, *_ = features.stages
        return TokenVectors(list(word.vocabulary), list(char.vocabulary), (word_weights.getScalingVec().toArray(), char_weights.getScalingVec().toArray()), frozenset(StopWordsRemover.loadDefaultStopWords("english")))

    def _within(self, token: str) -> list[int]:
        """Places of the character n-grams of a token, as ``char_ngrams`` has them."""
        if (found := self.held.get(token)) is None:
            padded = f" {token} "
            own = (self.char.get(padded[i : i + n], -1) for n in (3, 4, 5) for i in range(len(padded) - n + 1))
            found = self.held[token] = [x for x in own if x >= 0]
        return found

    def _words(self, rows: np.ndarray, codes: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, places) of words and pairs of words."""
        at = lambda known: pc.index_in(terms, pa.array(known, terms.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        kept = (at(sorted(self.stop)) < 0)[codes]
        rows, codes = rows[kept], codes[kept]
        single = at(self.words)[codes]
        if not len(self.keys):
            return rows[single >= 0], single[single >= 0]
        a, b = at(self.first)[codes[:-1]], at(self.second)[codes[1:]]
        some = np.flatnonzero((a >= 0) & (b >= 0) & (rows[:-1] == rows[1:]))
        key = a[some] * len(self.second) + b[some]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        return np.concatenate([rows[single >= 0], rows[some[hit]]]), np.concatenate([single[single >= 0], self.places[place[hit]]])

    def _chars(self, rows: np.ndarray, codes: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        used, codes = np.unique(codes, return_inverse=True)
        found = [self._within(t) for t in terms.to_numpy(zero_copy_only=False)[used].tolist()]
        count = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(count.sum()))
        if len(self.held) > 1 << 16:
            self.held.clear()
        many = count[codes]
        start = (np.cumsum(count) - count)[codes]
        return np.repeat(rows, many), flat[np.arange(int(many.sum())) + np.repeat(start - (np.cumsum(many) - many), many)]

    @staticmethod
    def _weighed(rows: np.ndarray, places: np.ndarray, n: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, places, values) by place, then row."""
        counts = np.bincount(places * n + rows, minlength=1)
        at = np.flatnonzero(counts)
        places, rows = np.divmod(at, n)
        values = counts[at] * weights[places]
        norm = np.sqrt(np.bincount(rows, values * values, n))  # adds up a row in the order of places, as Normalizer does
        return rows, places, values / norm[rows]

    def slices(self, words: pa.Array, chunks: pa.Array, numbers: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of rows, features, values, rows) of some rows at a time; features rise."""
        lists = [_encoded(x) for x in (words, chunks)]
        numbers = numbers.flatten().to_numpy(zero_copy_only=False).reshape(len(words), -1)
        if np.isnan(numbers).any():
            raise ValueError("NaN among the numbers of a row")
        sizes, first = (len(self.words), len(self.chars)), 0
        most = max(1, CELLS // max(1, *sizes))
        while first < len(words):
            last = min([len(words), first + most, *(int(np.searchsorted(o, o[first] + TOKENS, "right")) - 1 for _, _, o in lists)])
            last, parts, before = max(last, first + 1), [], 0
            for (codes, terms, o), count, weights in zip(lists, (self._words, self._chars), self.weights, strict=True):
                own = np.repeat(np.arange(last - first), np.diff(o[first : last + 1]))
                rows, places, values = self._weighed(*count(own, codes[o[first] : o[last]], terms), last - first, weights)
                parts.append((rows, places + before, values))
                before += len(weights)
            rows, places = np.arange(last - first), np.arange(numbers.shape[1])
            parts.append((np.tile(rows, len(places)), np.repeat(places + before, len(rows)), numbers[first:last].T.ravel()))
            rows, places, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield last - first, places, values, rows
            first = last


def _encoded(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all elements, what they stand for, and where each list begins."""
    flat = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary, (offsets - offsets[0]).astype(np.int64)


def _weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds balanced class weights n / (classes * n_class); labels are few."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("n"), F.count("*").alias("k")).first()
    return rows.join(counts, label).withColumn("_weight", total.n / (total.k * F.col("_n"))).drop("_n")


MEMBERS = ("boosted", "leafwise", "drawn")


@dataclass
class Ensemble:
    """Fitted features and members."""

    labels: tuple[str, ...]
    text: str
    features: PipelineModel
    boosted: T.Model
    leafwise: T.Model
    drawn: T.Model

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds probabilities (by label code), predicted_risk_label and confidence (0 to 1)."""
        scaled, assembled = self.features.stages[-2:]
        out = scaled.transform(rows)
        hidden = [c for c in out.columns if c.startswith("_")]
        numbers = F.array(*(F.col(c).cast("double") for c in assembled.getInputCols()[2:]))
        out = out.withColumn("probabilities", self._probabilities()(tokens(F.col(self.text), WORD_TOKEN), tokens(F.col(self.text), CHUNK), numbers))
        out = out.withColumn("confidence", F.array_max("probabilities"))
        names = F.array(*(F.lit(x) for x in self.labels))
        out = out.withColumn("predicted_risk_label", F.element_at(names, F.array_position("probabilities", F.col("confidence")).cast("int")))
        return out.drop(*hidden)

    def _probabilities(self):
        """A function of words, tokens between white space and scaled numbers: the mean of the members' probabilities."""
        vectors, members = TokenVectors.of(self.features), [getattr(self, name) for name in MEMBERS]
        alike = [next(i for i, x in enumerate(members) if x.bins.equals(m.bins)) for m in members]

        @F.arrow_udf("array<double>")
        def run(words: pa.Array, chunks: pa.Array, numbers: pa.Array) -> pa.Array:
            out = [np.zeros((0, members[0].classes))]
            for own in vectors.slices(words, chunks, numbers):
                blocks = {i: T.block(*own, members[i].bins) for i in set(alike)}
                a, b, c = (m.scores(blocks[i]) for m, i in zip(members, alike, strict=True))
                out.append((a + b + c) / 3)
            p = np.concatenate(out)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))

        return run

    def importance(self, spark, n: int = 15) -> DataFrame:
        """The most important features, by their gain in the boosted member."""
        stages = self.features.stages
        names = [f"word:{w}" for w in stages[0].vocabulary] + [f"char:{w}" for w in stages[3].vocabulary] + list(NUMERIC)
        top = sorted(zip(names, self.boosted.importance().tolist(), strict=False), key=lambda x: (-x[1], x[0]))[:n]
        return spark.createDataFrame(top, "feature string, importance double")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.features.write().overwrite().save(f"{path}/features")
        for name in MEMBERS:
            getattr(self, name).save(spark, f"{path}/{name}")
        spark.createDataFrame([(self.text, list(self.labels))], "text string, labels array<string>").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> Ensemble:
        meta = spark.read.parquet(f"{path}/meta").first()
        return Ensemble(tuple(meta.labels), meta.text, PipelineModel.load(f"{path}/features"), *(T.Model.load(spark, f"{path}/{name}") for name in MEMBERS))


def fit(train: DataFrame, text: str, label: str = "risk_label", trees: int = 300, boosts: int = 300, depth: int = 8, n_words: int = 2000, n_chars: int = 1000, seed: int = 42) -> Ensemble:
    """Trains the three members on these rows (split and balance before); rows without a label are left out.

    Boosted by level: learning rate 0.1, nine tenths of the rows and eight of the features a tree, L2 weight 0.5.
    Leaf by leaf: up to 31 leaves of five rows or more, balanced class weights.  Drawn: leaves of two rows or
    more, balanced class weights.
    """
    labels, features, ready = _ready(train, text, label, n_words, n_chars)
    plain, weighted = T.binned(ready, "features", "_y"), T.binned(ready, "features", "_y", "_weight")
    with ThreadPoolExecutor(3) as pool:  # no member waits for another
        boosted = pool.submit(T.boost, plain, boosts, depth=depth, l2=0.5, row_share=0.9, feature_share=0.8, seed=seed)
        leafwise = pool.submit(T.boost, weighted, boosts, depth=depth, leaves=31, l2=0.0, few=5, seed=seed)
        drawn = pool.submit(T.randomised, weighted, trees, few=2, seed=seed)
        return Ensemble(labels, text, features, boosted.result(), leafwise.result(), drawn.result())


@dataclass
class Baseline:
    """Fitted features and one classifier of MLlib."""

    labels: tuple[str, ...]
    text: str
    features: PipelineModel
    classifier: Transformer

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds probabilities (by label code), predicted_risk_label and confidence (0 to 1), as the ensemble does."""
        out = self.features.transform(prepare(rows, self.text))
        hidden = [c for c in out.columns if c.startswith("_")]
        out = self.classifier.copy({self.classifier.predictionCol: "", self.classifier.rawPredictionCol: "", self.classifier.probabilityCol: "_p"}).transform(out)
        out = out.withColumn("probabilities", vector_to_array("_p")).withColumn("confidence", F.array_max("probabilities"))
        names = F.array(*(F.lit(x) for x in self.labels))
        return out.withColumn("predicted_risk_label", F.element_at(names, F.array_position("probabilities", F.col("confidence")).cast("int"))).drop(*hidden, "_p", "features")


def _ready(train: DataFrame, text: str, label: str, n_words: int, n_chars: int) -> tuple[tuple[str, ...], PipelineModel, DataFrame]:
    """Labels, fitted features, and a stage table (features, _y, _weight) of the rows with a label."""
    # once: what rows were chosen from may be far larger than they are
    known = cut(train.where(F.col(label).isNotNull()).select(label, text, *NUMERIC), "chosen")
    labels = tuple(sorted(r[label] for r in known.select(label).distinct().collect()))
    features = fit_features(known, text, n_words, n_chars)
    code = F.create_map(*(F.lit(x) for name, i in codes(labels).items() for x in (name, i)))
    return labels, features, cut(features.transform(prepare(_weights(known, label), text)).select("features", code[F.col(label)].alias("_y"), "_weight"), "training")


def baseline(train: DataFrame, text: str, kind: str = "logistic", label: str = "risk_label", trees: int = 100, n_words: int = 2000, n_chars: int = 1000, seed: int = 42) -> Baseline:
    """A plain classifier to hold the ensemble against: ``logistic`` regression or a random ``forest``, with balanced class weights."""
    labels, features, ready = _ready(train, text, label, n_words, n_chars)
    common = {"featuresCol": "features", "labelCol": "_y", "weightCol": "_weight"}
    if kind == "logistic":
        model = LogisticRegression(**common, regParam=0.01, maxIter=100, family="multinomial")
    elif kind == "forest":
        model = RandomForestClassifier(**common, numTrees=trees, maxDepth=10, seed=seed)
    else:
        raise ValueError(f"no baseline {kind!r}: logistic or forest")
    return Baseline(labels, text, features, model.fit(ready))


#: What ``search`` draws from.
RANGES = {"rounds": (50, 100, 200, 300), "depth": (4, 6, 8), "rate": (0.05, 0.1, 0.2), "l2": (0.1, 0.5, 1.0), "row_share": (0.8, 0.9, 1.0), "feature_share": (0.6, 0.8, 1.0)}


def search(train: DataFrame, text: str, label: str = "risk_label", draws: int = 8, folds: int = 3, ranges: dict[str, tuple] = RANGES, n_words: int = 2000, n_chars: int = 1000, seed: int = 42) -> list[dict]:
    """Random search for the boosted member's parameters: each draw with its mean macro F1 over the folds, the best first (of equals the first drawn).

    A text has one fold, by its hash, so copies never lie on both sides; features are
    fitted on the training side alone.  A label that a fold lacks does not count there.
    """
    chosen: list[dict] = []
    r = random.Random(seed)
    combinations = math.prod(len(v) for v in ranges.values())
    while len(chosen) < min(draws, combinations):
        one = {k: r.choice(v) for k, v in ranges.items()}
        chosen += [one] if one not in chosen else []
    fold = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(seed)), F.lit(folds))
    scores: list[list[float]] = [[] for _ in chosen]
    for k in range(folds):
        labels, features, ready = _ready(train.where(fold != k), text, label, n_words, n_chars)
        data = T.binned(ready, "features", "_y")
        held = cut(features.transform(prepare(train.where((fold == k) & F.col(label).isNotNull()), text)).select("features", label), "held-out")
        names = F.array(*(F.lit(x) for x in labels))
        for one, own in zip(chosen, scores, strict=True):
            p = T.boost(data, **one, seed=seed).probabilities(F.col("features"))
            counts = held.select(label, p.alias("p")).select(F.col(label).alias("actual"), F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("predicted")).groupBy("actual", "predicted").count().collect()
            own.append(macro_f1([(x.actual, x.predicted, x["count"]) for x in counts]))
    found = [{"score": sum(own) / max(1, len(own)), **one} for one, own in zip(chosen, scores, strict=True)]
    return sorted(found, key=lambda x: -x["score"])


def macro_f1(counts: list[tuple[str, str, int]]) -> float:
    """The mean F1 of the labels that occur, from (actual, predicted, n); 0 without rows."""
    out = []
    for label in sorted({a for a, _, _ in counts}):
        hit = sum(n for a, p, n in counts if a == p == label)
        out.append(2 * hit / (sum(n for a, _, n in counts if a == label) + sum(n for _, p, n in counts if p == label)))
    return sum(out) / len(out) if out else 0.0


def predict_one(model: Ensemble, spark, clause: str, numbers: dict[str, float | str | None]) -> DataFrame:
    """One clause with typed-in numbers; a blank or invalid number counts as 0."""

    def number(x) -> float:
        try:
            return float(x)
        except (TypeError, ValueError):
            return 0.0

    row = (clause, *(number(numbers.get(c)) for c in NUMERIC))
    return model.transform(spark.createDataFrame([row], ", ".join([f"`{model.text}` string", *(f"{c} double" for c in NUMERIC)])))
