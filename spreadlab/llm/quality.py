"""Quality classifier: Naive Bayes log-count ratios and a linear hinge-loss model on top."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.llm.common import keep, small_batches, text_of

# Words and word pairs are hashed to this many features, which bounds the model: eight bytes each.
FEATURES = 1 << 18
# At most about this many labelled rows fit the linear model; all of them count for the ratios.
FIT_ROWS = 4000
# Words of a slice of a text whose features are found at a time.
SLICE = 1 << 16
KNOWN_WORDS = 500_000


@dataclass
class Model:
    """Weights and log-count ratios per hashed n-gram, a bias, and the scale that turns margins into scores."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    scale: float


_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
# Words in a row that are the same, which makes a feature of its own whatever the word is.
RUN = 3


def shape(word: str) -> str:
    """The word with its letters reduced to their case and its digits to 0."""
    cased = _LETTERS.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", word)
    return re.sub(r"\d+", "0", cased)


class Hasher(dict):
    """Words to the hashes of themselves (low half) and of their shape (high half), remembered while there is room."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(shape(word).encode()) << 32 | zlib.crc32(word.encode())
        if len(self) < KNOWN_WORDS and len(word) <= 64:
            self[word] = value
        return value

    def features(self, text: str, size: int) -> np.ndarray:
        """The distinct n-grams of a text as features: words and pairs as written, pairs of shapes, runs of one word."""
        words, found = text.split(), []
        for i in range(0, max(len(words), 1), SLICE):
            part = words[i : i + SLICE + RUN - 1]
            both = np.fromiter(map(self.__getitem__, part), np.uint64, len(part))
            one, shapes = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
            pairs = [x[:-1] * _SIGNS[0] + x[1:] * _SIGNS[k] for k, x in ((1, one), (2, shapes))]
            same = one[1:] == one[:-1]
            runs = _SIGNS[3:] * np.uint64(bool((same[1:] & same[:-1]).any()))
            mixed = np.concatenate([one * _SIGNS[0], *pairs, runs[runs > 0]])
            found.append(np.unique((mixed >> np.uint64(40)) % np.uint64(size)))
        return np.unique(np.concatenate(found)).astype(np.int32)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_features(docs: DataFrame, labels: DataFrame, features: int, label: str = "quality") -> DataFrame:
    """(doc_id, label, features array<int>) of the rows that may be learned from, all whole texts."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for batch in texts:
            yield batch.map(lambda t: hasher.features(t, features))

    taught = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    texts = docs.select("doc_id", text_of("text").alias("text")).where(~held_out(F.col("doc_id")))
    # Labels grow with the documents, so they are not broadcast whatever their size.
    return texts.join(taught.hint("merge"), "doc_id").select("doc_id", "label", of("text").alias("features"))


def log_count_ratios(taught: DataFrame, features: int, smoothing: float) -> np.ndarray:
    """The ratio of each feature's share in class 1 to that in class 0, as a logarithm, over all rows.

    Counts are combined in Spark; what comes back has at most ``features`` rows.
    """
    each = taught.select("label", F.explode("features").alias("feature"))
    counted = each.groupBy("feature").agg(F.count_if(F.col("label") == 1).alias("one"), F.count_if(F.col("label") == 0).alias("zero")).toPandas()
    p, q = np.full(features, smoothing), np.full(features, smoothing)
    p[counted["feature"]] += counted["one"]
    q[counted["feature"]] += counted["zero"]
    return np.log((p / p.sum()) / (q / q.sum()))


def fit_hinge(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model by dual coordinate descent.

    Row i has the value ``ratios[j] / norm`` in each of its features j, norm making it a
    unit vector. Each step solves the dual exactly in one coordinate,
    a' = clip(a - (y w.x - 1) / x.x, 0, C), and moves w by the change.
    """
    weights, bias = np.zeros(len(ratios)), 0.0
    values = [ratios[r] / max(np.linalg.norm(ratios[r]), 1e-12) for r in rows]
    squares = np.array([v @ v + 1.0 for v in values])
    alpha = np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            slope = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return weights, bias


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    features: int = FEATURES,
    fit_rows: int = FIT_ROWS,
    smoothing: float = 1.0,
    cost: float = 1.0,
    rounds: int = 30,
    seed: int = 7,
) -> Model:
    """The model learned from the labelled rows that are not held out.

    The log-count ratios are over all of these rows. The hinge loss is fitted on a
    sample of about ``fit_rows`` of them, chosen by hash of the id, in one task. A label
    other than 0 or 1 is ignored; of several labels of a doc_id the largest counts. Without
    labelled rows every score is 0.5.
    """
    taught = keep(labelled_features(docs, labels, features, label), "taught")
    ratios = log_count_ratios(taught, features, smoothing)
    total = taught.count()
    share = min(1.0, fit_rows / max(total, 1))
    sample = taught.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = pd.concat([pd.DataFrame(columns=["doc_id", "label", "features"]), *batches]).sort_values("doc_id")
        if group.empty:
            return
        rows = [np.asarray(r) for r in group["features"]]
        signs = np.where(group["label"] == 1, 1.0, -1.0)
        weights, bias = fit_hinge(rows, signs, ratios, cost, rounds, seed)
        margins = np.array([_margin(weights, bias, ratios, r) for r in rows]) * signs
        yield pd.DataFrame({"weights": [weights], "bias": [bias], "spread": [float(np.median(np.abs(margins)))]})

    found = sample.repartition(1).mapInPandas(one, "weights array<double>, bias double, spread double").first()
    if found is None:
        return Model(np.zeros(features), ratios, 0.0, 1.0)
    return Model(np.asarray(found["weights"]), ratios, found["bias"], math.log(9) / max(found["spread"], 1e-9))


def _margin(weights: np.ndarray, bias: float, ratios: np.ndarray, row: np.ndarray) -> float:
    value = ratios[row]
    return float(weights[row] @ value / max(np.linalg.norm(value), 1e-12) + bias)


def score(model: Model, spark: SparkSession):
    """A function of a text column: the score, 0 to 1, of every whole text; null counts as empty."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, m = Hasher(), shared.value
        for batch in texts:
            margins = batch.map(lambda t: _margin(m.weights, m.bias, m.ratios, hasher.features(t, len(m.ratios)))).astype(float)
            yield 1 / (1 + np.exp(-np.clip(m.scale * margins, -500, 500)))

    return lambda column: of(text_of(column))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    ``score`` is 0 to 1, higher where label 1 is likelier, and depends on the text alone;
    an empty or null text gets the score of the bias. ``predicted`` is 1 from 0.5 on.
    Repeated rows and null ids stay. Without labels every score is 0.5. Other columns
    are not read.
    """
    model = fit(docs, labels, **options)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, docs.sparkSession)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text the model does not reject."""
    model = fit(docs, labels, **options)
    return docs.where(score(model, docs.sparkSession)("text") >= 0.5)
