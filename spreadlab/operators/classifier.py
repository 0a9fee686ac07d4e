"""Classifier for whether a cascade spreads between two authors, and its scores."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.operators.boosting import BoostedTrees, Tree, free_name
from spreadlab.operators.encoding import Encoder, ValueCounts, modes

__all__ = ["LABEL", "PropagationModel", "classification_metrics", "confusion_matrix", "hash_split", "modes", "performance"]

LABEL = "propagated"


class PropagationModel:
    """Mode imputation, categories and boosted trees with a weighted positive class.

    Values are not scaled for the trees, which only ask for their order.
    """

    def __init__(self, rounds: int = 4, depth: int = 6, step: float = 0.3, label: str = LABEL):
        self.rounds, self.depth, self.step, self.label = rounds, depth, step, label
        self.encoder = Encoder()
        self.model: BoostedTrees | None = None

    @property
    def fills(self) -> dict:
        return self.encoder.fills

    @property
    def texts(self) -> list[str]:
        return self.encoder.texts

    @property
    def numbers(self) -> list[str]:
        return self.encoder.numbers

    def fit(self, rows: DataFrame, features: Sequence[str] | None = None) -> PropagationModel:
        """Learn from labelled rows; ``features`` are all other columns if not named."""
        names = [c for c in (features or rows.columns) if c != self.label]
        every, negatives, positives = rows.agg(
            F.count(F.lit(1)), F.count_if(F.col(self.label) == 0), F.count_if(F.col(self.label) == 1)
        ).first()
        if not positives or not negatives:
            raise ValueError("training needs rows of both classes")
        counts = ValueCounts(rows, names)
        self.encoder = Encoder().fit(rows, names, counts)
        weight = F.when(F.col(self.label) == 1, negatives / positives).otherwise(1.0)
        labelled = rows.where(F.col(self.label).isin(0, 1))
        known = counts if negatives + positives == every else None
        self.model = BoostedTrees(self.rounds, self.depth, self.step).fit(labelled, self.encoder, F.col(self.label), weight, known)
        return self

    def _fitted(self) -> BoostedTrees:
        if self.model is None:
            raise RuntimeError("model not fitted")
        return self.model

    def predict(self, rows: DataFrame) -> DataFrame:
        """The rows with ``prediction`` (0/1) and ``probability`` (array of two)."""
        kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("prediction", "probability")]
        name = free_name(rows, "_margin")
        scored = self._fitted().scored(rows, self.encoder, name)
        chance = 1 / (1 + F.exp(-F.col(name)))
        return scored.select(*kept, (F.col(name) > 0).cast("int").alias("prediction"), F.array(1 - chance, chance).alias("probability"))

    def score(self, rows: DataFrame) -> float:
        """Accuracy on labelled rows."""
        right = (F.col("prediction") == F.col(self.label)).cast("int")
        return self.predict(rows).agg(F.avg(right)).first()[0]

    def importances(self, top: int = 20) -> list[tuple[str, float]]:
        """The most important features; categories are shown as column=category, hashed ones as column#bucket."""
        found = self._fitted().importances(self.encoder)
        return sorted(found.items(), key=lambda p: (-p[1], p[0]))[:top]

    def save(self, path: str) -> None:
        """Write what was fitted as one JSON text."""
        model, code = self._fitted(), self.encoder
        facts = {k: getattr(self, k) for k in ("rounds", "depth", "step", "label")}
        facts["encoder"] = {k: getattr(code, k) for k in ("share", "width", "fills", "texts", "numbers", "frequent", "scales")}
        facts["cuts"] = model.cuts
        facts["trees"] = [[list(t.splits.items()), list(t.leaves.items())] for t in model.trees]
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PropagationModel:
        """A saved model, ready to predict."""
        facts = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        model = cls(facts["rounds"], facts["depth"], facts["step"], facts["label"])
        vars(model.encoder).update(facts["encoder"])
        model.model = BoostedTrees(model.rounds, model.depth, model.step)
        model.model.cuts = facts["cuts"]
        model.model.trees = [
            Tree({n: tuple(split) for n, split in splits}, dict(map(tuple, leaves))) for splits, leaves in facts["trees"]
        ]
        return model


def hash_split(
    rows: DataFrame, test_share: float = 0.2, seed: int = 42, keys: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Train and test parts by the MD5 of a row's keys (all columns, if none are named).

    The same row falls on the same side whatever the order and number of partitions, and any
    engine can state the split: the first eight digits are a share of their range. A null key is empty.
    """
    if keys is None:
        key = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    else:
        key = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in keys])
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    test = share < test_share
    return rows.where(~test), rows.where(test)


def confusion_matrix(predictions: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per actual and predicted class."""
    return predictions.groupBy(F.col(label).alias("actual"), F.col("prediction").alias("predicted")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def classification_metrics(predictions: DataFrame, label: str = LABEL) -> DataFrame:
    """Accuracy, macro precision, recall and F1, and the support of both classes."""
    cells = confusion_matrix(predictions, label)
    row = cells.agg(
        *[
            F.coalesce(F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("rows"))), F.lit(0)).alias(f"c{a}{p}")
            for a in (0, 1)
            for p in (0, 1)
        ]
    )

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    scores = {}
    for me, other in ((0, 1), (1, 0)):
        hit, missed, false = F.col(f"c{me}{me}"), F.col(f"c{me}{other}"), F.col(f"c{other}{me}")
        scores[me] = (ratio(hit, hit + false), ratio(hit, hit + missed), ratio(2 * hit, 2 * hit + missed + false))
    total = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    precision, recall, f1 = [(scores[0][i] + scores[1][i]) / 2 for i in range(3)]
    return row.select(
        ((F.col("c00") + F.col("c11")) / total).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1_score"),
        (F.col("c00") + F.col("c01")).alias("no_propagation_support"),
        (F.col("c10") + F.col("c11")).alias("propagation_support"),
    )


def performance(
    rows: DataFrame, model: PropagationModel | None = None, keys: Sequence[str] | None = None
) -> tuple[PropagationModel, DataFrame]:
    """Fit on the train part and report the metrics of both parts; ``keys`` split the rows and are no features."""
    train, test = hash_split(rows, keys=keys)
    fitted = (model or PropagationModel()).fit(train, [c for c in rows.columns if c not in (keys or ())])
    report = [
        classification_metrics(fitted.predict(part)).withColumn("part", F.lit(name))
        for name, part in (("train", train), ("test", test))
    ]
    return fitted, report[0].unionByName(report[1])
