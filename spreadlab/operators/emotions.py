"""Averages of emotion scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import translated

# The averaged score columns and their English labels.
EMOTIONS = {
    "Miedo": "Fear",
    "Disgusto": "Disgust",
    "Sorpresa": "Surprise",
    "Odio": "Hate",
    "Diversion": "Fun",
    "Agresividad": "Aggressiveness",
    "Dirigido": "Targeted",
    "Enfado": "Anger",
    "Tristeza": "Sadness",
    "Toxico": "Toxic",
    "Ironia": "Irony",
}


def average_emotion(scores: DataFrame) -> DataFrame:
    """Mean of every emotion over all scored posts, the strongest first."""
    means = scores.agg(*[F.avg(c).alias(c) for c in EMOTIONS])
    return means.unpivot([], list(EMOTIONS), "name", "level").select(
        translated(F.col("name"), EMOTIONS).alias("emotion"), "level"
    ).orderBy(F.desc("level"), "emotion")


def emotion_by_hour(scores: DataFrame, start=None, end=None) -> DataFrame:
    """Mean of every emotion per hour of the day, bounds included."""
    rows = scores.withColumn("moment", F.to_timestamp("date"))
    if start is not None:
        rows = rows.where(F.col("moment") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("moment") <= F.lit(end).cast("timestamp"))
    return rows.groupBy(F.hour("moment").alias("hour")).agg(*[F.avg(c).alias(n) for c, n in EMOTIONS.items()]).orderBy("hour")
