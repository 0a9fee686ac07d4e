"""Posting activity: histograms by actor class, hashtags, cascade starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.functions.columns import SERIES, actor_class, time_bin, week_ending_sunday
from spreadlab.operators.posts import flat, originals, references, window


def _series(posts: DataFrame, unit: str, size: int) -> DataFrame:
    rows = flat(posts)
    label = actor_class(F.col("is_usual_suspect"), F.col("party"), labels=SERIES, strict=True)
    return rows.select(
        time_bin(F.col("created_at"), unit, size).alias("time"), label.alias("series"), "username"
    ).where(F.col("series").isNotNull())


def post_histogram(
    posts: DataFrame, hashtags=(), start=None, end=None, unit: str = "day", size: int = 1
) -> DataFrame:
    """Posts per time bin, one column per actor class, zero where a class is silent."""
    rows = _series(window(posts, start, end, hashtags, mode="activity"), unit, size)
    return rows.groupBy("time").pivot("series", list(SERIES)).count().na.fill(0)


def author_histogram(
    posts: DataFrame, hashtags=(), start=None, end=None, unit: str = "day", size: int = 1
) -> DataFrame:
    """Distinct posting usernames per time bin and actor class."""
    rows = _series(window(posts, start, end, hashtags, mode="activity"), unit, size)
    # Two plain aggregations instead of a distinct set per bin in one buffer.
    # A missing name still counts as one distinct value.
    once = rows.groupBy("time", "series", "username").agg(F.lit(1).alias("one"))
    return once.groupBy("time").pivot("series", list(SERIES)).agg(F.sum("one")).na.fill(0)


def hashtag_counts(posts: DataFrame, author_id=None, start=None, end=None, top: int | None = None) -> DataFrame:
    """Uses of each hashtag, most used first when ``top`` is given."""
    chosen = window(posts, start, end, mode="hashtags", author_id=author_id)
    tags = chosen.select(F.explode("entities.hashtags.tag").alias("hashtag"))
    counts = tags.groupBy("hashtag").count()
    if top is None:
        return counts
    return counts.orderBy(F.desc("count"), "hashtag").limit(top)


def hashtag_weights(counts: DataFrame) -> DataFrame:
    """Counts relative to the largest one."""
    largest = counts.agg(F.max("count")).scalar()
    return counts.select("hashtag", (F.col("count") / largest).alias("weight"))


def top_profiles(posts: DataFrame, start=None, end=None, n: int = 10) -> DataFrame:
    """Usernames with the most posts in a span."""
    rows = flat(window(posts, start, end, mode="hashtags"))
    return rows.groupBy("username").count().orderBy(F.desc("count"), "username").limit(n)


def top_hashtags(posts: DataFrame, start=None, end=None, n: int = 10) -> DataFrame:
    return hashtag_counts(posts, start=start, end=end, top=n)


def cascade_roots(posts: DataFrame) -> DataFrame:
    """Originals that some post references, once per id."""
    fields = ["created_at", "author_id", "username"]
    heads = originals(posts).select(
        F.col("id").alias("cascade_id"),
        "created_at",
        F.col("author.id").alias("author_id"),
        F.col("author.username").alias("username"),
    )
    # Reduced to one row per id in every task before it is exchanged.
    referenced = references(posts, ["ref_id"]).select(F.col("ref_id").alias("cascade_id")).distinct()
    firsts = heads.groupBy("cascade_id").agg(F.min(F.struct(*fields)).alias("first"))
    return firsts.join(referenced, "cascade_id", "left_semi").select(
        "cascade_id", *[F.col(f"first.{f}").alias(f) for f in fields]
    )


def cascade_count_over_time(posts: DataFrame, unit: str = "day") -> DataFrame:
    """Started cascades per day, or per week named by the Sunday it ends on; empty periods between count 0."""
    if unit not in ("day", "week"):
        raise ValueError(f"unknown unit {unit}")
    day = F.to_date("created_at")
    period = day if unit == "day" else week_ending_sunday(day)
    counted = cascade_roots(posts).groupBy(period.alias("day")).agg(F.count(F.lit(1)).alias("started")).where(F.col("day").isNotNull())
    # The calendar is bounded by the dataset's span in days, so one small row holds it.
    span = counted.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where(F.col("lo").isNotNull())
    step = F.expr("INTERVAL 1 DAY" if unit == "day" else "INTERVAL 7 DAYS")
    calendar = span.select(F.explode(F.sequence("lo", "hi", step)).alias("day"))
    return calendar.join(counted, "day", "left").select(
        F.col("day").cast("timestamp").alias("time"), F.coalesce("started", F.lit(0)).alias("cascades")
    )


def sample_per_period(posts: DataFrame, unit: str = "day", quantity: int = 10, seed: int = 42) -> DataFrame:
    """Up to ``quantity`` posts of every period, those with the smallest md5 of the id and ``seed``.

    The rank limit is applied inside each task before the shuffle, so a period
    sends at most ``quantity`` rows per task.
    """
    chosen = posts.withColumn("period", time_bin(F.col("created_at"), unit))
    by_hash = Window.partitionBy("period").orderBy(F.md5(F.concat("id", F.lit(str(seed)))), "id")
    return chosen.withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= quantity).drop("_rank")
