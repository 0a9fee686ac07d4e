"""Flat views over the nested posts table, post filters and point lookups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from spreadlab.functions.columns import CLASSES, actor_class

REFERENCE_TYPES = ("retweeted", "quoted", "replied_to")


# Columns of ``references`` and where a reference keeps them.
REFERENCE_FIELDS = {
    "ref_id": "referenced_tweets.id",
    "ref_type": "referenced_tweets.type",
    "ref_author_id": "referenced_tweets.author.id",
    "ref_username": "referenced_tweets.author.username",
    "ref_created_at": "referenced_tweets.created_at",
}


def is_original() -> Column:
    """No reference list. Asks for one field of the list, so a scan reads no more than that."""
    return F.col("referenced_tweets.id").isNull()


def flat(posts: DataFrame) -> DataFrame:
    """One row per post with the author's fields, counters and tags as plain columns."""
    return posts.select(
        "id",
        "text",
        "created_at",
        F.col("author.id").alias("author_id"),
        F.col("author.username").alias("username"),
        F.col("author.actor.is_usual_suspect").alias("is_usual_suspect"),
        F.col("author.actor.party").alias("party"),
        F.col("public_metrics.retweet_count").alias("retweet_count"),
        F.col("public_metrics.reply_count").alias("reply_count"),
        F.col("public_metrics.like_count").alias("like_count"),
        F.col("public_metrics.quote_count").alias("quote_count"),
        F.col("entities.hashtags.tag").alias("hashtags"),
        is_original().alias("is_original"),
    )


def references(posts: DataFrame, fields: Sequence[str] = tuple(REFERENCE_FIELDS)) -> DataFrame:
    """One row per reference a post makes to another post.

    Only the listed fields are taken from the reference list before it is
    expanded: expanding the whole list would read the embedded texts as well.
    """
    wanted = F.arrays_zip(*[F.col(REFERENCE_FIELDS[f]).alias(f) for f in fields])
    return posts.select(
        F.col("id").alias("post_id"),
        F.col("author.id").alias("author_id"),
        F.col("author.username").alias("username"),
        "created_at",
        F.explode(wanted).alias("ref"),
    ).select("post_id", "author_id", "username", "created_at", *[F.col(f"ref.{f}").alias(f) for f in fields])


def originals(posts: DataFrame) -> DataFrame:
    """Posts without a reference list. An empty list still marks a referencing post."""
    return posts.where(is_original())


def between_authors(refs: DataFrame, types: Sequence[str] = REFERENCE_TYPES) -> DataFrame:
    """References of the given types to a known other author."""
    return refs.where(
        F.col("ref_type").isin(*types)
        & F.col("ref_author_id").isNotNull()
        & ~F.col("author_id").eqNullSafe(F.col("ref_author_id"))
    )


def window(
    posts: DataFrame,
    start: date | datetime | str | None = None,
    end: date | datetime | str | None = None,
    hashtags: Iterable[str] = (),
    mode: str = "network",
    author_id: str | None = None,
    end_inclusive_day: bool = False,
) -> DataFrame:
    """Posts in a time span with given hashtags, under the rules of one consumer.

    network: end excluded, any of the tags. activity: end instant included, all
    of the tags. hashtags: end instant included, optional author. board: end day
    included, any of the tags found in the text column ``hashtags``.
    """
    if mode not in ("network", "activity", "hashtags", "board"):
        raise ValueError(f"unknown window mode {mode!r}")
    moment = F.col("created_at")
    if start is not None:
        posts = posts.where(moment >= F.lit(start).cast("timestamp"))
    if end is not None:
        limit = F.lit(end).cast("timestamp")
        if mode == "board" or end_inclusive_day:
            posts = posts.where(moment < limit + F.expr("INTERVAL 1 DAY"))
        elif mode == "network":
            posts = posts.where(moment < limit)
        else:
            posts = posts.where(moment <= limit)
    if author_id is not None:
        posts = posts.where(F.col("author.id") == author_id)
    tags = list(hashtags)
    if tags and mode == "board":
        posts = posts.where(F.arrays_overlap("hashtags", F.array(*map(F.lit, tags))))
    elif tags and mode == "activity":
        for tag in tags:
            posts = posts.where(F.array_contains("entities.hashtags.tag", tag))
    elif tags:
        posts = posts.where(F.arrays_overlap("entities.hashtags.tag", F.array(*map(F.lit, tags))))
    return posts


def date_range(posts: DataFrame) -> DataFrame:
    """First and last day of the dataset."""
    return posts.agg(
        F.to_date(F.min("created_at")).alias("first_day"), F.to_date(F.max("created_at")).alias("last_day")
    )


def _day(value: date | datetime | str | None) -> date | None:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return value.date() if isinstance(value, datetime) else value


def normalise_bounds(posts: DataFrame, start=None, end=None) -> tuple[date | None, date | None]:
    """Drop a bound that equals the first or last day, so stored results apply."""
    start, end = _day(start), _day(end)
    if start is None and end is None:
        return None, None
    first, last = date_range(posts).first()
    return (None if start == first else start), (None if end == last else end)


def of_class(posts: DataFrame, name: str) -> DataFrame:
    """Posts whose author is in one actor class; missing flags match no class."""
    if name not in CLASSES:
        raise ValueError(f"unknown actor class {name!r}, expected one of {CLASSES}")
    author = F.col("author.actor.is_usual_suspect"), F.col("author.actor.party")
    return posts.where(actor_class(*author, strict=True) == name)


def engaging_originals(posts: DataFrame, name: str, above: int = 100) -> DataFrame:
    """Originals of one class with more than ``above`` retweets."""
    return of_class(originals(posts), name).where(F.col("public_metrics.retweet_count") > above)


def class_counts(posts: DataFrame) -> DataFrame:
    """Posts and distinct authors per actor class."""
    rows = flat(posts)
    return rows.groupBy(actor_class(F.col("is_usual_suspect"), F.col("party")).alias("user_type")).agg(
        F.count(F.lit(1)).alias("posts"), F.count_distinct("author_id").alias("authors")
    )


def one(df: DataFrame, key: str, value: str, what: str) -> Row:
    """The first row with ``key`` equal to ``value``; an error when there is none."""
    row = df.where(F.col(key) == value).limit(1).first()
    if row is None:
        raise LookupError(f"{what} {value} not found")
    return row


def get_post(posts: DataFrame, post_id: str) -> Row:
    return one(posts, "id", post_id, "post")


def author_id_of(posts: DataFrame, username: str) -> str:
    return one(flat(posts).select("username", "author_id"), "username", username, "user")["author_id"]


def username_of(posts: DataFrame, author_id: str) -> str:
    return one(flat(posts).select("author_id", "username"), "author_id", author_id, "author")["username"]


def fact_check_of(fact_checks: DataFrame, post_id: str) -> Row:
    return one(fact_checks, "tweet_id", post_id, "fact check of post")


def profile_of(profiles: DataFrame, user_id: str) -> Row:
    return one(profiles, "twitter_id", user_id, "profile of user")


def has_row(df: DataFrame, key: str, value: str) -> bool:
    return not df.where(F.col(key) == value).limit(1).isEmpty()


def has_profile(profiles: DataFrame, user_id: str) -> bool:
    return has_row(profiles, "twitter_id", user_id)


def has_fact_check(fact_checks: DataFrame, post_id: str) -> bool:
    return has_row(fact_checks, "tweet_id", post_id)


def has_metrics(curves: DataFrame, cascade_id: str) -> bool:
    return has_row(curves, "cascade_id", cascade_id)
