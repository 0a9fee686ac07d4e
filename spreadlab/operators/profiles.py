"""User profiles: cards, comparison with reference groups, and profile features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import translated, wrapped
from spreadlab.operators.posts import flat, is_original
from spreadlab.operators.prefix import quantiles, running
from spreadlab.session import settle
from spreadlab.sources.tables import GROUPS

# Labels of genders, and English names of Catalan feature labels.
GENDERS = {"male": "Home", "female": "Dona", "organization": "Organització"}
FEATURE_NAMES = {
    "alegría*": "Joy*",
    "confiança*": "Trust*",
    "por*": "Fear*",
    "sorpresa*": "Surprise*",
    "tristesa": "Sadness",
    "fàstic": "Disgust",
    "ira*": "Anger*",
    "anticipació*": "Anticipation*",
    "positiva*": "Positive*",
    "negativa*": "Negative*",
    "neutral*": "Neutral*",
    "discurs d'odi": "Hate Speech",
    "proporció de tweets publicats en días laborables (Dill-Div)": "Proportion of tweets posted on weekdays (Monday to Friday)",
    "proporció de tweets publicats en cap de setmana (Diss i Diu)": "Proportion of tweets posted on weekends (Saturday and Sunday)",
    "proporció de tweets publicats a la nit": "Proportion of tweets posted at night",
    "proporció de tweets publicats durant el día": "Proportion of tweets posted during the day",
}
# Panel of a feature by its place in its category.
PANELS = {
    "interacciones": {0: 1, 1: 1, 3: 1, 2: 2, 4: 2, 5: 2, 6: 2},
    "comportamiento": {0: 1, 1: 1, 2: 2, 3: 2},
}


def profile_cards(profiles: DataFrame) -> DataFrame:
    """What a profile card shows: name, wrapped summary, counts, age, gender and verification."""
    return profiles.select(
        "twitter_id",
        F.col("anonymizedName").alias("name"),
        wrapped(F.col("user_summary")).alias("description"),
        F.col("followers_count").cast("bigint").cast("string").alias("followers"),
        F.col("friends_count").cast("bigint").cast("string").alias("followed"),
        F.col("age_demo").alias("age"),
        translated(F.col("gender_demo"), GENDERS).alias("gender"),
        F.when(F.col("is_verified"), "Sí").otherwise("No").alias("verified"),
    )


def feature_values(profiles: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Profile features in long form (key, feature, value)."""
    wide = profiles.select(key, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    return wide.unpivot([key], list(features), "feature", "value")


def profile_comparison(profiles: DataFrame, catalogue: DataFrame, medians: DataFrame, category: str) -> DataFrame:
    """Features of a category for every profiled user beside the medians of the three groups.

    ``panel`` splits the features of a category that is shown in two parts.
    """
    listed = catalogue.where(F.col("category") == category)
    by_feature = medians.groupBy("feature").pivot("group", list(GROUPS)).agg(F.first("median"))
    names = listed.select(F.col("feature_name").alias("feature"), "display_name", "rank").join(
        by_feature, "feature", "left"
    )
    present = [c for c in profiles.columns if c not in ("user_id", "twitter_id")]
    numeric = [c for c in present if dict(profiles.dtypes)[c] in ("double", "float", "int", "bigint", "boolean")]
    # The features of a category are a small fixed part of a catalogue of columns.
    wanted = {r["feature_name"] for r in listed.select("feature_name").distinct().collect()}
    values = feature_values(profiles, "twitter_id", [c for c in numeric if c in wanted])
    panel = F.lit(1)
    for rank, number in PANELS.get(category, {}).items():
        panel = F.when(F.col("rank") == rank, number).otherwise(panel)
    return values.join(names, "feature").select(
        "twitter_id",
        "feature",
        translated(F.col("display_name"), FEATURE_NAMES).alias("display_name"),
        "rank",
        panel.alias("panel"),
        F.col("value").alias("user"),
        *GROUPS,
    )


def group_share(profiles: DataFrame, by: str, group: str | None = None) -> DataFrame:
    """Percentage of profiles per value of ``by``, within each group when given."""
    keys = [group] if group else []
    counts = profiles.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = counts.join(totals, keys) if keys else counts.withColumn("total", totals.select("total").scalar())
    return joined.select(*keys, by, (F.col("n") / F.col("total") * 100).alias("share"))


def group_medians(profiles: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Median of every feature per group, in long form."""
    wide = profiles.select(group, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    long = wide.unpivot([group], list(features), "feature", "value")
    return quantiles(long, [group, "feature"], "value", {"median": 0.5}).select(group, "feature", "median")


def behaviour_features(posts: DataFrame, sleep_from: int = 0, sleep_until: int = 8) -> DataFrame:
    """Per author: shares of posts on weekdays, weekends, asleep and awake; median gap in seconds.

    Hours from ``sleep_from`` up to ``sleep_until`` count as asleep.
    """
    rows = flat(posts).select("author_id", "id", "created_at").where(F.col("created_at").isNotNull())
    weekend = F.dayofweek("created_at").isin(1, 7)
    hour = F.hour("created_at")
    asleep = (hour >= sleep_from) & (hour < sleep_until)
    if sleep_from > sleep_until:
        asleep = (hour >= sleep_from) | (hour < sleep_until)
    shares = rows.groupBy("author_id").agg(
        F.avg((~weekend).cast("int")).alias("week_days_count_ratio_behav"),
        F.avg(weekend.cast("int")).alias("weekend_days_count_ratio_behav"),
        F.avg(asleep.cast("int")).alias("tweets_sleep_time_ratio_behav"),
        F.avg((~asleep).cast("int")).alias("tweets_awake_time_ratio_behav"),
    )
    gaps = running(rows, ["author_id"], ["created_at", "id"], previous={"before": "created_at"})
    micros = (F.unix_micros("created_at") - F.unix_micros("before")) / 1e6
    gaps = gaps.where(F.col("before").isNotNull()).select("author_id", micros.alias("gap"))
    median = quantiles(gaps, ["author_id"], "gap", {"median_time_betweet_tweets_behav": 0.5}).drop("n")
    return shares.join(median, "author_id", "left")


def social_features(posts: DataFrame) -> DataFrame:
    """Per author: mean retweets and likes received and mentions made; shares of post types."""
    kinds = F.col("referenced_tweets.type")

    def share(name: str):
        return F.avg(F.coalesce(F.array_contains(kinds, name), F.lit(False)).cast("int"))

    return posts.groupBy(F.col("author.id").alias("author_id")).agg(
        F.avg("public_metrics.retweet_count").alias("retweets_count_social"),
        F.avg("public_metrics.like_count").alias("favs_count_social"),
        F.avg(F.regexp_count("text", F.lit(r"(?U)@\w+"))).alias("mentions_count_social"),
        share("quoted").alias("ratio_quoted_tweet_types"),
        share("retweeted").alias("ratio_retweets_tweet_types"),
        share("replied_to").alias("ratio_replies_tweet_types"),
        F.avg(is_original().cast("int")).alias("ratio_original_tweet_types"),
    )


def lexicon_scores(texts: DataFrame, lexicon: DataFrame, user: str = "user_id", text: str = "text") -> DataFrame:
    """Share of a user's words in each category of a lexicon (word, is_prefix, category).

    Rules are matched once per distinct word of the whole corpus: exact words by
    an equi join, prefixes by an equi join on the word's own beginnings up to the
    longest rule. The word counts per user are formed before any join.
    """
    pattern = r"[\p{L}\p{N}_]+"
    words = texts.select(user, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word"))
    counts = settle(words.groupBy(user, "word").agg(F.count(F.lit(1)).alias("n")), "words")
    vocabulary = counts.select("word").distinct()
    longest = lexicon.where("is_prefix").agg(F.max(F.length("word"))).first()[0] or 0
    exact = vocabulary.join(lexicon.where(~F.col("is_prefix")), "word").select("word", "category")
    starts = F.transform(
        F.sequence(F.lit(1), F.least(F.length("word"), F.lit(max(longest, 1)))), lambda n: F.substring("word", F.lit(1), n)
    )
    rules = lexicon.where("is_prefix").select(F.col("word").alias("start"), "category")
    prefixed = vocabulary.select("word", F.explode(starts).alias("start")).join(rules, "start").select("word", "category")
    matches = exact.unionByName(prefixed).distinct()
    totals = counts.groupBy(user).agg(F.sum("n").alias("total"))
    hits = counts.join(matches, "word").groupBy(user, "category").agg(F.sum("n").alias("hits"))
    return hits.join(totals, user).select(user, "category", (F.col("hits") / F.col("total")).alias("score"))
