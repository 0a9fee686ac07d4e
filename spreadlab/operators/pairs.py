"""Pairs of authors between whom a cascade did or did not spread, with their features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.operators.activity import cascade_roots
from spreadlab.operators.network import undirected
from spreadlab.operators.posts import flat
from spreadlab.session import settle


# Post features in order; the first four come from the post's counters.
POST_COUNTERS = ("num_replies", "num_retweets", "num_quotes", "num_likes")
TEXT_FEATURES = (
    "language",
    "possibly_sensitive",
    "retweet_count",
    "reply_count",
    "like_count",
    "sentences",
    "POS_entities_1d",
    "POS_tags_1d",
    "TFIDF_1d",
    "No ironico",
    "Ironia",
    "Odio",
    "Dirigido",
    "Agresividad",
    "others",
    "Diversion",
    "Tristeza",
    "Enfado",
    "Sorpresa",
    "Disgusto",
    "Miedo",
    "Negativo",
    "Neutro",
    "Positivo",
    "REAL",
    "FAKE",
    "Toxico",
    "Muy toxico",
    "fakeness",
    "fakeness_probabilities",
)
ROLES = {"source": "_prev", "target": "_curr", "original_author": "_original"}
PROFILE_KEYS = ("user_id", "twitter_id", "anonymizedName", "user_summary")


def eligible_cascades(posts: DataFrame, profiles: DataFrame, text_scores: DataFrame, require_scores: bool = True) -> DataFrame:
    """Referenced originals by profiled authors, those with text scores unless ``require_scores`` is off."""
    roots = cascade_roots(posts)
    people = profiles.select(F.col("user_id").alias("author_id"))
    cascades = settle(
        roots.join(people, "author_id", "left_semi").select("cascade_id", F.col("author_id").alias("original_author")),
        "eligible",
    )
    if cascades.isEmpty():
        raise LookupError("no cascades by profiled authors found")
    if not require_scores:
        return cascades
    return cascades.join(text_scores.select(F.col("id_str").alias("cascade_id")), "cascade_id", "left_semi")


def positive_pairs(cascades: DataFrame, nodes: DataFrame, tree_edges: DataFrame, num_samples: int | None = None) -> DataFrame:
    """Every tree edge of the cascades in both directions, as authors, once per pair of posts.

    ``num_samples`` draws half that many pairs by hash; by default all are kept.
    """
    links = tree_edges.where(F.col("parent") != F.col("child"))
    both = links.select("cascade_id", F.col("parent").alias("a"), F.col("child").alias("b")).unionByName(
        links.select("cascade_id", F.col("child").alias("a"), F.col("parent").alias("b"))
    ).distinct()
    chosen = both.join(cascades, "cascade_id")
    who = nodes.select("cascade_id", "post_id", "author_id")
    pairs = chosen.join(
        who.select("cascade_id", F.col("post_id").alias("a"), F.col("author_id").alias("source")), ["cascade_id", "a"]
    ).join(who.select("cascade_id", F.col("post_id").alias("b"), F.col("author_id").alias("target")), ["cascade_id", "b"])
    if num_samples is not None:
        pairs = pairs.orderBy(F.xxhash64("cascade_id", "a", "b"), "cascade_id", "a", "b").limit(num_samples // 2)
    return pairs.select("source", "target", "cascade_id", "original_author")


def negative_pairs(positives: DataFrame, network_edges: DataFrame, num_samples: int | None = None) -> DataFrame:
    """Network neighbours that a source with several positive pairs did not spread to.

    Each source is tied to its first cascade by id.
    """
    sources = positives.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("cascade_id", "original_author")).alias("first")
    )
    sources = sources.where(F.col("n") > 1).select("source", "first.cascade_id", "first.original_author")
    near = undirected(network_edges).select(F.col("author_id").alias("source"), F.col("other").alias("target"))
    near = near.join(sources.select("source"), "source", "left_semi").distinct()
    missed = near.join(positives.select("source", "target").distinct(), ["source", "target"], "left_anti")
    pairs = missed.join(sources, "source").select("source", "target", "cascade_id", "original_author")
    if num_samples is not None:
        pairs = pairs.orderBy(F.xxhash64("source", "target"), "source", "target").limit(num_samples // 2)
    return pairs


def post_features(posts: DataFrame, text_scores: DataFrame) -> DataFrame:
    """Counters and text scores per post."""
    counters = flat(posts).select(
        F.col("id").alias("cascade_id"),
        F.col("reply_count").alias("num_replies"),
        F.col("retweet_count").alias("num_retweets"),
        F.col("quote_count").alias("num_quotes"),
        F.col("like_count").alias("num_likes"),
    )
    present = [c for c in TEXT_FEATURES if c in text_scores.columns]
    scores = text_scores.groupBy(F.col("id_str").alias("cascade_id")).agg(
        F.min(F.struct(*[F.col(f"`{c}`") for c in present])).alias("s")
    )
    return counters.join(scores.select("cascade_id", "s.*"), "cascade_id", "left")


def user_features(posts: DataFrame, profiles: DataFrame, standing: DataFrame) -> DataFrame:
    """Flags, profile features and standing per posting author."""
    flags = flat(posts).groupBy("author_id").agg(F.max("is_usual_suspect").alias("is_usual_suspect"))
    features = [c for c in profiles.columns if c not in PROFILE_KEYS]
    known = profiles.groupBy(F.col("user_id").alias("author_id")).agg(
        F.min(F.struct(*[F.col(f"`{c}`") for c in features])).alias("p")
    )
    known = known.select("author_id", "p.*")
    scores = standing.select(
        "author_id",
        "legitimacy",
        F.col("average_reputation").alias("reputation"),
        F.col("average_status").alias("status"),
    )
    return flags.where(F.col("author_id").isNotNull()).join(known, "author_id", "left").join(scores, "author_id", "left")


def feature_names(users: DataFrame, texts: Sequence[str] = TEXT_FEATURES) -> list[str]:
    """Ordered feature list: post features, then the user columns for each of the three roles."""
    columns = [c for c in users.columns if c != "author_id"]
    return [*POST_COUNTERS, *texts, *[f"{c}{suffix}" for suffix in ROLES.values() for c in columns]]


def _of_role(users: DataFrame, key: str) -> DataFrame:
    """The users' features under the names of one role, keyed by its column."""
    names = [c for c in users.columns if c != "author_id"]
    return users.select(F.col("author_id").alias(key), *[F.col(f"`{c}`").alias(f"{c}{ROLES[key]}") for c in names])


def cascade_features(heads: DataFrame, by_post: DataFrame, users: DataFrame) -> DataFrame:
    """Features of the post and its author, per cascade of ``heads(cascade_id, original_author)``."""
    heads = heads.select("cascade_id", "original_author").distinct()
    # Only the posts of these cascades go into the joins that make up their features.
    chosen = by_post.join(heads, "cascade_id", "left_semi")
    return heads.join(chosen, "cascade_id").join(_of_role(users, "original_author"), "original_author")


def with_features(pairs: DataFrame, by_cascade: DataFrame, users: DataFrame) -> DataFrame:
    """Join ``cascade_features`` and the features of both users of every pair."""
    out = pairs.join(by_cascade, ["cascade_id", "original_author"])
    for key in ("source", "target"):
        out = out.join(_of_role(users, key), key)
    return out


def pair_features(pairs: DataFrame, by_post: DataFrame, users: DataFrame) -> DataFrame:
    """Join the features of the post and of the three users of every pair.

    What belongs to a cascade is put together once per cascade, and joined last, so that rows are wide in as few
    exchanges as can be.
    """
    pairs = settle(pairs, "pairs")
    out = pairs
    for key in ("source", "target"):
        out = out.join(_of_role(users, key), key)
    out = out.join(cascade_features(pairs, by_post, users), ["cascade_id", "original_author"])
    keys = [*reversed(ROLES), "cascade_id"]
    known = [*pairs.columns, *by_post.columns, *[c for key in ROLES for c in _of_role(users, key).columns]]
    return out.select(*keys, *[F.col(f"`{c}`") for c in dict.fromkeys(known) if c not in keys])


def with_all_features(rows: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the listed features in order, null where a column is missing."""
    have = set(rows.columns)
    return rows.select(
        *keep, *[F.col(f"`{n}`") if n in have else F.lit(None).cast("double").alias(n) for n in names]
    )


def propagation_dataset(
    positives: DataFrame, negatives: DataFrame, by_post: DataFrame, users: DataFrame, with_keys: bool = False
) -> DataFrame:
    """Labelled rows: 1 for pairs of the cascades' trees, 0 for pairs passed over."""
    users = settle(users, "users")
    texts = [c for c in by_post.columns if c in TEXT_FEATURES]
    names = feature_names(users, texts)
    rows = positives.withColumn("propagated", F.lit(1)).unionByName(negatives.withColumn("propagated", F.lit(0)))
    keys = [*ROLES, "cascade_id"] if with_keys else []
    return with_all_features(pair_features(rows, by_post, users), [*names, "propagated"], keys)
