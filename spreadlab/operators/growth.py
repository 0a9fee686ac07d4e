"""Growing observed cascades with the classifier's predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.operators.classifier import PropagationModel
from spreadlab.operators.network import undirected
from spreadlab.operators.pairs import cascade_features, with_features
from spreadlab.session import settle


def grow_cascades(
    cascades: DataFrame,
    nodes: DataFrame,
    network_edges: DataFrame,
    scorer: PropagationModel | Column,
    by_post: DataFrame,
    users: DataFrame,
) -> DataFrame:
    """Authors reached by each cascade of ``cascades(cascade_id, original_author)``.

    Starting from the author of the original, unvisited network neighbours are
    tested pair by pair; accepted ones join and are expanded in the next round.
    All cascades advance together, one round of joins per step; what belongs to a cascade is
    joined to its author's features once, before the rounds. Users are exchanged, never broadcast, as
    every round would send them to the driver. Rows are
    (cascade_id, author_id, source, ground_truth); observed authors have no source.
    ``scorer`` is a fitted model, or a condition over the features of a pair; null does not accept.
    """
    links = settle(undirected(network_edges).distinct(), "links").select(
        F.col("author_id").alias("source"), F.col("other").alias("target")
    )
    users = settle(users, "user_features")
    by_cascade = settle(cascade_features(cascades, by_post, users), "cascade_features")
    users = users.hint("merge")
    observed = nodes.join(cascades, "cascade_id", "left_semi").where(F.col("author_id").isNotNull())
    visited = settle(observed.select("cascade_id", "author_id").distinct(), "visited")
    rows = visited.select("cascade_id", "author_id", F.lit(None).cast("string").alias("source"), F.lit(True).alias("ground_truth"))
    frontier = settle(cascades.select("cascade_id", F.col("original_author").alias("source"), "original_author"), "frontier")
    while True:
        near = frontier.join(links, "source").join(
            visited.withColumnRenamed("author_id", "target"), ["cascade_id", "target"], "left_anti"
        )
        seen = with_features(near.distinct(), by_cascade, users)
        accepted = seen.where(scorer) if isinstance(scorer, Column) else scorer.predict(seen).where(F.col("prediction") == 1)
        joined = (
            accepted
            .groupBy("cascade_id", "target")
            .agg(F.min("source").alias("source"), F.min("original_author").alias("original_author"))
        )
        joined = settle(joined, "joined")
        if joined.isEmpty():
            return rows
        added = joined.select("cascade_id", F.col("target").alias("author_id"))
        visited = visited.unionByName(added)
        rows = rows.unionByName(
            joined.select("cascade_id", F.col("target").alias("author_id"), "source", F.lit(False).alias("ground_truth"))
        )
        frontier = joined.select("cascade_id", F.col("target").alias("source"), "original_author")


def grow_cascade(cascade_id: str, nodes: DataFrame, *args, **kwargs) -> DataFrame:
    """Growth of one cascade; an error when it has no node."""
    root = nodes.where((F.col("cascade_id") == cascade_id) & (F.col("post_id") == cascade_id))
    cascades = root.select("cascade_id", F.col("author_id").alias("original_author"))
    if cascades.isEmpty():
        raise LookupError(f"cascade {cascade_id} not found")
    return grow_cascades(cascades, nodes, *args, **kwargs)
