"""Marking authors found in lists of suspects and politicians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import handle_of

# The network whose suspects count, and the entry for "has no account".
NETWORK = "Twitter"
NO_ACCOUNT = "No en té"
UNKNOWN_PARTY = "Desconocido"


def suspect_handles(suspects: DataFrame) -> DataFrame:
    """Handles of the listed suspects of the network, once each."""
    return suspects.where(F.col("network") == NETWORK).select(handle_of(F.col("link")).alias("handle")).distinct()


def party_handles(parties: DataFrame) -> DataFrame:
    """Handle and trimmed party of the listed politicians, one row per handle; a missing party is named as unknown."""
    listed = parties.where(F.col("link") != NO_ACCOUNT)
    return listed.groupBy(handle_of(F.col("link")).alias("handle")).agg(F.coalesce(F.min(F.trim("party")), F.lit(UNKNOWN_PARTY)).alias("party"))


def annotate_actors(posts: DataFrame, suspects: DataFrame, parties: DataFrame) -> DataFrame:
    """Set each author's suspect flag and party from the lists.

    The lists are merged first, so the posts are joined once.
    """
    listed = (
        suspect_handles(suspects)
        .withColumn("suspect", F.lit(True))
        .unionByName(party_handles(parties), allowMissingColumns=True)
        .groupBy("handle")
        .agg(F.bool_or("suspect").alias("suspect"), F.max("party").alias("party"))
    )
    marked = posts.join(listed, posts["author.username"] == listed["handle"], "left")
    actor = F.struct(F.coalesce("suspect", F.lit(False)).alias("is_usual_suspect"), F.col("party").alias("party"))
    return marked.withColumn("author", F.col("author").withField("actor", actor)).select(*posts.columns)
