"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.session import settle


def _mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = _mirrored(pairs)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (
        moved.where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
    )


def _fingerprint(pairs: DataFrame):
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _rounds(pairs: DataFrame) -> DataFrame:
    """(node, component) of ``pairs(u, v)`` of different nodes; the component is its smallest node."""
    current = settle(pairs.distinct(), "stars")
    mark = _fingerprint(current)
    while True:
        current = settle(_small_star(_large_star(current).distinct()).distinct(), "stars")
        now = _fingerprint(current)
        if now == mark:
            break
        mark = now
    centres = current.select(F.col("v").alias("u"), "v").distinct()
    return current.unionByName(centres).select(F.col("u").alias("node"), F.col("v").alias("component"))


def connected(pairs: DataFrame) -> DataFrame:
    """Component label (its smallest node) for every node of ``pairs(u, v)``, direction ignored.

    Nodes may be of any ordered type. The number of rounds grows with the
    logarithm of the component size; each round is written to the shared folder.
    Nodes that hold strings go through the rounds as numbers, which are shorter and need no sorting.
    """
    pairs = pairs.where(F.col("u") != F.col("v")).select("u", "v")
    if "string" not in pairs.schema["u"].dataType.simpleString():
        return _rounds(pairs)
    pairs = settle(pairs.distinct(), "links")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    numbers = settle(nodes.withColumn("number", F.monotonically_increasing_id()), "numbers")
    numbered = pairs
    for end in ("u", "v"):
        numbered = numbered.join(numbers.select(F.col("node").alias(end), F.col("number").alias(f"{end}_number")), end)
    parts = _rounds(numbered.select(F.col("u_number").alias("u"), F.col("v_number").alias("v")))
    named = settle(parts.withColumnRenamed("node", "number").join(numbers, "number").select("node", F.col("component").alias("part")), "parts")
    least = named.groupBy("part").agg(F.min("node").alias("component"))
    return named.join(least, "part").select("node", "component")
