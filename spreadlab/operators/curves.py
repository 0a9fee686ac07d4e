"""Growth of every cascade over time: size, depth, breadth and structural virality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.operators.cascades import Tree
from spreadlab.operators.distances import KEY, distances_by_walks, distances_in_tangles, shared_in_long_trees, spanning_positions
from spreadlab.operators.prefix import GROUP_ROWS, running
from spreadlab.session import settle


def _breadth(placed: DataFrame, group_rows: int, at_most: int) -> DataFrame:
    """Posts at a depth so far, at each time a post of that depth arrives."""
    arrivals = placed.groupBy("cascade_id", "depth", "created_at").agg(F.count(F.lit(1)).alias("n"))
    return running(arrivals, ["cascade_id", "depth"], ["created_at"], sums={"wide": "n"}, group_rows=group_rows, at_most=at_most)


def _shared_in_trees(placed: DataFrame, group_rows: int, at_most: int) -> DataFrame:
    """Growth of the sum, over tree edges, of the squared number of posts below the edge.

    An edge with r of t posts below it lies on r * (t - r) of the paths between
    two posts. Added over all edges, the path lengths sum to
    t * (sum of depths) - (sum of r squared), which needs no pair of posts.
    """
    below = placed.where(F.col("depth") > 0).select(
        *KEY, F.explode(F.concat("path", F.array("post_id"))).alias("edge")
    )
    arrivals = below.groupBy("cascade_id", "edge", "created_at").agg(F.count(F.lit(1)).alias("n"))
    counted = running(
        arrivals, ["cascade_id", "edge"], ["created_at"], sums={"r": "n"}, group_rows=group_rows, at_most=at_most
    )
    now, was = F.col("r").cast("double"), (F.col("r") - F.col("n")).cast("double")
    return counted.groupBy(*KEY).agg(F.sum(now * now - was * was).alias("shared"))


def _kinds(positions: DataFrame, tangled: DataFrame | None, left_out: DataFrame | None) -> DataFrame:
    """(cascade_id, kind) of the cascades that are no shallow trees: 'long', 'tangled' or 'walked'."""
    unplaced = positions.where(F.col("path").isNull())
    if tangled is not None:
        unplaced = unplaced.join(tangled, "cascade_id", "left_anti")
    lost = F.bool_or(F.col("depth") < 0)
    kinds = unplaced.groupBy("cascade_id").agg(F.when(lost, "walked").otherwise("long").alias("kind"))
    if tangled is not None:
        left = left_out.select("cascade_id", F.lit("walked").alias("kind")).distinct()
        kinds = kinds.unionByName(left).unionByName(tangled.join(left, "cascade_id", "left_anti").withColumn("kind", F.lit("tangled")))
    return settle(kinds, "kinds")


def cascade_curves(positions: DataFrame, tree: Tree, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Size, depth, largest breadth and structural virality after every arrival time.

    Values at equal times are those after all posts of that time. Virality is
    the mean distance over all ordered pairs of posts so far, a post with itself
    included. ``positions`` is read several times and should be a stored table.
    Shallow trees take a row per post and ancestor, long ones are taken apart into heavy
    paths, tangled cascades into bridges and blocks; cascades with posts that no way joins to
    the root, and tangled ones that are long, are walked from every post.
    """
    placed = positions.where(F.col("created_at").isNotNull())
    steps = F.coalesce(F.sum(F.when(F.col("path").isNotNull(), F.size("path") + 1)), F.lit(0))
    count, steps_up, unplaced = placed.agg(F.count(F.lit(1)), steps, F.count_if(F.col("path").isNull())).first()
    kinds = None
    trees = placed
    if unplaced or tree.tangled is not None:
        spanning = left_out = None
        if tree.tangled is not None:
            inside = [df.join(tree.tangled, "cascade_id", "left_semi") for df in (positions, tree.edges)]
            spanning, left_out = spanning_positions(*inside)
        kinds = _kinds(positions, tree.tangled, left_out)
        trees = placed.join(kinds, "cascade_id", "left_anti")
    parts = [
        placed.groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("depth").cast("double").alias("depths"),
            F.max("depth").alias("deep"),
        ),
        _breadth(placed, group_rows, count).groupBy(*KEY).agg(F.max("wide").alias("wide")),
        _shared_in_trees(trees, group_rows, count + steps_up),
    ]
    if kinds is not None:
        present = {r["kind"] for r in kinds.select("kind").distinct().collect()}

        def of(kind: str, df: DataFrame) -> DataFrame:
            return df.join(kinds.where(F.col("kind") == kind), "cascade_id", "left_semi")

        if "long" in present:
            parts.append(shared_in_long_trees(of("long", placed), of("long", tree.edges), group_rows).withColumnRenamed("growth", "shared"))
        if "tangled" in present:
            parts.append(distances_in_tangles(of("tangled", spanning), of("tangled", tree.edges), group_rows))
        if "walked" in present:
            parts.append(distances_by_walks(of("walked", placed), of("walked", tree.edges)))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    if "apart" not in merged.columns:
        merged = merged.withColumn("apart", F.lit(None).cast("double"))
    zero = F.lit(0.0)
    steps = merged.groupBy(*KEY).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum("depths"), zero).alias("depths"),
        F.max("deep").alias("deep"),
        F.max("wide").alias("wide"),
        F.coalesce(F.sum("shared"), zero).alias("shared"),
        F.coalesce(F.sum("apart"), zero).alias("apart"),
    )
    curve = running(
        steps,
        ["cascade_id"],
        ["created_at"],
        sums={"size": "n", "all_depths": "depths", "all_shared": "shared", "all_apart": "apart"},
        maxes={"depth": "deep", "max_breadth": "wide"},
        group_rows=group_rows,
        at_most=count,
    )
    size = F.col("size")
    distance = 2 * (size * F.col("all_depths") - F.col("all_shared")) + F.col("all_apart")
    out = curve
    if kinds is not None:
        out = out.join(kinds, "cascade_id", "left")
        distance = F.when(F.col("kind") == "walked", F.col("all_apart")).otherwise(distance)
    return out.select(
        "cascade_id", "created_at", "size", "depth", "max_breadth", (distance / (size * size)).alias("virality")
    )
