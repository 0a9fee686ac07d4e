"""Growth of the sum of distances between posts, for cascades that the paths of a shallow tree do not cover.

Long reply threads are taken apart into heavy paths, tangled cascades into bridges and the parts
between them; only cascades with posts that the root does not reach are walked from every post.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.operators.cascades import LONGEST_PATH, arrivals
from spreadlab.operators.components import connected
from spreadlab.operators.prefix import running
from spreadlab.session import settle

KEY = ["cascade_id", "created_at"]


def _growth(rows: DataFrame, keys: list[str], sums: dict[str, str], value, group_rows: int) -> DataFrame:
    """(cascade_id, created_at, growth): by how much ``value`` of running sums grows at every time.

    ``sums`` maps a name to the column that is added up; ``value`` gets the sums as doubles.
    """
    counted = running(rows, keys, ["created_at"], sums=sums, group_rows=group_rows)
    now = {name: F.col(name).cast("double") for name in sums}
    was = {name: (F.col(name) - F.col(column)).cast("double") for name, column in sums.items()}
    return counted.select(*KEY, (value(**now) - value(**was)).alias("growth"))


# ------------------------------------------------------------------- long trees


def subtree_sizes(edges: DataFrame) -> DataFrame:
    """(cascade_id, post_id, size) of every post of trees, by doubling the reach of pointers.

    Posts within 2^(k+1) steps below a post are those within 2^k and what the posts exactly 2^k below
    it have within 2^k. A chain of n posts takes log2(n) rounds.
    """
    children = edges.select("cascade_id", F.col("child").alias("post_id"), F.col("parent").alias("up"))
    heads = edges.select("cascade_id", F.col("cascade_id").alias("post_id"), F.lit(None).cast("string").alias("up")).distinct()
    current = settle(children.unionByName(heads).withColumn("size", F.lit(1).cast("long")), "sizes")
    while not current.where(F.col("up").isNotNull()).isEmpty():
        pointing = current.where(F.col("up").isNotNull())
        below = pointing.groupBy("cascade_id", F.col("up").alias("post_id")).agg(F.sum("size").alias("below"))
        ahead = current.select("cascade_id", F.col("post_id").alias("up"), F.col("up").alias("next"))
        moved = current.join(ahead, ["cascade_id", "up"], "left").select("cascade_id", "post_id", F.col("next").alias("up"), "size")
        moved = moved.join(below, ["cascade_id", "post_id"], "left")
        current = settle(moved.select("cascade_id", "post_id", "up", (F.col("size") + F.coalesce("below", F.lit(0))).alias("size")), "sizes")
    return current.select("cascade_id", "post_id", "size")


def heavy_paths(edges: DataFrame) -> DataFrame:
    """(cascade_id, post_id, head, covered, onward) of every post of trees.

    A heavy path goes on to the child with the most posts below it (of several, the last by id). ``covered``
    is the number of edges from the post up to and including the one above its path's head, and ``onward`` where
    that edge leads, null on the root's path. A way to the root meets at most log2(n) paths.
    """
    sized = subtree_sizes(edges).withColumnRenamed("post_id", "child")
    best = F.max(F.struct("size", "child")).getField("child").alias("heir")
    heirs = settle(edges.join(sized, ["cascade_id", "child"]).groupBy("cascade_id", "parent").agg(best), "heirs")
    chosen = heirs.select("cascade_id", F.col("heir").alias("post_id"), F.col("parent").alias("up"))
    inner = chosen.select("cascade_id", F.col("post_id").alias("up"), F.lit(True).alias("goes_on"))
    pointers = chosen.join(inner, ["cascade_id", "up"], "left").select("cascade_id", "post_id", "up", F.col("goes_on").isNull().alias("done"), F.lit(1).alias("steps"))
    placed = arrivals(settle(pointers, "pointers"), ["cascade_id"]).select("cascade_id", "post_id", F.col("up").alias("head"), "steps")
    ends = edges.select("cascade_id", F.col("child").alias("post_id")).unionByName(edges.select("cascade_id", F.col("cascade_id").alias("post_id")).distinct())
    ends = ends.join(chosen, ["cascade_id", "post_id"], "left_anti").select("cascade_id", "post_id", F.col("post_id").alias("head"), F.lit(0).alias("steps"))
    above = edges.select("cascade_id", F.col("child").alias("head"), F.col("parent").alias("onward"))
    out = placed.unionByName(ends).join(above, ["cascade_id", "head"], "left")
    return out.select("cascade_id", "post_id", "head", (F.col("steps") + F.col("onward").isNotNull().cast("int")).alias("covered"), "onward")


def shared_in_long_trees(placed: DataFrame, edges: DataFrame, group_rows: int) -> DataFrame:
    """Growth of the edges that ways to the root share, over all ordered pairs of posts, a post with itself included.

    Two posts whose ways cover p and q edges of a heavy path share the lesser number of them. Numbers that
    differ part at their highest differing bit: there the one with bit 0 is the lesser. So a sum over pairs takes, for
    each bit, the posts with the same higher bits: the sum of the lesser ones times the number of the others.
    """
    paths = settle(heavy_paths(edges), "heavy_paths")
    at = placed.groupBy("cascade_id", "created_at", F.col("post_id").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    at, covers = settle(at, "ways"), None
    while not at.isEmpty():
        met = settle(at.join(paths.withColumnRenamed("post_id", "at"), ["cascade_id", "at"]), "met")
        rows = met.where(F.col("covered") > 0).select("cascade_id", "head", "covered", "created_at", "n")
        covers = rows if covers is None else covers.unionByName(rows)
        at = settle(met.where(F.col("onward").isNotNull()).groupBy("cascade_id", "created_at", F.col("onward").alias("at")).agg(F.sum("n").alias("n")), "ways")
    if covers is None:
        return placed.select(*KEY, F.lit(0.0).alias("growth")).limit(0)
    covers = settle(covers.groupBy("cascade_id", "head", "covered", "created_at").agg(F.sum("n").alias("n")), "covers")
    alike = _growth(covers, ["cascade_id", "head", "covered"], {"r": "n"}, lambda r: r * r * F.col("covered"), group_rows)
    longest = covers.groupBy("cascade_id", "head").agg(F.max("covered").alias("longest"))
    bits = covers.join(longest, ["cascade_id", "head"]).select(
        "cascade_id", "head", "created_at", "covered", "n", F.explode(F.sequence(F.lit(0), F.floor(F.log2("longest")).cast("int"))).alias("bit")
    )
    lower = F.expr("shiftright(covered, bit) & 1") == 0
    split = bits.groupBy("cascade_id", "head", "bit", F.expr("shiftright(covered, bit + 1)").alias("higher"), "created_at").agg(
        F.sum(F.when(lower, F.col("n") * F.col("covered")).otherwise(0)).alias("less"), F.sum(F.when(lower, 0).otherwise(F.col("n"))).alias("more")
    )
    apart = _growth(split, ["cascade_id", "head", "bit", "higher"], {"p": "less", "q": "more"}, lambda p, q: 2 * p * q, group_rows)
    return alike.unionByName(apart).groupBy(*KEY).agg(F.sum("growth").alias("growth"))


# -------------------------------------------------------------- tangled cascades


def _links(edges: DataFrame) -> DataFrame:
    """(cascade_id, a, b): pairs of posts with an edge, each once."""
    ends = F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b")
    return edges.where(F.col("parent") != F.col("child")).select("cascade_id", *ends).distinct()


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("cascade_id", F.col("a").alias("at"), F.col("b").alias("to")).unionByName(
        links.select("cascade_id", F.col("b").alias("at"), F.col("a").alias("to"))
    )


def _way(post: Column) -> Column:
    """A post and its ancestors below the root."""
    return F.concat(F.array(post), F.col("path"))


def spanning_positions(positions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions in a spanning tree, whatever the edges' direction, and those of posts that it leaves out.

    Reached posts keep their way to the root. The others (mostly posts from outside that a reply refers to as well)
    hang on a neighbour, round by round. ``was`` is the depth before. Left out are posts that no way joins to
    the root and those with too many ancestors.
    """
    links = settle(_both_ways(_links(edges)), "links")
    columns = ["cascade_id", "post_id", "created_at", "depth", "was", "path"]
    rows = positions.withColumn("was", F.col("depth")).select(columns)
    known = settle(rows.where(F.col("path").isNotNull()), "spanning")
    lost = settle(rows.where(F.col("path").isNull()), "lost")
    fresh = known
    while not lost.isEmpty():
        way = F.when(F.col("post_id") == F.col("cascade_id"), F.array().cast("array<string>")).otherwise(_way(F.col("post_id")))
        beside = fresh.select("cascade_id", F.col("post_id").alias("at"), way.alias("way")).where(F.size("way") <= LONGEST_PATH)
        offers = beside.join(links, ["cascade_id", "at"]).select("cascade_id", F.col("to").alias("post_id"), "way")
        offers = offers.join(lost.select("cascade_id", "post_id"), ["cascade_id", "post_id"], "left_semi")
        best = offers.groupBy("cascade_id", "post_id").agg(F.min(F.struct(F.size("way").alias("n"), "way")).alias("best"))
        fresh = lost.join(best, ["cascade_id", "post_id"])
        fresh = settle(fresh.select("cascade_id", "post_id", "created_at", (F.col("best.n") + 1).alias("depth"), "was", F.col("best.way").alias("path")), "spanning")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
        lost = settle(lost.join(fresh, ["cascade_id", "post_id"], "left_anti").select(columns), "lost")
    return known, lost


class Blocks:
    """What bridges separate: the posts whose edge to the spanning tree's parent is no bridge, and the parts they form."""

    def __init__(self, positions: DataFrame, edges: DataFrame):
        """``positions`` are those in a spanning tree."""
        up = F.when(F.size("path") > 0, F.col("path")[0]).otherwise(F.col("cascade_id"))
        tree = positions.where(F.col("depth") > 0).select("cascade_id", F.col("post_id").alias("child"), up.alias("parent"), "path")
        tree = settle(tree, "spanning")
        extra = settle(_links(edges).join(_links(tree), ["cascade_id", "a", "b"], "left_anti"), "extra")
        # A link outside the tree closes a circle with the tree's edges above just one of its ends.
        ends = extra.select("cascade_id", "a", "b", F.explode(F.array("a", "b")).alias("child")).join(tree, ["cascade_id", "child"])
        above = ends.select("cascade_id", "a", "b", F.explode(_way(F.col("child"))).alias("post_id"))
        once = above.groupBy("cascade_id", "post_id", "a", "b").agg(F.count(F.lit(1)).alias("ends")).where(F.col("ends") == 1)
        self.covered = settle(once.select("cascade_id", "post_id").distinct(), "covered")
        closed = tree.join(self.covered.withColumnRenamed("post_id", "child"), ["cascade_id", "child"], "left_semi")
        self.links = settle(_links(closed).unionByName(extra).distinct(), "block_links")
        node = [F.struct("cascade_id", F.col(end).alias("post_id")).alias(name) for end, name in (("a", "u"), ("b", "v"))]
        parts = connected(self.links.select(*node)).select("node.*", F.col("component.post_id").alias("block"))
        depths = positions.select("cascade_id", "post_id", "depth")
        parts = settle(parts.join(depths, ["cascade_id", "post_id"]), "parts")
        top = parts.groupBy("cascade_id", "block").agg(F.min(F.struct("depth", "post_id")).getField("post_id").alias("top"))
        self.members = settle(parts.join(top, ["cascade_id", "block"]).select("cascade_id", "block", "post_id", "top"), "members")

    def apart(self) -> DataFrame:
        """(cascade_id, block, x, y, apart): distances of the posts of each block, by walks inside it."""
        links = settle(_both_ways(self.links), "links")
        at = F.col("post_id")
        frontier = settle(self.members.select("cascade_id", "block", at.alias("x"), at.alias("y")), "walk")
        seen, length = frontier.withColumn("apart", F.lit(0)), 0
        while True:
            length += 1
            near = frontier.withColumnRenamed("y", "at").join(links, ["cascade_id", "at"]).select("cascade_id", "block", "x", F.col("to").alias("y")).distinct()
            frontier = settle(near.join(seen, ["cascade_id", "block", "x", "y"], "left_anti"), "walk")
            if frontier.isEmpty():
                return seen
            seen = seen.unionByName(frontier.withColumn("apart", F.lit(length)))


def distances_in_tangles(positions: DataFrame, edges: DataFrame, group_rows: int) -> DataFrame:
    """Growth of ``depths``, ``shared`` and ``apart`` of cascades that are trees but for some circles.

    The sum of distances over ordered pairs of n posts is 2 (n * depths - shared) + apart. Every edge that is a
    bridge counts as in a tree. Inside a block, all posts beyond one of its posts weigh there; distances are taken by
    way of the block's top, which adds to ``depths``, and ``apart`` corrects that for two posts x and y, neither the top,
    by d(x, y) - d(x, top) - d(y, top). ``positions`` are those in a spanning tree; ``depths`` is what is to be added
    to the depths that were there before.
    """
    blocks = Blocks(positions, edges)
    timed = positions.where(F.col("created_at").isNotNull() & (F.col("depth") > 0))
    ways = timed.select(*KEY, F.col("post_id").alias("v"), F.posexplode(_way(F.col("post_id"))).alias("up", "post_id"))
    ways = settle(ways.join(blocks.covered.withColumn("closed", F.lit(True)), ["cascade_id", "post_id"], "left"), "ways")
    bridges = ways.where(F.col("closed").isNull()).groupBy("cascade_id", "post_id", "created_at").agg(F.count(F.lit(1)).alias("n"))
    shared = _growth(bridges, ["cascade_id", "post_id"], {"r": "n"}, lambda r: r * r, group_rows)

    beyond = blocks.members.where(F.col("post_id") != F.col("top"))
    gates = ways.join(beyond, ["cascade_id", "post_id"]).groupBy(*KEY, "v", "block").agg(F.min_by("post_id", "up").alias("x"), F.min_by("top", "up").alias("top"))
    gates = settle(gates.groupBy("cascade_id", "block", "top", "x", "created_at").agg(F.count(F.lit(1)).alias("n")), "gates")
    distance = settle(blocks.apart(), "block_distances")
    to_top = distance.withColumnRenamed("y", "top").withColumnRenamed("apart", "rise")
    raised = settle(gates.join(to_top, ["cascade_id", "block", "top", "x"]), "raised")
    depths = raised.select(*KEY, (F.col("n") * F.col("rise")).cast("double").alias("growth")).unionByName(
        ways.where("closed").groupBy(*KEY).agg((-F.count(F.lit(1))).cast("double").alias("growth"))
    )
    hung = timed.where(F.col("was") != F.col("depth")).select(*KEY, (F.col("depth") - F.col("was")).cast("double").alias("growth"))
    depths = depths.unionByName(hung)

    weights = raised.select("cascade_id", "block", "x", "created_at", "n", "rise")
    alone = _growth(weights, ["cascade_id", "block", "x"], {"r": "n"}, lambda r: -2 * r * r * F.col("rise"), group_rows)
    rises = weights.select("cascade_id", "block", "x", "rise").distinct()
    pairs = distance.where(F.col("x") < F.col("y")).join(rises, ["cascade_id", "block", "x"])
    pairs = pairs.join(rises.select("cascade_id", "block", F.col("x").alias("y"), F.col("rise").alias("other")), ["cascade_id", "block", "y"])
    pairs = settle(pairs.select("cascade_id", "block", "x", "y", (F.col("apart") - F.col("rise") - F.col("other")).alias("spare")).where(F.col("spare") != 0), "block_pairs")
    none = F.lit(0).cast("long")
    events = [
        pairs.join(weights.select("cascade_id", "block", F.col("x").alias(end), "created_at", "n"), ["cascade_id", "block", end]).select(
            "cascade_id", "x", "y", "spare", "created_at", (F.col("n") if end == "x" else none).alias("left"), (F.col("n") if end == "y" else none).alias("right")
        )
        for end in ("x", "y")
    ]
    met = events[0].unionByName(events[1]).groupBy("cascade_id", "x", "y", "spare", "created_at").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    together = _growth(met, ["cascade_id", "x", "y"], {"p": "left", "q": "right"}, lambda p, q: 2 * p * q * F.col("spare"), group_rows)
    apart = alone.unionByName(together)
    named = [part.groupBy(*KEY).agg(F.sum("growth").alias(name)) for part, name in ((depths, "depths"), (shared, "shared"), (apart, "apart"))]
    return named[0].unionByName(named[1], allowMissingColumns=True).unionByName(named[2], allowMissingColumns=True)


# ------------------------------------------------------------------------ walks


def distances_by_walks(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """Growth of the sum of distances between two posts, by walks from every post.

    Walks run one level at a time over all such cascades, keyed by (cascade, start, post), and are reduced to
    times at every level. Posts that no way joins add nothing.
    """
    links = settle(_both_ways(_links(edges)), "links")
    nodes = placed.select("cascade_id", "post_id", "created_at")
    post = F.col("post_id")
    frontier = settle(nodes.select("cascade_id", post.alias("start"), post.alias("at"), F.col("created_at").alias("began")), "walk")
    seen, length, total = frontier.select("cascade_id", "start", "at"), 0, None
    while True:
        length += 1
        near = frontier.join(links, ["cascade_id", "at"]).select("cascade_id", "start", F.col("to").alias("at"), "began")
        near = near.distinct().join(seen, ["cascade_id", "start", "at"], "left_anti")
        frontier = settle(near, "walk")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("cascade_id", "start", "at"))
        met = frontier.join(nodes.withColumnRenamed("post_id", "at"), ["cascade_id", "at"])
        level = met.groupBy("cascade_id", F.greatest("began", "created_at").alias("created_at")).agg(
            (F.count(F.lit(1)) * length).cast("double").alias("apart")
        )
        total = level if total is None else total.unionByName(level)
    if total is None:
        return nodes.select(*KEY, F.lit(0.0).alias("apart")).limit(0)
    return total.groupBy(*KEY).agg(F.sum("apart").alias("apart"))
