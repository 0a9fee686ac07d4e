"""Reference cascades of all originals at once: members, nodes, tree and positions.

Tables are keyed by ``cascade_id`` (the id of the original) and post ids.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.functions.columns import CLASSES, actor_class
from spreadlab.operators.activity import cascade_roots
from spreadlab.operators.components import connected
from spreadlab.operators.posts import flat, get_post, is_original, originals, references
from spreadlab.operators.prefix import running
from spreadlab.session import settle

# -------------------------------------------------------------- pointer chains

# Ancestors that are listed for a post; longer ways are counted only.
LONGEST_PATH = 64


def arrivals(pointers: DataFrame, scope: list[str], several: bool = False) -> DataFrame:
    """Follow pointers (scope, post_id, up, done) to where they arrive, by doubling their reach.

    ``done`` marks pointers whose ``up`` is already the end of the chain; optional
    ``steps`` are added up along the way, and an optional ``path`` is joined until it is
    longer than ``LONGEST_PATH``, then it is null. Each round lets a pointer jump to
    where its target points, so a chain of n posts takes log2(n) joins. The
    rounds run only over posts that others point to; the rest, most posts of a
    widely shared original, take a single join at the end, and posts pointing
    straight at an end take none. Chains that run in circles never arrive: a
    round without an arrival is the last. ``several`` says that a post may have
    more than one pointer, so that ways can meet and repeated pairs are removed.
    """
    path, steps = "path" in pointers.columns, "steps" in pointers.columns
    fits = F.size("path") + F.size("more") <= LONGEST_PATH

    def jump(moving: DataFrame, ahead: DataFrame) -> DataFrame:
        target = ahead.select(
            *scope,
            F.col("post_id").alias("up"),
            F.col("up").alias("next"),
            F.col("done").alias("arrives"),
            *([F.col("path").alias("more")] if path else []),
            *([F.col("steps").alias("further")] if steps else []),
        )
        out = (
            moving.drop("done")
            .join(target, [*scope, "up"])
            .select(
                *scope,
                "post_id",
                F.col("next").alias("up"),
                F.col("arrives").alias("done"),
                *([F.when(fits, F.concat("path", "more")).alias("path")] if path else []),
                *([(F.col("steps") + F.col("further")).alias("steps")] if steps else []),
            )
        )
        return out.distinct() if several else out

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return df.where("done"), df.where(~F.col("done"))

    direct, moving = split(pointers)
    stops = moving.select(*scope, F.col("up").alias("post_id")).distinct()
    current = settle(pointers.join(stops, [*scope, "post_id"], "left_semi"), "pointers")
    arrived, going = split(current)
    left = going.count()
    while left:
        current = settle(jump(going, arrived.unionByName(going)), "pointers")
        fresh, going = split(current)
        if several:
            fresh = settle(fresh.join(arrived, [*scope, "post_id", "up"], "left_anti"), "arrived")
        new, left = fresh.count(), going.count()
        if not new:
            break
        arrived = arrived.unionByName(fresh)
    reached = direct.unionByName(jump(moving, arrived)).drop("done")
    return reached.distinct() if several else reached


# ---------------------------------------------------------------- membership


def _steps(posts: DataFrame) -> DataFrame:
    """(post_id, ref_id) of posts that reference somebody else at least once.

    A post whose references all go to its own author ends a branch.
    """
    outward = F.exists("referenced_tweets.author.id", lambda author: ~author.eqNullSafe(F.col("author.id")))
    return posts.where(outward).select(
        F.col("id").alias("post_id"), F.explode(F.array_distinct("referenced_tweets.id")).alias("ref_id")
    )


def members(posts: DataFrame) -> DataFrame:
    """(cascade_id, post_id): every post that reaches an original through its references.

    Pointers go from a post to the posts it references and end at originals.
    """
    known = posts.select(F.col("id").alias("ref_id"), is_original().alias("done"))
    known = known.groupBy("ref_id").agg(F.bool_or("done").alias("done"))
    pointers = _steps(posts).join(known, "ref_id").select("post_id", F.col("ref_id").alias("up"), "done").distinct()
    pointers = settle(pointers, "pointers")
    # Posts collected several times may carry other references each time.
    several = not pointers.groupBy("post_id").count().where(F.col("count") > 1).isEmpty()
    arrived = arrivals(pointers, [], several)
    return arrived.select(F.col("up").alias("cascade_id"), "post_id")


def members_from(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """(cascade_id, post_id) grown level by level from any posts in ``roots(cascade_id)``."""
    steps = settle(_steps(posts), "steps").withColumnRenamed("ref_id", "at")
    frontier = settle(roots.select("cascade_id", F.col("cascade_id").alias("at")).distinct(), "frontier")
    seen = None
    while True:
        near = frontier.join(steps, "at").select("cascade_id", "post_id").distinct()
        if seen is not None:
            near = near.join(seen, ["cascade_id", "post_id"], "left_anti")
        near = settle(near, "frontier")
        if near.isEmpty():
            return near if seen is None else seen
        seen = near if seen is None else seen.unionByName(near)
        frontier = near.withColumnRenamed("post_id", "at")


def cascade_references(posts: DataFrame, belongs: DataFrame, side_references: bool = True) -> DataFrame:
    """References of all members to other authors, per cascade, each once however often a post was collected.

    A member's references to posts outside the cascade are kept unless
    ``side_references`` is off. Rows without the time of the referenced post are dropped.
    """
    refs = references(posts).where(
        ~F.col("author_id").eqNullSafe(F.col("ref_author_id")) & F.col("ref_created_at").isNotNull()
    )
    rows = belongs.join(refs.dropDuplicates(["post_id", "ref_id", "ref_type"]), "post_id").select(
        "cascade_id",
        F.col("ref_id").alias("source"),
        F.col("post_id").alias("target"),
        F.col("ref_author_id").alias("source_author_id"),
        F.col("ref_username").alias("source_username"),
        F.col("author_id").alias("target_author_id"),
        F.col("username").alias("target_username"),
        F.col("ref_type").alias("type"),
        F.col("ref_created_at").alias("source_created_at"),
        F.col("created_at").alias("target_created_at"),
    )
    if side_references:
        return rows
    inside = belongs.select("cascade_id", F.col("post_id").alias("source")).unionByName(
        belongs.select("cascade_id", F.col("cascade_id").alias("source")).distinct()
    )
    return rows.join(inside, ["cascade_id", "source"], "left_semi")


def with_texts(refs: DataFrame, posts: DataFrame) -> DataFrame:
    """Add source and target texts; kept out of the earlier steps to keep them narrow."""
    copies = posts.select(F.explode("referenced_tweets").alias("r")).select(
        F.col("r.id").alias("source"), F.col("r.text").alias("source_text")
    )
    source = copies.groupBy("source").agg(F.min("source_text").alias("source_text"))
    target = posts.select(F.col("id").alias("target"), F.col("text").alias("target_text"))
    return refs.join(source, "source", "left").join(target, "target", "left")


# --------------------------------------------------------------------- nodes


def cascade_nodes(posts: DataFrame, refs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Posts of each cascade with author, time and type; the root is 'original'.

    A post seen under several types keeps the last one by name; a post seen only
    as a source is 'other'. The root's fields come from its own row.
    """
    chosen = cascade_roots(posts) if roots is None else roots
    fields = ["author_id", "username", "created_at"]
    sources = refs.where(F.col("source") != F.col("cascade_id")).select(
        "cascade_id",
        F.col("source").alias("post_id"),
        *[F.col(f"source_{f}").alias(f) for f in fields],
        F.lit("").alias("type"),
    )
    targets = refs.where(F.col("target") != F.col("cascade_id")).select(
        "cascade_id",
        F.col("target").alias("post_id"),
        *[F.col(f"target_{f}").alias(f) for f in fields],
        F.coalesce("type", F.lit("")).alias("type"),
    )
    merged = (
        sources.unionByName(targets)
        .groupBy("cascade_id", "post_id")
        .agg(F.max(F.struct("type", "created_at", "author_id", "username")).alias("best"))
        .select(
            "cascade_id",
            "post_id",
            *[F.col(f"best.{f}").alias(f) for f in fields],
            F.when(F.col("best.type") == "", "other").otherwise(F.col("best.type")).alias("type"),
        )
    )
    if set(fields) <= set(chosen.columns):
        own = chosen
    else:
        own = flat(posts).select(F.col("id").alias("cascade_id"), *fields)
        own = own.join(chosen.select("cascade_id"), "cascade_id", "left_semi")
        own = own.groupBy("cascade_id").agg(F.min(F.struct(*fields)).alias("own")).select("cascade_id", "own.*")
    heads = own.select("cascade_id", F.col("cascade_id").alias("post_id"), *fields, F.lit("original").alias("type"))
    return heads.unionByName(merged)


def node_counts(nodes: DataFrame) -> DataFrame:
    """Posts per cascade tree, and whether anything propagated."""
    return nodes.groupBy("cascade_id").agg(F.count(F.lit(1)).alias("size")).withColumn(
        "has_propagation", F.col("size") > 1
    )


# ---------------------------------------------------------------------- tree


def reply_edges(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """A reply hangs on every post it references."""
    replies = nodes.where(F.col("type") == "replied_to").select("cascade_id", F.col("post_id").alias("target"))
    return (
        refs.join(replies, ["cascade_id", "target"], "left_semi")
        .select("cascade_id", F.col("source").alias("parent"), F.col("target").alias("child"))
        .distinct()
    )


def spread_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A retweet or quote hangs on the latest earlier post, in its cascade, by a network in-neighbour.

    Author pairs of a cascade are found from the smaller side: through the
    network when an author has fewer in-neighbours than the cascade has
    authors, otherwise through the cascade's authors. Each pair then sends the
    fewer posts to the other author: either the leader's posts to the follower,
    or the follower's posts to the leader. One ordered pass over each author's
    list gives the latest earlier post, so posts are never paired with each other.
    """
    timed = nodes.where(F.col("created_at").isNotNull() & F.col("author_id").isNotNull()).select(
        "cascade_id", "author_id", "post_id", "created_at", "type"
    )
    seekers = timed.where(F.col("type").isin("retweeted", "quoted")).select(
        "cascade_id", F.col("author_id").alias("follower"), "post_id", "created_at"
    )
    people = timed.groupBy("cascade_id", F.col("author_id").alias("leader")).agg(F.count(F.lit(1)).alias("offered"))
    people = settle(people, "people")
    crowd = people.groupBy("cascade_id").agg(F.count(F.lit(1)).alias("crowd"))
    leads = edges.groupBy(F.col("target").alias("follower")).agg(F.count(F.lit(1)).alias("leads"))
    asking = seekers.groupBy("cascade_id", "follower").agg(F.count(F.lit(1)).alias("asked"))
    asking = settle(asking.join(leads, "follower").join(crowd, "cascade_id"), "asking")
    ties = edges.select(F.col("source").alias("leader"), F.col("target").alias("follower"))
    columns = ["cascade_id", "follower", "leader", "asked", "offered"]
    through_network = (
        asking.where(F.col("leads") <= F.col("crowd")).join(ties, "follower").join(people, ["cascade_id", "leader"])
    )
    through_cascade = (
        asking.where(F.col("leads") > F.col("crowd"))
        .join(people, "cascade_id")
        .join(ties, ["leader", "follower"], "left_semi")
    )
    pairs = settle(through_network.select(columns).unionByName(through_cascade.select(columns)), "author_pairs")

    def offers(who: str, wanted: DataFrame) -> DataFrame:
        posted = wanted.join(timed.withColumnRenamed("author_id", "leader"), ["cascade_id", "leader"])
        return posted.groupBy("cascade_id", F.col(who).alias("who"), "created_at").agg(F.max("post_id").alias("offer"))

    def asks(who: str, rows: DataFrame) -> DataFrame:
        return rows.select("cascade_id", F.col(who).alias("who"), "created_at", "post_id")

    to_follower = pairs.where(F.col("offered") <= F.col("asked")).select("cascade_id", "follower", "leader")
    to_leader = pairs.where(F.col("offered") > F.col("asked")).select("cascade_id", "follower", "leader")
    lists = [
        ("follower", offers("follower", to_follower), asks("follower", seekers)),
        (
            "leader",
            offers("leader", to_leader.select("cascade_id", "leader").distinct()),
            asks("leader", to_leader.join(seekers, ["cascade_id", "follower"])),
        ),
    ]
    events = None
    for side, offered, asked in lists:
        # At equal times the asking post comes first, so only earlier offers count.
        for turn, rows in ((1, offered.withColumn("post_id", F.lit(""))), (0, asked)):
            place = F.struct("created_at", "offer") if turn else F.lit(None).cast("struct<created_at:timestamp,offer:string>")
            part = rows.select(
                "cascade_id", F.lit(side).alias("side"), "who", "created_at", F.lit(turn).alias("turn"), "post_id", place.alias("place")
            )
            events = part if events is None else events.unionByName(part)
    latest = running(
        events, ["cascade_id", "side", "who"], ["created_at", "turn", "post_id"], maxes={"latest": "place"}
    )
    found = latest.where((F.col("turn") == 0) & F.col("latest").isNotNull())
    return (
        found.groupBy("cascade_id", "post_id")
        .agg(F.max("latest").alias("latest"))
        .select("cascade_id", F.col("latest.offer").alias("parent"), F.col("post_id").alias("child"))
    )


def part_links(edges: DataFrame) -> DataFrame:
    """Links (u, v) of nodes (cascade_id, post_id) that connect the parentless posts that ``edges`` connect.

    A post with one parent belongs to the part of that parent, so pointers lead it by doubling to the next post
    above with several parents or none. Only posts with several parents, and those whose pointers run in
    circles, have links: to the ends of their parents. A parentless post without a link is a part's only one.
    """
    parents = edges.where(F.col("parent") != F.col("child")).groupBy("cascade_id", F.col("child").alias("post_id"))
    parents = settle(parents.agg(F.collect_set("parent").alias("parents")), "parents")
    single = parents.where(F.size("parents") == 1).select("cascade_id", "post_id", F.col("parents")[0].alias("up"))
    goes_on = single.select("cascade_id", F.col("post_id").alias("up"), F.lit(True).alias("goes_on"))
    pointers = single.join(goes_on, ["cascade_id", "up"], "left").select("cascade_id", "post_id", "up", F.col("goes_on").isNull().alias("done"))
    ends = settle(arrivals(settle(pointers, "pointers"), ["cascade_id"]), "ends")
    circles = single.join(ends, ["cascade_id", "post_id"], "left_anti")
    several = parents.where(F.size("parents") > 1).select("cascade_id", "post_id", F.explode("parents").alias("at"))
    met = several.join(ends.select("cascade_id", F.col("post_id").alias("at"), F.col("up").alias("end")), ["cascade_id", "at"], "left")
    links = met.select("cascade_id", "post_id", F.coalesce("end", "at").alias("up")).unionByName(circles)
    return links.select(F.struct("cascade_id", F.col("up").alias("post_id")).alias("u"), F.struct("cascade_id", "post_id").alias("v"))


class Tree(NamedTuple):
    edges: DataFrame  # cascade_id, parent, child
    tangled: DataFrame | None  # cascade_id of cascades in which some post has several parents


def cascade_tree(nodes: DataFrame, refs: DataFrame, network_edges: DataFrame) -> Tree:
    """Edges of every cascade's propagation graph, with loose parts linked to the root.

    When no post has two parents, every part that misses the root has exactly
    one parentless post, and that one is linked. Cascades with a post under
    several parents are searched for connected parts instead, and the earliest
    parentless post of each part without the root is linked.
    """
    grown = settle(reply_edges(nodes, refs).unionByName(spread_edges(nodes, network_edges)), "grown")
    several = grown.groupBy("cascade_id", "child").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    tangled = settle(several.select("cascade_id").distinct(), "tangled")
    loose = nodes.where(F.col("post_id") != F.col("cascade_id")).join(
        grown.select("cascade_id", F.col("child").alias("post_id")), ["cascade_id", "post_id"], "left_anti"
    )
    if tangled.isEmpty():
        links = loose.select("cascade_id", F.col("cascade_id").alias("parent"), F.col("post_id").alias("child"))
        return Tree(grown.unionByName(links), None)

    loose = settle(loose.select("cascade_id", "post_id", "created_at"), "loose")
    plain = loose.join(tangled, "cascade_id", "left_anti").select("cascade_id", "post_id")
    node = F.struct("cascade_id", F.col("post_id"))
    parts = connected(part_links(grown.join(tangled, "cascade_id", "left_semi")))
    candidates = (
        loose.join(tangled, "cascade_id", "left_semi")
        .withColumn("node", node)
        .join(parts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    rooted = parts.where(F.col("node.post_id") == F.col("node.cascade_id")).select("component")
    firsts = (
        candidates.join(rooted, "component", "left_anti")
        .groupBy("cascade_id", "component")
        .agg(F.min_by("post_id", F.struct("created_at", "post_id")).alias("post_id"))
    )
    picked = plain.unionByName(firsts.select("cascade_id", "post_id"))
    links = picked.select("cascade_id", F.col("cascade_id").alias("parent"), F.col("post_id").alias("child"))
    return Tree(grown.unionByName(links), tangled)


# ------------------------------------------------------------------ positions


def _tree_paths(edges: DataFrame) -> DataFrame:
    """(cascade_id, post_id, depth, path): steps to the root, and the ancestors below it unless they are too many."""
    at_root = F.col("parent") == F.col("cascade_id")
    pointers = edges.select(
        "cascade_id",
        F.col("child").alias("post_id"),
        F.col("parent").alias("up"),
        at_root.alias("done"),
        F.lit(1).alias("steps"),
        F.when(at_root, F.array().cast("array<string>")).otherwise(F.array("parent")).alias("path"),
    )
    arrived = arrivals(settle(pointers, "pointers"), ["cascade_id"])
    return arrived.select("cascade_id", "post_id", F.col("steps").alias("depth"), "path")


def _least_depths(edges: DataFrame) -> DataFrame:
    """(cascade_id, post_id, depth): the fewest steps from the root to every post it reaches, the root itself included.

    Posts with one parent point up, and doubling leads each to the next post above with several parents, or to
    the root, with a number of steps. Among those posts alone, ways are relaxed round by round: a chain of any length
    is one step there.
    """
    edges = settle(edges.distinct(), "edges")
    parents = edges.groupBy("cascade_id", "child").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("up"))
    parents = settle(parents.withColumnRenamed("child", "post_id"), "parents")
    meets = parents.where(F.col("n") > 1).select("cascade_id", F.col("post_id").alias("up"), F.lit(True).alias("meet"))
    pointers = parents.where(F.col("n") == 1).join(meets, ["cascade_id", "up"], "left")
    done = (F.col("up") == F.col("cascade_id")) | F.col("meet").isNotNull()
    pointers = settle(pointers.select("cascade_id", "post_id", "up", done.alias("done"), F.lit(1).alias("steps")), "pointers")
    chains = settle(arrivals(pointers, ["cascade_id"]).select("cascade_id", "post_id", F.col("up").alias("end"), "steps"), "chains")
    ends = meets.select("cascade_id", F.col("up").alias("post_id")).unionByName(edges.select("cascade_id", F.col("cascade_id").alias("post_id")).distinct())
    placed = chains.unionByName(ends.select("cascade_id", "post_id", F.col("post_id").alias("end"), F.lit(0).alias("steps")))
    into = edges.join(meets.select("cascade_id", F.col("up").alias("child")), ["cascade_id", "child"], "left_semi")
    ways = into.join(placed.withColumnRenamed("post_id", "parent"), ["cascade_id", "parent"])
    ways = settle(ways.groupBy("cascade_id", "end", "child").agg((F.min("steps") + 1).alias("long")), "ways")
    known = settle(edges.select("cascade_id", F.col("cascade_id").alias("end"), F.lit(0).alias("depth")).distinct(), "depths")
    fresh = known
    while not fresh.isEmpty():
        offers = fresh.join(ways, ["cascade_id", "end"]).groupBy("cascade_id", F.col("child").alias("end")).agg(F.min(F.col("depth") + F.col("long")).alias("offer"))
        merged = settle(known.join(offers, ["cascade_id", "end"], "full"), "depths")
        better = F.col("depth").isNull() | (F.col("offer") < F.col("depth"))
        fresh = merged.where(better).select("cascade_id", "end", F.col("offer").alias("depth"))
        known = merged.select("cascade_id", "end", F.least("depth", "offer").alias("depth"))
    return placed.join(known, ["cascade_id", "end"]).select("cascade_id", "post_id", (F.col("depth") + F.col("steps")).alias("depth"))


def _nearest_parents(edges: DataFrame) -> DataFrame:
    """Of several parents the one nearest to the root, of those the first by id; unreached posts have none."""
    depths = settle(_least_depths(edges), "depths")
    above = depths.select("cascade_id", F.col("post_id").alias("parent"), F.col("depth").alias("above"))
    near = edges.join(above, ["cascade_id", "parent"]).groupBy("cascade_id", "child").agg(F.min(F.struct("above", "parent")).alias("best"))
    return near.select("cascade_id", F.col("best.parent").alias("parent"), "child").where(F.col("child") != F.col("cascade_id"))


def cascade_positions(nodes: DataFrame, tree: Tree) -> DataFrame:
    """Depth of every post below the root (-1 when it cannot be reached) and its path.

    ``path`` lists the ancestors below the root, nearest first; where posts have several parents, by the
    nearest one. It is null for unreached posts and for those with more than ``LONGEST_PATH`` ancestors.
    """
    edges = tree.edges
    if tree.tangled is not None:
        inside = tree.edges.join(tree.tangled, "cascade_id", "left_semi")
        edges = tree.edges.join(tree.tangled, "cascade_id", "left_anti").unionByName(_nearest_parents(inside))
    placed = _tree_paths(edges)
    heads = nodes.where(F.col("post_id") == F.col("cascade_id")).select(
        "cascade_id", "post_id", "created_at", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path")
    )
    rest = nodes.where(F.col("post_id") != F.col("cascade_id")).select("cascade_id", "post_id", "created_at")
    rest = rest.join(placed, ["cascade_id", "post_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(-1)))
    return heads.unionByName(rest)


# ------------------------------------------------------------- size statistics


def cascade_sizes(posts: DataFrame) -> DataFrame:
    """References received by every original that has any, with its author's flags."""
    counts = references(posts, ["ref_id"]).groupBy(F.col("ref_id").alias("cascade_id")).agg(F.count(F.lit(1)).alias("size"))
    heads = flat(originals(posts)).select(F.col("id").alias("cascade_id"), "is_usual_suspect", "party")
    return heads.join(counts, "cascade_id")


def _ccdf_points(posts: DataFrame) -> DataFrame:
    sizes = cascade_sizes(posts)
    counted = sizes.groupBy(
        actor_class(F.col("is_usual_suspect"), F.col("party")).alias("user_type"), "size"
    ).agg(F.count(F.lit(1)).alias("n"))
    # One row per class and distinct size: distinct sizes add up to at most the
    # number of references, so there are few of them.
    by_class = Window.partitionBy("user_type")
    down = by_class.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.select(
        "user_type", "size", (F.sum("n").over(down) / F.sum("n").over(by_class) * 100).alias("share")
    )


def size_ccdf(posts: DataFrame) -> DataFrame:
    """Per class, the percentage of cascades of at least each size; gaps stay null."""
    return _ccdf_points(posts).groupBy("size").pivot("user_type", list(CLASSES)).agg(F.first("share"))


def fill_ccdf(posts: DataFrame) -> DataFrame:
    """CCDF without gaps, in long form: 100 up to a class's first size, 0 from its last, linear between.

    Classes with a single point are dropped. The last point itself becomes 0.
    """
    points = settle(_ccdf_points(posts), "ccdf")
    ends = points.groupBy("user_type").agg(
        F.min("size").alias("first"), F.max("size").alias("last"), F.count(F.lit(1)).alias("n")
    )
    ends = ends.where(F.col("n") > 1)  # at most four rows
    grid = points.select("size").distinct().select("size", F.explode(F.array(*map(F.lit, CLASSES))).alias("user_type"))
    known = F.when(F.col("size") <= F.col("first"), 100.0).when(F.col("size") >= F.col("last"), 0.0).otherwise(
        F.col("share")
    )
    rows = (
        grid.join(F.broadcast(ends), "user_type")
        .join(points, ["user_type", "size"], "left")
        .withColumn("known", known)
        .withColumn("spot", F.when(F.col("known").isNotNull(), F.struct("size", "known")))
    )
    ordered = Window.partitionBy("user_type").orderBy("size")
    back = F.last("spot", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("spot", ignorenulls=True).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("lo", back).withColumn("hi", ahead)
    along = (F.col("size") - F.col("lo.size")) / (F.col("hi.size") - F.col("lo.size"))
    filled = F.coalesce("known", F.col("lo.known") + (F.col("hi.known") - F.col("lo.known")) * along)
    return rows.select("user_type", "size", filled.alias("share"))


def top_cascades(posts: DataFrame, max_cascades: int | None = None) -> DataFrame:
    """Originals by retweets, the most retweeted first."""
    rows = flat(originals(posts)).select(F.col("id").alias("cascade_id"), "retweet_count")
    ranked = rows.orderBy(F.desc("retweet_count"), "cascade_id")
    return ranked if max_cascades is None else ranked.limit(max_cascades)


def lone_node(posts: DataFrame, post_id: str) -> dict:
    """The single node of a post that nothing references; an error for an unknown post."""
    row = get_post(posts, post_id)
    return {
        "post_id": row["id"],
        "author_id": row["author"]["id"],
        "username": row["author"]["username"],
        "created_at": row["created_at"],
        "type": "original",
    }
