"""The weighted interaction network between authors and its sub-networks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.operators.components import connected
from spreadlab.operators.posts import REFERENCE_TYPES, between_authors, references, window
from spreadlab.session import settle


class Network(NamedTuple):
    vertices: DataFrame  # author_id, username
    edges: DataFrame  # source, target, weight, weight_inv, weight_norm


def interactions(posts: DataFrame, types: Sequence[str] = REFERENCE_TYPES, start=None, end=None, hashtags=()) -> DataFrame:
    """How often each author was referenced by each other author.

    ``weight_norm`` is the share of the referenced author's total. The counted
    pairs are stored, so the posts are scanned once for pairs and totals.
    """
    chosen = window(posts, start, end, hashtags, mode="network")
    refs = between_authors(references(chosen, ["ref_type", "ref_author_id"]), types)
    pairs = refs.groupBy(F.col("ref_author_id").alias("source"), F.col("author_id").alias("target")).agg(
        F.count(F.lit(1)).alias("weight")
    )
    pairs = settle(pairs, "pairs")
    totals = pairs.groupBy("source").agg(F.sum("weight").alias("total"))
    return pairs.join(totals, "source").select(
        "source",
        "target",
        "weight",
        (1 / F.col("weight")).alias("weight_inv"),
        (F.col("weight") / F.col("total")).alias("weight_norm"),
    )


def authors(posts: DataFrame, start=None, end=None, hashtags=()) -> DataFrame:
    """Authors of the posts in a window, with one of their usernames."""
    chosen = window(posts, start, end, hashtags, mode="network")
    return (
        chosen.groupBy(F.col("author.id").alias("author_id"))
        .agg(F.min("author.username").alias("username"))
        .where(F.col("author_id").isNotNull())
    )


def network(posts: DataFrame, types: Sequence[str] = REFERENCE_TYPES, start=None, end=None, hashtags=()) -> Network:
    """Authors of the window and the interactions between them.

    The referencing author of a pair posted in the window by construction, so
    only the referenced side is checked against the roster. Shares are those of
    the unrestricted pairs. Without any interaction the network is empty.
    """
    pairs = interactions(posts, types, start, end, hashtags)
    roster = authors(posts, start, end, hashtags)
    if pairs.isEmpty():
        roster = roster.limit(0)
    edges = pairs.join(roster.select(F.col("author_id").alias("source")), "source", "left_semi")
    return Network(roster, edges)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge as (author_id, other)."""
    return edges.select(F.col("source").alias("author_id"), F.col("target").alias("other")).unionByName(
        edges.select(F.col("target").alias("author_id"), F.col("source").alias("other"))
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Edges into, out of and at every author."""
    ends = edges.select(F.col("source").alias("author_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("target").alias("author_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("author_id").agg(
        F.sum(F.col("o") + F.col("i")).alias("degree"),
        F.sum("i").alias("in_degree"),
        F.sum("o").alias("out_degree"),
    )


def neighbours(net: Network, author_id: str) -> DataFrame:
    """An author and everyone linked to them in either direction; empty when unknown."""
    near = undirected(net.edges).where(F.col("author_id") == author_id).select(F.col("other").alias("author_id"))
    self_row = net.vertices.where(F.col("author_id") == author_id).select("author_id")
    return near.unionByName(self_row).distinct()


def induced(net: Network, chosen: DataFrame) -> Network:
    """The part of a network on the authors listed in ``chosen(author_id)``."""
    edges = net.edges.join(chosen.select(F.col("author_id").alias("source")), "source", "left_semi").join(
        chosen.select(F.col("author_id").alias("target")), "target", "left_semi"
    )
    return Network(net.vertices.join(chosen, "author_id", "left_semi"), edges)


def ego(net: Network, author_id: str, depth: int = 2) -> Network:
    """Network on the authors within ``depth`` undirected steps of one author."""
    start = net.vertices.where(F.col("author_id") == author_id).select("author_id")
    if start.isEmpty():
        raise LookupError(f"author {author_id} not found")
    links = undirected(net.edges)
    reached = frontier = settle(start, "ego")
    for _ in range(depth):
        step = links.join(frontier, "author_id", "left_semi").select(F.col("other").alias("author_id")).distinct()
        frontier = settle(step.join(reached, "author_id", "left_anti"), "ego")
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    return induced(net, reached)


def backbone_edges(edges: DataFrame, threshold: float = 0.05, max_edges: int | None = None) -> DataFrame:
    """Edges whose alpha is above the threshold, the strongest first when capped.

    alpha = (1 - weight_norm) ^ (degree of the source - 1).
    """
    degree = degrees(edges).select(F.col("author_id").alias("source"), "degree")
    alpha = F.pow(1 - F.col("weight_norm"), F.col("degree") - 1)
    kept = edges.join(degree, "source").withColumn("alpha", alpha).drop("degree").where(F.col("alpha") > threshold)
    if max_edges:
        kept = kept.orderBy(F.desc("alpha"), "source", "target").limit(max_edges)
    return kept


def backbone(net: Network, threshold: float = 0.05, max_edges: int | None = None, delete_vertices: bool = True) -> Network:
    """Backbone of a network; authors left without edges are dropped on request."""
    edges = backbone_edges(net.edges, threshold, max_edges)
    if not delete_vertices:
        return Network(net.vertices, edges)
    ends = undirected(edges).select("author_id").distinct()
    return Network(net.vertices.join(ends, "author_id", "left_semi"), edges)


def components(net: Network) -> DataFrame:
    """Weakly connected component of every author; a lone author is its own."""
    found = connected(net.edges.select(F.col("source").alias("u"), F.col("target").alias("v")))
    labels = found.select(F.col("node").alias("author_id"), "component")
    return net.vertices.select("author_id").join(labels, "author_id", "left").select(
        "author_id", F.coalesce("component", "author_id").alias("component")
    )


def ego_for_display(net: Network, author_id: str, depth: int = 2, max_edges: int | None = None) -> Network:
    """Ego network with every part linked to the author, of the strongest edges if their number is limited.

    With ``max_edges`` the edges are ranked as in the backbone and so many are kept;
    parts cut off from the author get a link to their first author by username.
    """
    around = ego(net, author_id, depth)
    around = Network(settle(around.vertices, "ego"), settle(around.edges, "ego"))
    if max_edges is not None:
        cut = backbone_edges(around.edges, threshold=-1, max_edges=max_edges)
        edges = settle(cut.drop("alpha"), "ego")
        me = around.vertices.where(F.col("author_id") == author_id)
        ends = undirected(edges).select("author_id").unionByName(me.select("author_id")).distinct()
        around = Network(settle(around.vertices.join(ends, "author_id", "left_semi"), "ego"), edges)
    parts = settle(components(around).join(around.vertices, "author_id"), "ego")
    mine = parts.where(F.col("author_id") == author_id).select("component")
    firsts = (
        parts.join(mine, "component", "left_anti")
        .groupBy("component")
        .agg(F.min_by("author_id", F.struct("username", "author_id")).alias("target"))
    )
    links = firsts.select(F.lit(author_id).alias("source"), "target")
    return Network(around.vertices, around.edges.unionByName(links, allowMissingColumns=True))


def network_size(net: Network) -> DataFrame:
    """Number of authors and of edges."""
    nodes = net.vertices.agg(F.count(F.lit(1)).alias("num_nodes"))
    return nodes.withColumn("num_edges", net.edges.agg(F.count(F.lit(1))).scalar())


# Authors of a component up to which sets of authors are kept as bitmaps: 2 KB, what a sketch of precision 12 takes.
BITMAP_AUTHORS = 1 << 14
# Links (in both directions) of a component up to which it is walked inside a task, and that a task takes up at a time.
TASK_LINKS = 1 << 22
PACKED_LINKS = 1 << 19


def mean_closeness(
    net: Network, precision: int = 12, bitmap_authors: int = BITMAP_AUTHORS, task_links: int = TASK_LINKS
) -> DataFrame:
    """Mean over linked authors of (reachable - 1) / sum of distances, direction ignored.

    Each author holds the set of authors within some distance, at first only itself; a
    round unites it with those of its neighbours, and what it gains is at that
    distance. A round costs one row per link of an author that does not reach its whole component
    yet, so all authors count and no pairs of them are made. In components of up to ``bitmap_authors``
    authors the sets are bitmaps, one bit an author, and exact; with up to ``task_links`` links a component goes through
    its rounds inside a task, so only its links are exchanged, once. In larger ones they are
    sketches with a relative standard error of about 1.04 / sqrt(2 ** precision), 1.6 % at 12,
    which the mean over many authors reduces; those rounds end when no estimate grows.
    """
    links = settle(undirected(net.edges).distinct(), "links")
    once = links.where(F.col("author_id") < F.col("other"))
    parts = settle(connected(once.select(F.col("author_id").alias("u"), F.col("other").alias("v"))), "parts")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumn("part", F.monotonically_increasing_id())
    sizes = settle(sizes, "sizes")
    small = sizes.where(F.col("size") <= bitmap_authors)
    # At most ``bitmap_authors`` rows a component.
    place = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    numbered = parts.join(small, "component").select(F.col("node").alias("author_id"), "part", "size", place.alias("bit"))
    numbered = settle(numbered, "numbered")
    ends = links.select("author_id", "other").join(numbered.withColumnRenamed("bit", "a"), "author_id").drop("author_id")
    ends = ends.join(numbered.select(F.col("author_id").alias("other"), F.col("bit").alias("b")), "other")
    ends = settle(ends.select("part", F.col("size").cast("int").alias("size"), "a", "b"), "ends")
    crowded = settle(ends.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_links).select("part"), "crowded")
    found = _in_tasks(ends.join(crowded, "part", "left_anti"))
    if not crowded.isEmpty():
        rest = _by_bitmaps(numbered.join(crowded, "part", "left_semi").drop("part"), links)
        found = found.unionByName(rest.select("n", "total"))
    if not sizes.where(F.col("size") > bitmap_authors).isEmpty():
        large = parts.join(small, "component", "left_anti").select(F.col("node").alias("author_id"))
        found = found.unionByName(_by_sketches(links.join(large, "author_id", "left_semi"), precision).select("n", "total"))
    return found.agg(F.avg((F.col("n") - 1) / F.col("total")).alias("closeness"))


def _in_tasks(ends: DataFrame) -> DataFrame:
    """(n, total) of every author of ``ends(part, size, a, b)``, the links of components from author a to b by their numbers.

    A component is in one task. Many small ones are walked at a time: an author has as many 64-bit words as the largest needs.
    """
    packed = PACKED_LINKS

    def walked(part: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        firsts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sizes = size[firsts].astype(np.int64)
        offset = np.cumsum(sizes) - sizes
        shift = np.repeat(offset, np.diff(np.r_[firsts, len(part)]))
        a, b = a + shift, b + shift
        whole = np.repeat(sizes, sizes)
        own = np.arange(len(whole)) - np.repeat(offset, sizes)
        # A row a word, so that what an author hears is taken from one short stretch of memory.
        bits = np.zeros((int(sizes.max() + 63) // 64, len(whole)), np.uint64)
        bits[own >> 6, np.arange(len(whole))] = np.uint64(1) << (own & 63).astype(np.uint64)
        ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)
        n, total, distance = np.ones(len(whole), np.int64), np.zeros(len(whole), np.int64), 0
        while len(a):
            distance += 1
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            heard, reached = a[starts], np.zeros(len(starts), np.int64)
            wider = []
            for word in bits:
                word = word[heard] | np.bitwise_or.reduceat(word[b], starts)
                reached += ones[word.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64)
                wider.append(word)
            for word, new in zip(bits, wider):
                word[heard] = new
            total[heard] += (reached - n[heard]) * distance
            n[heard] = reached
            going = n[a] < whole[a]
            a, b = a[going], b[going]
        return np.stack([n, total])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, wanted = [], 0, packed
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            rows += batch.num_rows
            if rows < wanted:
                continue
            links = [np.concatenate(column) for column in zip(*held)]
            # The last component may go on.
            end = int(np.flatnonzero(links[0] != links[0][-1])[-1]) + 1 if links[0][0] != links[0][-1] else 0
            if end:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, walked(*[c[:end] for c in links]))), ["n", "total"])
            held, rows = [[c[end:] for c in links]], rows - end
            wanted = max(packed, 2 * rows)
        if rows:
            links = [np.concatenate(column) for column in zip(*held)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, walked(*links))), ["n", "total"])

    dealt = ends.select("part", "size", "a", "b").repartition("part").sortWithinPartitions("size", "part", "a")
    return dealt.mapInArrow(of, "n bigint, total bigint")


def _by_bitmaps(numbered: DataFrame, links: DataFrame) -> DataFrame:
    """(author_id, n, total) of ``numbered(author_id, size, bit)``: authors reached, and the sum of their distances."""

    def united(rows: DataFrame) -> DataFrame:
        # Rows are exchanged as they are: what is combined before an exchange has the full length of 4 KB.
        some = rows.repartition("author_id").groupBy("author_id").agg(
            F.bitmap_or_agg("bits").alias("bits"), *[F.max(c).alias(c) for c in ("size", "n", "total")]
        )
        return some.withColumn("bits", cut)

    cut = F.expr("substring(bits, 1, int((size + 7) div 8))")
    whole, nothing = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    own = numbered.groupBy("author_id").agg(F.bitmap_construct_agg("bit").alias("bits"), F.max("size").alias("size"))
    now = settle(own.select("author_id", cut.alias("bits"), "size", whole.alias("n"), nothing.alias("total")), "bitmaps")
    links, distance, unknown = links.select("author_id", "other"), 0, F.lit(None).cast("bigint")
    while True:
        going = now.where("n < size")
        if going.isEmpty():
            return now.select("author_id", "n", "total")
        distance += 1
        heard = links.join(going.select("author_id"), "author_id", "left_semi").join(
            now.select(F.col("author_id").alias("other"), "bits"), "other"
        )
        rows = heard.select("author_id", "bits", *[unknown.alias(c) for c in ("size", "n", "total")]).unionByName(going)
        reached = F.bitmap_count("bits")
        wider = united(rows).select(
            "author_id", "bits", "size", reached.alias("n"), (F.col("total") + (reached - F.col("n")) * distance).alias("total")
        )
        now = settle(now.where("n >= size").unionByName(wider), "bitmaps")


def _by_sketches(links: DataFrame, precision: int) -> DataFrame:
    """(author_id, n, total) by sketches, of the authors of ``links``."""
    links = settle(links, "links")
    nothing = F.lit(0).cast("bigint")
    start = links.groupBy("author_id").agg(F.hll_sketch_agg("author_id", precision).alias("sketch"))
    now = settle(start.select("author_id", "sketch", F.lit(1).cast("bigint").alias("n"), nothing.alias("total")), "sketches")
    distance = 0
    while True:
        distance += 1
        heard = links.join(now.select(F.col("author_id").alias("other"), "sketch"), "other").groupBy("author_id").agg(
            F.hll_union_agg("sketch").alias("heard")
        )
        wider = now.join(heard, "author_id").withColumn("sketch", F.hll_union("sketch", "heard"))
        reached = F.greatest(F.hll_sketch_estimate("sketch"), "n")
        gained = reached - F.col("n")
        now = settle(
            wider.select("author_id", "sketch", reached.alias("n"), (F.col("total") + gained * distance).alias("total"), gained.alias("gained")), "sketches"
        )
        if now.where("gained > 0").isEmpty():
            return now.select("author_id", "n", "total")


def edge_positions(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """Coordinates of both ends of every edge and a blank separator, three rows per edge."""
    at = {
        side: layout.select(F.col("author_id").alias(side), F.struct("x", "y", "z").alias(f"{side}_at"))
        for side in ("source", "target")
    }
    placed = edges.select("source", "target").join(at["source"], "source").join(at["target"], "target")
    blank = F.lit(None).cast(placed.schema["source_at"].dataType)
    rows = placed.select("source", "target", F.posexplode(F.array("source_at", "target_at", blank)).alias("part", "at"))
    return rows.select("source", "target", "part", "at.x", "at.y", "at.z")
