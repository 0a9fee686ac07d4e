"""Building and saving the derived tables of a dataset, and reading stored results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.operators import activity, cascades, network
from spreadlab.operators.posts import normalise_bounds
from spreadlab.plans.dataset import SocialDataset
from spreadlab.sources.store import Store

# Each module writes its tables; later modules read what earlier ones built.
TABLES: dict[str, dict[str, Callable[[SocialDataset], DataFrame]]] = {
    "network": {
        "hidden_network_edges": lambda d: d.network.edges,
        "hidden_network_vertices": lambda d: d.network.vertices,
        "backbone": lambda d: network.backbone_edges(d.network.edges),
    },
    "cascades": {
        "cascade_references": lambda d: d.references,
        "cascade_nodes": lambda d: d.nodes,
        "cascade_edges": lambda d: d.tree.edges,
        "cascade_positions": lambda d: d.positions,
        "diffusion_metrics": lambda d: d.curves,
    },
    "cascade_statistics": {
        "size_cascade_ccdf": lambda d: cascades.size_ccdf(d.posts),
        "cascade_count_over_time": lambda d: activity.cascade_count_over_time(d.posts),
    },
    "standing": {
        "network_metrics": lambda d: d.standing,
        "reputation": lambda d: d.runs.reputation(),
        "status": lambda d: d.runs.status(),
    },
    "activity": {
        "tweet_time_series": lambda d: activity.post_histogram(d.posts),
        "user_time_series": lambda d: activity.author_histogram(d.posts),
    },
    "hashtags": {"hashtag_freqs": lambda d: activity.hashtag_counts(d.posts)},
    "board": {"tweet_table": lambda d: d.board},
}
KEYED = {
    "cascade_references": ("cascade_id",),
    "cascade_nodes": ("cascade_id",),
    "cascade_edges": ("cascade_id",),
    "cascade_positions": ("cascade_id",),
    "diffusion_metrics": ("cascade_id",),
    "reputation": ("author_id",),
    "status": ("author_id",),
}


def build(store: Store, name: str, data: SocialDataset, modules: Sequence[str] = tuple(TABLES)) -> list[str]:
    """Compute and replace the tables of the chosen modules; the names written."""
    written = []
    for module in modules:
        for table, make in TABLES[module].items():
            store.save_table(make(data), name, table, cluster_by=KEYED.get(table, ()))
            written.append(table)
    return written


def series(store: Store, dataset: str, kind: str = "tweet", hashtags=(), start=None, end=None, unit: str = "day", size: int = 1) -> DataFrame:
    """A histogram: the stored one when no filter remains and it exists, otherwise computed."""
    posts = store.raw(dataset)
    start, end = normalise_bounds(posts, start, end)
    if not (start or end or hashtags or unit != "day" or size != 1):
        try:
            return store.load_table(dataset, f"{kind}_time_series")
        except LookupError:
            pass
    make = activity.post_histogram if kind == "tweet" else activity.author_histogram
    return make(posts, hashtags, start, end, unit, size)


def stored_network(store: Store, dataset: str, start=None, end=None, hashtags=()) -> network.Network:
    """The stored network when no filter remains, otherwise the network of the window."""
    posts = store.raw(dataset)
    start, end = normalise_bounds(posts, start, end)
    if not (start or end or hashtags):
        try:
            return network.Network(
                store.load_table(dataset, "hidden_network_vertices"), store.load_table(dataset, "hidden_network_edges")
            )
        except LookupError:
            pass
    return network.network(posts, start=start, end=end, hashtags=hashtags)


def cascade(store: Store, dataset: str, cascade_id: str, recompute: bool = True) -> dict[str, DataFrame]:
    """Nodes, edges and curves of one cascade, stored or recomputed."""
    names = {"nodes": "cascade_nodes", "edges": "cascade_edges", "curves": "diffusion_metrics"}
    try:
        found = {k: store.load_table(dataset, t).where(F.col("cascade_id") == cascade_id) for k, t in names.items()}
        if not found["nodes"].isEmpty():
            return found
    except LookupError:
        pass
    if not recompute:
        raise LookupError(f"diffusion metrics of cascade {cascade_id} not found")
    return single_cascade(store.raw(dataset), cascade_id, stored_network(store, dataset).edges)


def single_cascade(posts: DataFrame, cascade_id: str, edges: DataFrame) -> dict[str, DataFrame]:
    """Tree and curves of the cascade that starts at any one post."""
    from spreadlab.operators.curves import cascade_curves
    from spreadlab.session import settle

    cascades.get_post(posts, cascade_id)
    root = posts.where(F.col("id") == cascade_id).select(F.col("id").alias("cascade_id")).limit(1)
    refs = settle(cascades.cascade_references(posts, cascades.members_from(posts, root)), "references")
    nodes = settle(cascades.cascade_nodes(posts, refs, root), "nodes")
    tree = cascades.cascade_tree(nodes, refs, edges)
    tree = cascades.Tree(settle(tree.edges, "tree"), tree.tangled)
    return {"nodes": nodes, "edges": tree.edges, "curves": cascade_curves(cascades.cascade_positions(nodes, tree), tree)}
