import random

import pytest
from pyspark.sql import functions as F

from spreadlab.operators import network
from spreadlab.operators.components import connected
from tests import brute
from tests.conftest import at, make_posts, post, rows


def reference_posts(pairs, kind="retweeted", tags=None):
    """One referencing post per (source author, target author), and a first post per author."""
    out = [post(f"o{a}", a, at(-10)) for a in sorted({x for p in pairs for x in p})]
    for i, (source, target) in enumerate(pairs):
        out.append(
            post(f"r{i}", target, at(24 * i), [(f"o{source}", kind, source, at(-10))], tags=(tags or {}).get(i, ()))
        )
    return out


# Authors 2, 3, 4, 3, 4 reference authors 1, 2, 3, 2, 1.
WEIGHTS = [(1, 2), (2, 3), (3, 4), (2, 3), (1, 4)]


def test_interaction_weights(spark):
    out = network.interactions(make_posts(spark, reference_posts(WEIGHTS)))
    assert rows(out) == [
        ("1", "2", 1, 1.0, 0.5),
        ("1", "4", 1, 1.0, 0.5),
        ("2", "3", 2, 0.5, 1.0),
        ("3", "4", 1, 1.0, 1.0),
    ]


def test_self_references_and_unknown_authors_are_left_out(spark):
    data = [
        post("a", 1, at(0)),
        post("b", 1, at(1), [("a", "quoted", 1, at(0))]),
        post("c", 2, at(2), [("a", "quoted", None, at(0))]),
        post("d", 2, at(3), [("x", "quoted", 9, at(0))]),
        post("e", 2, at(4), [("a", "liked", 1, at(0))]),
    ]
    net = network.network(make_posts(spark, data))
    assert rows(network.interactions(make_posts(spark, data)), "source", "target") == [("9", "2")]
    assert rows(net.edges) == []
    assert rows(net.vertices, "author_id") == [("1",), ("2",)]


def test_network_without_interactions_is_empty(spark):
    net = network.network(make_posts(spark, [post("a", 1, at(0)), post("b", 2, at(0))]))
    assert rows(net.vertices) == [] and rows(net.edges) == []


def test_date_window_excludes_its_end(spark):
    posts = make_posts(spark, reference_posts([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]))
    out = network.interactions(posts, start=at(24), end=at(72))
    assert rows(out, "source", "target", "weight") == [("2", "3", 1), ("3", "4", 1)]


def test_any_hashtag(spark):
    tags = {0: ("#a", "#b"), 1: ("#c", "#a"), 2: ("#b", "#c"), 3: ("#d", "#a"), 4: ("#c", "#d")}
    posts = make_posts(spark, reference_posts([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)], tags=tags))
    assert network.interactions(posts, hashtags=["#a"]).count() == 3


@pytest.fixture(scope="module")
def random_net(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(32)}
    pairs = sorted((a, b) for a, b in pairs if a != b)
    posts = make_posts(spark, reference_posts(pairs) + [post("lone", "lone", at(0))])
    return network.network(posts), [(str(a), str(b)) for a, b in pairs]


def test_components(random_net):
    net, pairs = random_net
    names = {r["author_id"] for r in net.vertices.collect()}
    expected = {v: min(part) for part in brute.components(names, pairs) for v in part}
    assert dict(rows(network.components(net))) == expected


def test_components_of_a_long_path_and_structs(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30], "a int, b int")
    key = F.struct(F.lit("c").alias("cascade"), F.col("a").alias("node"))
    other = F.struct(F.lit("c").alias("cascade"), F.col("b").alias("node"))
    found = connected(pairs.select(key.alias("u"), other.alias("v")))
    assert {(r["node"]["node"], r["component"]["node"]) for r in found.collect()} == {
        (i, 0 if i <= 30 else 31) for i in range(61)
    }


def test_ego_and_neighbours(random_net):
    net, pairs = random_net
    centre = pairs[0][0]
    for depth in (1, 2):
        near = {v for v, d in brute.distances(centre, pairs, directed=False).items() if d <= depth}
        part = network.ego(net, centre, depth)
        assert {r["author_id"] for r in part.vertices.collect()} == near
        assert set(rows(part.edges, "source", "target")) == {(a, b) for a, b in pairs if a in near and b in near}
    assert {r[0] for r in network.neighbours(net, centre).collect()} == {
        v for v, d in brute.distances(centre, pairs, directed=False).items() if d <= 1
    }
    assert network.neighbours(net, "nobody").count() == 0
    with pytest.raises(LookupError):
        network.ego(net, "nobody")


def test_bounded_ego_links_every_part(random_net):
    net, pairs = random_net
    centre = pairs[0][0]
    part = network.ego_for_display(net, centre, 3, max_edges=4)
    ends = rows(part.edges, "source", "target")
    names = {r["author_id"] for r in part.vertices.collect()}
    assert centre in names
    assert len(brute.components(names, ends)) == 1
    assert sum(w is not None for (w,) in rows(part.edges, "weight")) == 4


def test_backbone(spark):
    pairs = [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (2, 1), (3, 1)]
    net = network.network(make_posts(spark, reference_posts(pairs)))
    degree = {str(v): sum(v in p for p in pairs) for v in range(1, 5)}
    weight = {(str(a), str(b)): 1 / sum(x == a for x, _ in pairs) for a, b in pairs}
    alpha = {e: (1 - w) ** (degree[e[0]] - 1) for e, w in weight.items()}
    for threshold in (0.05, 0.2, 0.4):
        out = network.backbone(net, threshold)
        kept = {e for e, a in alpha.items() if a > threshold}
        assert set(rows(out.edges, "source", "target")) == kept
        assert {r["author_id"] for r in out.vertices.collect()} == {v for e in kept for v in e}
    assert network.backbone(net, 1.0).edges.count() == 0
    assert network.backbone(net, 0.0, max_edges=2).edges.count() == 2
    assert network.backbone(net, 1.0, delete_vertices=False).vertices.count() == 4


def test_mean_closeness(random_net):
    net, pairs = random_net
    scores = []
    for v in {x for p in pairs for x in p}:
        d = brute.distances(v, pairs, directed=False)
        scores.append((len(d) - 1) / sum(d.values()))
    expected = sum(scores) / len(scores)
    assert network.mean_closeness(net).first()[0] == pytest.approx(expected)
    assert network.mean_closeness(net, precision=8).count() == 1


def test_mean_closeness_counts_exactly(spark):
    leaves = 700
    ids = [str(i) for i in range(leaves + 1)]
    edges = spark.createDataFrame([(ids[0], x) for x in ids[1:]] + [("a", "b")], "source string, target string")
    expected = (1 + leaves * leaves / (1 + 2 * (leaves - 1)) + 2) / (leaves + 3)
    net = network.Network(None, edges)
    assert network.mean_closeness(net).first()[0] == pytest.approx(expected, rel=1e-12)
    # Components over the limit keep sketches.
    assert network.mean_closeness(net, bitmap_authors=2).first()[0] == pytest.approx(expected, rel=0.05)


def test_edge_positions(spark):
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    layout = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 4.0, 5.0, 6.0)], "author_id string, x double, y double, z double")
    out = network.edge_positions(edges, layout).orderBy("part").collect()
    assert [(r["x"], r["y"], r["z"]) for r in out] == [(1, 2, 3), (4, 5, 6), (None, None, None)]


@pytest.mark.parametrize("packed", [1, 1 << 19])
def test_mean_closeness_sends_links_not_sets(spark, monkeypatch, packed):
    """Components of all sizes at once: a chain over several words, stars, a circle, pairs; a loop and both directions too."""
    monkeypatch.setattr(network, "PACKED_LINKS", packed)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(149)]
    stars = [(f"s{k}", f"s{k}x{i}") for k in range(3) for i in range(20 + k)]
    pairs = [(f"p{i}", f"q{i}") for i in range(30)]
    links = [*chain, *stars, *pairs, ("o1", "o2"), ("o2", "o3"), ("o3", "o4"), ("o4", "o1"), ("o1", "o1"), ("o2", "o1")]
    names = sorted({a for link in links for a in link})
    distances = [brute.distances(a, links, directed=False) for a in names]
    expected = sum((len(d) - 1) / sum(d.values()) for d in distances) / len(names)
    net = network.Network(spark.createDataFrame([(a, a) for a in names], "author_id string, username string"), spark.createDataFrame(links, "source string, target string"))

    def by_rounds(numbered, links, real=network._by_bitmaps):
        called.append(numbered.count())
        return real(numbered, links)

    called = []
    monkeypatch.setattr(network, "_by_bitmaps", by_rounds)
    assert network.mean_closeness(net).first()[0] == pytest.approx(expected, rel=1e-12) and not called
    if packed == 1:
        # Those with more links than a task takes up go through rounds of joins: the chain alone.
        assert network.mean_closeness(net, task_links=100).first()[0] == pytest.approx(expected, rel=1e-12) and called == [150]
