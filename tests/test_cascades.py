import random

import pytest
from pyspark.sql import functions as F

from spreadlab.operators import cascades, network
from spreadlab.operators.curves import cascade_curves
from spreadlab.plans.build import single_cascade
from spreadlab.plans.dataset import SocialDataset
from tests import brute
from tests.conftest import at, make_posts, post, rows

# Tree used by several cases: 0 -> 1 -> (2, 3), 2 -> (4, 5), 3 -> (6, 7).
EDGES = [(0, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7)]


def tree_posts(kinds=None):
    kinds = kinds or ["retweeted"] * len(EDGES)
    out = [post(0, "a0", at(0))]
    for (source, target), kind in zip(EDGES, kinds):
        out.append(post(target, f"a{target}", at(target), [(source, kind, f"a{source}", at(source))]))
    return out


def built(spark, data):
    return SocialDataset(make_posts(spark, data))


def test_closure_and_tree_of_a_known_cascade(spark):
    d = built(spark, tree_posts())
    expected = sorted((str(a), str(b)) for a, b in EDGES)
    assert rows(d.references, "source", "target") == expected
    assert rows(d.tree.edges, "parent", "child") == expected


def test_node_types(spark):
    kinds = ["retweeted", "quoted", "replied_to", "retweeted", "quoted", "replied_to", "retweeted"]
    d = built(spark, tree_posts(kinds))
    expected = sorted([("0", "original"), *[(str(t), k) for (_, t), k in zip(EDGES, kinds)]])
    assert rows(d.nodes, "post_id", "type") == expected


def test_curves_of_a_known_cascade(spark):
    d = built(spark, tree_posts())
    last = d.curves.orderBy(F.desc("created_at")).first()
    assert (last["size"], last["depth"], last["max_breadth"]) == (8, 3, 4)
    refs = [(str(a), str(b)) for a, b in EDGES]
    pairs = sum(sum(brute.distances(str(v), refs, directed=False).values()) for v in range(8))
    assert last["virality"] == pytest.approx(pairs / 64)


def test_single_node_cascades(spark):
    data = [post(0, "a", at(0)), post(1, "a", at(1), [(0, "quoted", "a", at(0))]), post(2, "b", at(2))]
    d = built(spark, data)
    # The only reference goes to the author's own post, so the tree stays a single node.
    assert rows(d.curves, "cascade_id", "size", "depth", "max_breadth", "virality") == [("0", 1, 0, 1, 0.0)]
    assert cascades.lone_node(d.posts, "2")["type"] == "original"
    with pytest.raises(LookupError):
        cascades.lone_node(d.posts, "nope")


def random_posts(seed, n=60, multi=0.0, ties=False, dangling=0.1):
    rng = random.Random(seed)
    out, when = [], {}
    authors = [f"a{i}" for i in range(9)]
    who = {}
    for i in range(n):
        when[i] = at(i // 3 if ties else i)
        who[i] = rng.choice(authors)
        if i < 3 or rng.random() < 0.15:
            out.append(post(i, who[i], when[i], None if rng.random() < 0.9 else []))
            continue
        refs = []
        for _ in range(2 if rng.random() < multi else 1):
            if rng.random() < dangling:
                refs.append((f"x{i}", rng.choice(["quoted", "replied_to"]), "stranger", at(-1) if rng.random() < 0.7 else None))
                continue
            earlier = [j for j in range(i) if when[j] < when[i]]
            j = rng.choice(earlier[-12:]) if earlier else 0
            if str(j) in [r[0] for r in refs]:
                continue
            refs.append((j, rng.choice(["retweeted", "quoted", "replied_to"]), who[j], when[j]))
        out.append(post(i, who[i], when[i], refs))
    return out


def network_of(data):
    posted = {p["author"]["id"] for p in data}
    return {
        (r["author"]["id"], p["author"]["id"])
        for p in data
        for r in p["referenced_tweets"] or []
        if r["author"]["id"] != p["author"]["id"] and r["author"]["id"] in posted
    }


def check(spark, data, group_rows=None):
    d = built(spark, data)
    pairs = network_of(data)
    assert set(rows(d.network.edges, "source", "target")) == pairs
    curves = d.curves if group_rows is None else cascade_curves(d.positions, d.tree, group_rows)
    got = {}
    for name, df, columns in (
        ("refs", d.references, ("source", "target", "type")),
        ("nodes", d.nodes, ("post_id", "author_id", "created_at", "type")),
        ("edges", d.tree.edges, ("parent", "child")),
        ("depth", d.positions, ("post_id", "depth")),
        ("curves", curves, ("created_at", "size", "depth", "max_breadth", F.round("virality", 9).alias("virality"))),
    ):
        for r in df.select("cascade_id", *columns).collect():
            got.setdefault(r[0], {}).setdefault(name, []).append(tuple(r[1:]))
    referenced = {r["id"] for p in data for r in p["referenced_tweets"] or []}
    roots = [p["id"] for p in data if p["referenced_tweets"] is None and p["id"] in referenced]
    assert set(got) == set(roots)
    for root in roots:
        _, refs = brute.closure(data, root)
        found = brute.nodes(data, root, refs)
        edges = brute.tree(root, found, refs, pairs)
        depth = {v: -1 for v in found}
        depth.update(brute.distances(root, edges))
        mine = got[root]
        assert sorted(mine.get("refs", [])) == sorted((r[0], r[1], r[2]) for r in refs)
        assert sorted(mine["nodes"]) == sorted((p, *v) for p, v in found.items())
        assert sorted(mine.get("edges", [])) == sorted(edges)
        assert sorted(mine["depth"]) == sorted(depth.items())
        assert sorted(mine["curves"]) == sorted((t, *v) for t, v in brute.curves(root, found, edges).items())


@pytest.mark.parametrize("seed", [1, 2])
def test_single_parent_cascades_match_brute_force(spark, seed):
    check(spark, random_posts(seed))


def test_several_parents_match_brute_force(spark):
    check(spark, random_posts(5, n=50, multi=0.4, dangling=0.25))


def test_equal_times_and_hot_groups_match_brute_force(spark):
    check(spark, random_posts(7, n=50, ties=True), group_rows=5)


def test_reference_cycles_end(spark):
    data = [
        post(0, "a", at(0)),
        post(1, "b", at(1), [(0, "replied_to", "a", at(0)), (2, "quoted", "c", at(2))]),
        post(2, "c", at(2), [(1, "replied_to", "b", at(1))]),
        post(3, "d", at(3), [(4, "quoted", "e", at(4))]),
        post(4, "e", at(4), [(3, "quoted", "d", at(3))]),
    ]
    posts = make_posts(spark, data)
    assert rows(cascades.members(posts), "cascade_id", "post_id") == [("0", "1"), ("0", "2")]
    roots = posts.where("id in ('0', '3')").select(F.col("id").alias("cascade_id"))
    assert rows(cascades.members_from(posts, roots), "cascade_id", "post_id") == [
        ("0", "1"),
        ("0", "2"),
        ("3", "3"),
        ("3", "4"),
    ]


def test_members_agree_with_level_walk(spark):
    for seed, multi in ((11, 0.0), (12, 0.5)):
        posts = make_posts(spark, random_posts(seed, n=80, multi=multi))
        roots = posts.where(F.col("referenced_tweets").isNull()).select(F.col("id").alias("cascade_id"))
        assert rows(cascades.members(posts)) == rows(cascades.members_from(posts, roots), "cascade_id", "post_id")


@pytest.mark.parametrize("length", [3, 9])
def test_repeated_rows_change_nothing(spark, length):
    chain = [post("0", "a0", at(0))]
    chain += [post(i, f"a{i}", at(i), [(i - 1, "quoted", f"a{i - 1}", at(i - 1))]) for i in range(1, length)]
    once, twice = (built(spark, data) for data in (chain, chain * 2))
    want = [("0", str(i)) for i in range(1, length)]
    assert rows(cascades.members(twice.posts)) == rows(cascades.members(once.posts)) == sorted(want)
    assert rows(twice.references) == rows(once.references)
    assert twice.references.count() == length - 1


def test_one_id_with_other_references_each_time(spark):
    data = [post("0", "a", at(0)), post("1", "b", at(0)), post("2", "c", at(2), [("0", "quoted", "a", at(0))])]
    data += [post("2", "c", at(2), [("1", "quoted", "b", at(0))]), post("3", "d", at(3), [("2", "retweeted", "c", at(2))])]
    found = rows(cascades.members(make_posts(spark, data)))
    assert found == [("0", "2"), ("0", "3"), ("1", "2"), ("1", "3")]


def test_long_chain(spark):
    n = 70
    data = [post(0, "a0", at(0))] + [
        post(i, f"a{i}", at(i), [(i - 1, "replied_to", f"a{i - 1}", at(i - 1))]) for i in range(1, n)
    ]
    last = built(spark, data).curves.orderBy(F.desc("created_at")).first()
    assert (last["size"], last["depth"], last["max_breadth"]) == (n, n - 1, 1)
    assert last["virality"] == pytest.approx(sum(abs(a - b) for a in range(n) for b in range(n)) / n**2)


def test_cascade_of_any_post(spark):
    data = tree_posts()
    posts = make_posts(spark, data)
    net = network.network(posts)
    part = single_cascade(posts, "2", net.edges)
    assert rows(part["nodes"], "post_id", "type") == [("2", "original"), ("4", "retweeted"), ("5", "retweeted")]
    assert part["curves"].orderBy(F.desc("size")).first()["size"] == 3
    with pytest.raises(LookupError):
        single_cascade(posts, "nope", net.edges)


def test_side_references_can_be_left_out(spark):
    data = [
        post(0, "a", at(0)),
        post(1, "b", at(1), [(0, "replied_to", "a", at(0)), ("out", "quoted", "z", at(-5))]),
    ]
    posts = make_posts(spark, data)
    belongs = cascades.members(posts)
    assert rows(cascades.cascade_references(posts, belongs), "source") == [("0",), ("out",)]
    assert rows(cascades.cascade_references(posts, belongs, side_references=False), "source") == [("0",)]


def test_sizes_and_ccdf(spark):
    data = [post(i, "a", at(0)) for i in range(3)] + [post(3, "s", at(0), suspect=True)]
    n = 10
    for target, count in ((0, 1), (1, 2), (2, 4), (3, 1)):
        for _ in range(count):
            data.append(post(n, "b", at(n), [(target, "retweeted", "a", at(0))]))
            n += 1
    posts = make_posts(spark, data)
    assert rows(cascades.cascade_sizes(posts), "cascade_id", "size") == [("0", 1), ("1", 2), ("2", 4), ("3", 1)]
    wide = {r["size"]: (r["Normal"], r["Suspect"]) for r in cascades.size_ccdf(posts).collect()}
    assert wide[1] == (pytest.approx(100.0), pytest.approx(100.0))
    assert wide[2][0] == pytest.approx(200 / 3) and wide[4][0] == pytest.approx(100 / 3)
    filled = {r["size"]: r["share"] for r in cascades.fill_ccdf(posts).collect() if r["user_type"] == "Normal"}
    assert filled == {1: 100.0, 2: pytest.approx(200 / 3), 4: 0.0}


def test_part_links_connect_what_edges_connect(spark):
    from spreadlab.operators.components import connected

    rng = random.Random(7)
    edges = [("c", str(rng.randrange(i)), str(i)) for i in range(1, 120) if rng.random() < 0.8]
    edges += [("c", str(rng.randrange(200, 230)), str(rng.randrange(60, 120))) for _ in range(15)]
    edges += [("c", "x1", "x2"), ("c", "x2", "x3"), ("c", "x3", "x1"), ("c", "x3", "x4"), ("c", "x4", "5"), ("c", "y", "y")]
    edges += [("d", "1", "2"), ("d", "2", "3")]
    df = spark.createDataFrame(edges, "cascade_id string, parent string, child string")
    links = cascades.part_links(df)
    # A chain that ends at one post has no links at all, and few other edges are left.
    assert links.where("u.cascade_id = 'd'").isEmpty()
    assert links.count() < len(set(edges)) / 2

    def groups(pairs):
        found = {}
        for r in connected(pairs).collect():
            found.setdefault(r["component"], set()).add(r["node"])
        return found

    def struct(name):
        return F.struct("cascade_id", F.col(name).alias("post_id"))

    whole = groups(df.select(struct("parent").alias("u"), struct("child").alias("v")))
    assert all(min(nodes) == label for label, nodes in whole.items())
    heads = {(c, p) for c, p, _ in edges} - {(c, v) for c, _, v in edges}
    wanted = {frozenset(n for n in nodes if n in heads) for nodes in whole.values()} - {frozenset()}
    got = {frozenset(n for n in nodes if n in heads) for nodes in groups(links).values()}
    got |= {frozenset([h]) for h in heads - set().union(*got)}
    assert {frozenset(map(tuple, g)) for g in got} - {frozenset()} == {frozenset(map(tuple, w)) for w in wanted}
