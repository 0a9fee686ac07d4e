"""Distances in long and in tangled cascades."""

import random

import pytest
from pyspark.sql import functions as F

from spreadlab.operators import cascades, curves, distances
from spreadlab.operators.cascades import Tree, cascade_positions
from spreadlab.operators.curves import cascade_curves
from spreadlab.session import settle
from tests import brute
from tests.conftest import at


def cascade(spark, n, edges, when=None):
    """Positions and tree of cascade '0' with posts '0' to 'n - 1'."""
    when = when or (lambda i: at(i))
    nodes = spark.createDataFrame([("0", str(i), when(i)) for i in range(n)], "cascade_id string, post_id string, created_at timestamp")
    rows = [("0", str(a), str(b)) for a, b in edges]
    tree = settle(spark.createDataFrame(rows, "cascade_id string, parent string, child string"), "tree")
    several = {b for _, b in edges if sum(y == b for _, y in edges) > 1} if n < 500 else set()
    tangled = spark.createDataFrame([("0",)], "cascade_id string") if several else None
    tree = Tree(tree, tangled)
    return settle(cascade_positions(nodes, tree), "positions"), tree


def same_as_brute(positions, tree, n, edges, when=None, **options):
    when = when or (lambda i: at(i))
    found = {str(i): (None, when(i), None) for i in range(n)}
    wanted = brute.curves("0", found, {(str(a), str(b)) for a, b in edges})
    got = {r["created_at"]: r for r in cascade_curves(positions, tree, **options).collect()}
    assert set(got) == set(wanted)
    for time, (size, depth, _, virality) in wanted.items():
        r = got[time]
        assert (r["size"], r["depth"]) == (size, depth) and r["virality"] == pytest.approx(virality, abs=1e-8)


@pytest.mark.parametrize("group_rows", [4, 100_000])
def test_long_trees(spark, monkeypatch, group_rows):
    monkeypatch.setattr(cascades, "LONGEST_PATH", 2)
    rng = random.Random(group_rows)
    n = 45
    edges = [(max(0, i - rng.randrange(1, 5)), i) for i in range(1, n)]
    when = lambda i: at(i // 2)
    positions, tree = cascade(spark, n, edges, when)
    assert [r["kind"] for r in curves._kinds(positions, None, None).collect()] == ["long"]
    same_as_brute(positions, tree, n, edges, when, group_rows=group_rows)


def test_heavy_paths(spark):
    edges = [(0, 1), (1, 2), (2, 3), (0, 4), (4, 5), (1, 6)]
    rows = spark.createDataFrame([("0", str(a), str(b)) for a, b in edges], "cascade_id string, parent string, child string")
    sizes = {r["post_id"]: r["size"] for r in distances.subtree_sizes(rows).collect()}
    assert sizes == {"0": 7, "1": 4, "2": 2, "3": 1, "4": 2, "5": 1, "6": 1}
    found = {r["post_id"]: (r["head"], r["covered"], r["onward"]) for r in distances.heavy_paths(rows).collect()}
    assert found["3"] == ("0", 3, None) and found["0"] == ("0", 0, None)
    assert found["5"] == ("4", 2, "0") and found["6"] == ("6", 1, "1")


def test_thread_of_ten_thousand(spark, monkeypatch):
    n = 10_000
    rounds = []
    settled = cascades.settle
    monkeypatch.setattr(cascades, "settle", lambda df, name="step", **k: (rounds.append(name), settled(df, name, **k))[1])
    positions, tree = cascade(spark, n, [(i - 1, i) for i in range(1, n)])
    assert rounds.count("pointers") <= 17
    deep = positions.agg(F.max("depth"), F.sum(F.greatest(F.size("path"), F.lit(0)))).first()
    assert deep[0] == n - 1 and deep[1] <= n * cascades.LONGEST_PATH
    last = cascade_curves(positions, tree).orderBy(F.desc("created_at")).first()
    assert last["virality"] == pytest.approx((n * n - 1) / 3 / n) and last["max_breadth"] == 1
    paths = distances.heavy_paths(tree.edges)
    assert paths.select("head").distinct().count() == 1


def kinds(positions, tree):
    _, left_out = distances.spanning_positions(positions, tree.edges)
    return [r["kind"] for r in curves._kinds(positions, tree.tangled, left_out).collect()]


@pytest.mark.parametrize("seed", [3, 4])
def test_tangled(spark, seed):
    rng = random.Random(seed)
    n = 30
    edges = [(rng.randrange(i), i) for i in range(1, n)]
    edges += [(a, b) for a, b in {(rng.randrange(b), b) for b in rng.sample(range(2, n), 5)} if (a, b) not in edges]
    # Posts from outside, which the root does not reach: one above two posts, one above that one.
    edges += [(n, 5), (n, 9), (n + 1, n)]
    n += 2
    when = lambda i: at((i * 7) % n)  # noqa: E731  (posts may come before their parents)
    positions, tree = cascade(spark, n, edges, when)
    assert kinds(positions, tree) == ["tangled"]
    same_as_brute(positions, tree, n, edges, when)


def test_long_and_tangled_is_walked(spark, monkeypatch):
    for module in (cascades, distances):
        monkeypatch.setattr(module, "LONGEST_PATH", 2)
    edges = [(i - 1, i) for i in range(1, 9)] + [(0, 8)]
    positions, tree = cascade(spark, 9, edges)
    assert kinds(positions, tree) == ["walked"]
    same_as_brute(positions, tree, 9, edges)


def test_star_with_one_circle(spark):
    n = 400
    edges = [(0, i) for i in range(1, n)] + [(1, n - 1)]
    positions, tree = cascade(spark, n, edges)
    blocks = distances.Blocks(distances.spanning_positions(positions, tree.edges)[0], tree.edges)
    # Whatever the star's size, only the circle is walked.
    assert blocks.members.count() == 3 and blocks.apart().count() == 9
    last = cascade_curves(positions, tree).orderBy(F.desc("created_at")).first()
    total = 2 * (n - 1) + 2 * (n - 1) * (n - 2) - 2
    assert last["virality"] == pytest.approx(total / n / n)


def test_least_depths(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(max(0, i - 4), i), i) for i in range(1, 60)]
    edges += [(rng.randrange(b), b) for b in range(10, 60, 7)] + [(70, 71), (71, 70), (72, 5)]
    rows = spark.createDataFrame([("0", str(a), str(b)) for a, b in edges], "cascade_id string, parent string, child string")
    found = {r["post_id"]: r["depth"] for r in cascades._least_depths(rows).collect()}
    assert found == brute.distances("0", [(str(a), str(b)) for a, b in edges])
