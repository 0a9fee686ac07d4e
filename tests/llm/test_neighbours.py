import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlab.llm import neighbours as N


def brute(rows, asked, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, set()).add(tuple(np.float32(v).astype(float)))
    out = {}
    for q in sorted(good):
        if asked(q):
            near = [(min(math.dist(a, b) for a in good[q] for b in vs if len(a) == len(b)), i) for i, vs in good.items() if i != q and any(len(a) == len(b) for a in good[q] for b in vs)]
            out[q] = sorted(near)[:k]
    return out


def made(n, size, seed):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(8, size))
    rows = [(i, (centres[i % 8] + dice.normal(scale=0.4, size=size)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)]  # copies
    rows += [(10_000, None), (10_010, [0.0] * size), (10_020, [float("nan")] * size), (10_030, [None] + [1.0] * (size - 1)), (10_040, [float("inf")] * size), (None, rows[0][1])]
    return rows + [rows[0], rows[10], (20, rows[21][1]), (10_050, [1.0, 2.0]), (10_060, [1.0, 2.5]), (10_070, [])]


@pytest.mark.parametrize("block, group", [(16384, 1024), (60, 7)])
def test_recall_and_order(spark, block, group):
    rows = made(400, 16, 1)
    vectors = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, score int")
    found = N.nearest(vectors, N.F.col("vec_id") % 10 == 0, block=block, group=group).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows, lambda q: q % 10 == 0, 10)
    assert set(got) == {q for q, some in want.items() if some}
    hits = 0
    for q, some in got.items():
        some.sort()
        assert [r for r, _, _ in some] == list(range(1, len(want[q]) + 1))
        assert [(s, i) for _, s, i in some] == sorted((s, i) for _, s, i in some)
        exact = dict((i, s) for s, i in brute(rows, lambda x, q=q: x == q, 10**6)[q])
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, s, i in some)
        hits += len({i for _, _, i in some} & {i for _, i in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_ties_go_to_smaller_ids(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i > 50)]) for i in range(100)], "vec_id long, embedding array<float>")
    found = N.nearest(vectors, N.F.col("vec_id") == 60, block=20).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(51, 60)) + [61]


def test_few_or_no_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (1, [3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in N.nearest(vectors, N.F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]
    assert N.nearest(vectors, N.F.lit(False)).count() == 0
    assert N.nearest(vectors.limit(0), N.F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [1e-200, 1e-310, 1e200, 1e290])
def test_very_small_and_large_components(spark, size):
    random = np.random.default_rng(4)
    plain = random.integers(-50, 50, (60, 6)) / 64
    rows = [(i, [float(x) * size for x in v]) for i, v in enumerate(plain)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in N.nearest(vectors, F.col("vec_id") % 20 == 0, k=5).collect()}
    for q in (0, 20, 40):
        away = np.sqrt(((plain - plain[q]) ** 2).sum(axis=1))
        order = [i for i in np.argsort(away, kind="stable") if i != q][:5]
        for rank, i in enumerate(order, 1):
            assert found[q, rank][1] == pytest.approx(away[i] * size, rel=1e-6)
