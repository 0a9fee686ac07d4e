import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlab.operators.prefix import quantiles, running
from spreadlab.operators.reports import distribution_summary
from tests.conftest import rows


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    data, seen = [], set()
    for _ in range(400):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}"
        spot = rng.randrange(5000)
        if (key, spot) not in seen:
            seen.add((key, spot))
            data.append((key, spot, rng.randrange(100)))
    return data


@pytest.mark.parametrize("limit", [30, 10_000])
def test_running_matches_loop(spark, numbers, limit):
    df = spark.createDataFrame(numbers, "k string, t int, v int")
    out = running(df, ["k"], ["t"], sums={"s": "v"}, maxes={"m": "v"}, previous={"p": "v"}, group_rows=limit)
    expected = []
    for key in {n[0] for n in numbers}:
        total, top, last = 0, None, None
        for _, t, v in sorted(n for n in numbers if n[0] == key):
            total += v
            top = v if top is None else max(top, v)
            expected.append((key, t, v, total, top, last))
            last = v
    assert rows(out, "k", "t", "v", "s", "m", "p") == sorted(expected, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_running_max_skips_nulls_across_slices(spark):
    data = [("a", i, i * 10 if i % 7 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t int, v int")
    out = running(df, ["k"], ["t"], maxes={"m": "v"}, group_rows=30)
    assert {r["t"]: r["m"] for r in out.collect()} == {i: (i // 7) * 70 for i in range(200)}


@pytest.mark.parametrize("limit", [20, 10_000])
def test_quantiles_match_numpy(spark, numbers, limit):
    df = spark.createDataFrame(numbers, "k string, t int, v int").withColumn("v", F.col("v").cast("double"))
    out = quantiles(df, ["k"], "v", {"q1": 1 / 3, "q5": 0.5, "q9": 0.93}, group_rows=limit)
    for r in out.collect():
        values = [n[2] for n in numbers if n[0] == r["k"]]
        assert r["n"] == len(values)
        assert r["q5"] == pytest.approx(statistics.median(values))
        assert r["q1"] == pytest.approx(np.quantile(values, 1 / 3))
        assert r["q9"] == pytest.approx(np.quantile(values, 0.93))


def test_global_quantile(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert quantiles(df, [], "v", {"m": 0.25}, group_rows=30).first()["m"] == 25.0


def test_sketched_quantiles_stay_within_their_error(spark):
    rng = random.Random(4)
    data = [("a", rng.choice([1, 5, rng.randrange(10**6)])) for _ in range(30_000)] + [("b", 7), ("c", None), (None, 3)]
    frame = spark.createDataFrame(data, "kind string, x bigint").repartition(7)
    for error in (0.001, 0.05):
        found = {(r["kind"], r["share"]): r for r in distribution_summary(frame, ["kind"], "x", (0.1, 0.5, 0.99), error).collect()}
        assert {k for k, _ in found} == {"a", "b"} and len(found) == 6
        assert all(r["rank_error"] <= error for r in found.values())
        values = sorted(x for k, x in data if k == "a")
        for share in (0.1, 0.5, 0.99):
            assert found["a", share]["exact"] == pytest.approx(np.quantile(values, share))
    assert found["b", 0.5]["exact"] == found["b", 0.5]["sketched"] == 7 and found["b", 0.5]["n"] == 1
