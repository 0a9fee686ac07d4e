import random

import pytest
from pyspark.sql import functions as F

from spreadlab.operators import standing
from tests.conftest import at, make_posts, post, rows


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    authors = [f"a{i}" for i in range(12)]
    out = [post(f"o{a}", a, at(rng.randrange(200))) for a in authors[:9]]
    for i in range(150):
        ref = rng.choice(authors if rng.random() < 0.8 else authors[:2])
        refs = [(f"o{ref}", "quoted", None if rng.random() < 0.05 else ref, at(0))]
        out.append(post(i, rng.choice(authors[:9]), at(rng.randrange(24 * 9)), refs if rng.random() < 0.9 else []))
    return out


def received(data):
    return [(p["created_at"].date(), r["author"] and r["author"]["id"]) for p in data for r in p["referenced_tweets"] or []]


def test_legitimacy_counts_posting_authors_only(spark, data):
    got = dict(rows(standing.legitimacy(make_posts(spark, data))))
    refs = [a for _, a in received(data)]
    assert got == {a: refs.count(a) for a in {p["author"]["id"] for p in data}}


def test_reputation_status_and_means(spark, data):
    posts = make_posts(spark, data)
    refs = received(data)
    days = sorted({d for d, _ in refs})
    authors = {p["author"]["id"] for p in data}
    reputation = {(a, d): sum(1 for e, b in refs if b == a and e <= d) for a in authors for d in days}
    status = {(a, d): sum(reputation[b, d] < reputation[a, d] for b in authors) for a in authors for d in days}
    runs = standing.Runs(posts)
    assert {(r[0], r[1].date()): r[2] for r in runs.reputation().collect()} == reputation
    assert {(r[0], r[1].date()): r[2] for r in runs.status().collect()} == status
    for r in runs.means().collect():
        assert r["average_reputation"] == pytest.approx(sum(reputation[r["author_id"], d] for d in days) / len(days))
        assert r["average_status"] == pytest.approx(sum(status[r["author_id"], d] for d in days) / len(days))
    view = standing.standing_view(posts).collect()
    assert {a: len(v) for a, v in ((r["author_id"], r["status"]) for r in view)} == {a: len(days) for a in authors}


def test_no_references_is_an_error(spark):
    with pytest.raises(ValueError):
        standing.Runs(make_posts(spark, [post("a", 1, at(0))]))


def levels(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, m double")
    return [r["m_level"] for r in standing.add_levels(df, ["m"]).orderBy("i").collect()]


def test_thirds(spark):
    got = levels(spark, [None, *[i / 10 for i in range(11)]])
    assert got == ["Null", "Null", "Low", "Low", "Low", "Medium", "Medium", "Medium", *["High"] * 4]
    assert levels(spark, [float(i) for i in range(1, 11)]) == [*["Low"] * 3, *["Medium"] * 3, *["High"] * 4]


def test_repeated_edges_give_fewer_levels(spark):
    assert levels(spark, [1.0, 1.0, 1.0, 5.0, 5.0]) == ["Low", "Low", "Low", "High", "High"]
    assert levels(spark, [1.0, 1.0, 1.0, 1.0, 5.0]) == ["Low"] * 5
    assert levels(spark, [2.0, 2.0, 0.0]) == ["Low", "Low", "Null"]
    assert levels(spark, [0.0, None]) == ["Null", "Null"]


def test_metadata_and_crosstab(spark, data):
    posts = make_posts(spark, data + [post("x", "s", at(1), suspect=True, party="P"), post("y", "s", at(2))])
    scores = standing.standing(posts)
    meta = standing.actor_metadata(posts, scores)
    row = meta.where("author_id = 's'").first()
    assert (row["user_type"], row["is_usual_suspect"], row["party"]) == ("Suspect politician", True, "P")
    total = standing.standing_crosstab(meta).agg(F.sum("authors")).first()[0]
    assert total == meta.count()
    assert standing.standing_crosstab(meta, without_normal=True).agg(F.sum("authors")).first()[0] == 1
    asked = spark.createDataFrame([("s", "us"), ("new", "nu"), ("gone", None)], "author_id string, username string")
    kinds = {r["author_id"]: r["user_type"] for r in standing.metadata_for(asked, meta).collect()}
    assert kinds == {"s": "Suspect politician", "new": "Normal", "gone": "Unknown"}
    assert standing.legitimacy_of(scores, "a1") >= 0
    with pytest.raises(LookupError):
        standing.legitimacy_of(scores, "nobody")
