import bisect
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from spreadlab.operators import boosting, classifier, encoding, growth, pairs
from spreadlab.operators.network import undirected
from spreadlab.plans import catalogue, demo
from tests.conftest import SF, rows


@pytest.fixture(scope="module")
def d(spark):
    return demo.dataset(spark, SF)


@pytest.fixture(scope="module")
def training(spark):
    data = [(float(i % 10), "ab"[i % 2] if i % 7 else None, None if i % 5 == 0 else float(i), None, int(i % 10 > 6)) for i in range(200)]
    return spark.createDataFrame(data, "`x.one` double, kind string, noise double, blank double, propagated int").cache()


def test_modes(training):
    got = classifier.modes(training, ["x.one", "kind", "blank"])
    assert got == {"x.one": 0.0, "kind": "a"} or got == {"x.one": 0.0, "kind": "b"}


def test_fit_predict_and_report(spark, training, tmp_path):
    model = classifier.PropagationModel()
    with pytest.raises(RuntimeError):
        model.predict(training)
    model.fit(training)
    assert model.score(training) == 1.0
    assert model.importances(1)[0][0] == "x.one"
    scored = model.predict(training.drop("noise"))
    assert scored.where(F.size("probability") == 2).count() == 200
    metrics = classifier.classification_metrics(model.predict(training)).first()
    assert (metrics["accuracy"], metrics["f1_score"], metrics["propagation_support"]) == (1.0, 1.0, 60)
    _, report = classifier.performance(training)
    assert {r["part"] for r in report.collect()} == {"train", "test"}
    model.save(str(tmp_path / "m"))
    loaded = classifier.PropagationModel.load(spark, str(tmp_path / "m"))
    assert (loaded.texts, loaded.numbers, loaded.fills, loaded.rounds) == (model.texts, model.numbers, model.fills, model.rounds)
    assert rows(loaded.predict(training)) == rows(model.predict(training))
    assert loaded.importances(1) == model.importances(1)
    with pytest.raises(ValueError):
        classifier.PropagationModel().fit(training.where("propagated = 1"))


def test_frequent_values_and_buckets(spark):
    data = [("a" if i % 2 else f"rare {i}", None, f"t{i}") for i in range(300)] + [(None, None, "t1")]
    frame = spark.createDataFrame(data, "`k.1` string, empty string, free string")
    found = encoding.frequent_values(frame, frame.columns, share=10)
    assert found == {"k.1": ["a"], "empty": [], "free": []}
    assert encoding.frequent_values(frame, []) == {} and encoding.frequent_values(frame.limit(0), ["free"]) == {"free": []}
    code = encoding.Encoder(share=10, width=4).fit(frame, frame.columns)
    assert code.texts == ["k.1", "free"] and len(code.names()) == 1 + 4 + 4
    got = code.fit_scales(frame).encoded(frame, ["k.1"]).collect()
    assert all(len(r["features"]) == 2 for r in got)
    # The null takes the mode; two rows of one value meet in one feature.
    slots = {r["k.1"]: {e["feature"] for e in r["features"] if e["feature"].startswith("k.1")} for r in got}
    assert slots["a"] == slots[None] == {"k.1=a"} and slots["rare 2"] < {f"k.1#{k}" for k in range(4)}
    assert code.encoded(spark.createDataFrame([(1,)], "other int")).first()["features"]


def test_numbers_are_scaled_without_centring(spark):
    frame = spark.createDataFrame([(0.0, 5.0), (4.0, 5.0), (float("nan"), 5.0), (None, 5.0)], "x double, same double")
    code = encoding.Encoder().fit(frame.where("not isnan(x) or x is null"), ["x", "same"]).fit_scales(frame)
    got = [{e["feature"]: e["value"] for e in r["features"]} for r in code.encoded(frame).collect()]
    assert got == [{"same": 5.0}, {"same": 5.0, "x": pytest.approx(4 / 3**0.5)}, {"same": 5.0}, {"same": 5.0}]


def test_first_split_is_the_best_of_all(spark):
    """Every cut of every feature by hand, in whole rows; nulls, a rare flag and a tie among them."""
    data = [(float(i % 7), float(i == 3), None if i % 4 else "x", int(i % 7 in (1, 2) or i == 3)) for i in range(60)]
    frame = spark.createDataFrame(data, "n double, flag double, kind string, propagated int")
    model = classifier.PropagationModel(rounds=1, depth=1).fit(frame)
    tree, names = model.model.trees[0], model.encoder.names()
    positives = sum(d[3] for d in data)
    weight = (60 - positives) / positives
    rows_ = [(d[0], d[1], weight * -0.5 if d[3] else 0.5, (weight if d[3] else 1) * 0.25) for d in data]

    def part(some):
        g, h = sum(r[2] for r in some), sum(r[3] for r in some)
        return g * g / (h + 1), h

    options = []
    for name, i in (("flag", 1), ("n", 0)):
        for cut in sorted({r[i] for r in rows_})[:-1]:
            (a, ha), (b, hb) = part([r for r in rows_ if r[i] <= cut]), part([r for r in rows_ if r[i] > cut])
            if min(ha, hb) >= 1:
                options.append((round(a + b - part(rows_)[0], 3), name, cut))
    best = max(options, key=lambda o: o[0])
    f, b, gain = tree.splits[0]
    assert (names[f], model.model.cuts[names[f]][b]) == best[1:] and gain == pytest.approx(best[0], abs=2e-3)
    assert set(tree.leaves) == {1, 2}


def test_margins_follow_the_bins(spark):
    """Scoring by values walks the trees as a loop over bins does; the label follows a hashed text and a number."""
    data = [(float(i * 7 % 90), f"v{i % 150}", i % 50 == 0, int((i % 150) % 3 == 0 or i * 7 % 90 > 70)) for i in range(900)]
    frame = spark.createDataFrame(data, "`a b` double, text string, flag boolean, propagated int")
    model = classifier.PropagationModel(rounds=2).fit(frame)
    assert model.encoder.frequent["text"] == [] and any("text#" in name for name, _ in model.importances())
    names, cuts = model.encoder.names(), model.model.cuts

    def walked(number, text, flag):
        total = 0.0
        for tree in model.model.trees:
            node = 0
            while node in tree.splits:
                f, b, _ = tree.splits[node]
                value = {"a b": number, "flag": float(flag)}.get(names[f])
                if value is None:
                    bin_ = int(names[f] == f"text#{int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 32}")
                else:
                    bin_ = bisect.bisect_left(cuts[names[f]], value)
                node = 2 * node + (1 if bin_ <= b else 2)
            total += tree.leaves[node]
        return total

    scored = model.model.scored(frame, model.encoder).collect()
    assert [r["margin"] for r in scored] == pytest.approx([walked(r["a b"], r["text"], r["flag"]) for r in scored])
    assert len({r["margin"] for r in scored}) > 2
    clash = frame.withColumn("_used", F.lit(1)).withColumn("prediction", F.lit("x"))
    assert rows(model.predict(clash).select("prediction")) == rows(model.predict(frame).select("prediction"))
    assert model.predict(frame.limit(0)).count() == 0
    assert boosting.cut_points(frame, model.encoder)["flag"] == [0.0]


def test_rows_are_coded_once_and_gradients_never_stored(spark, monkeypatch):
    """A byte per column is all that the rounds read; before, every round wrote the rows again."""
    kept = []

    def settle(df, name="step", real=boosting.settle):
        kept.append((name, real(df, name)))
        return kept[-1][1]

    monkeypatch.setattr(boosting, "settle", settle)
    data = [(float(i * 7 % 90), f"v{i % 150}", None, int(i % 3 == 0)) for i in range(900)]
    frame = spark.createDataFrame(data, "n double, text string, blank double, propagated int")
    classifier.PropagationModel(rounds=3).fit(frame)
    assert [name for name, _ in kept] == ["binned"]
    assert {len(r["codes"]) for r in kept[0][1].collect()} == {2}


def test_cut_points_are_exact_beyond_ten_thousand_rows(spark):
    rows_ = 40_000
    frame = spark.range(rows_).select(
        (F.col("id") * 7919 % rows_).cast("double").alias("x"), F.when(F.col("id") % 4 == 0, F.col("id") % 1000).alias("y"), (F.col("id") % 2).alias("z")
    )
    code = encoding.Encoder().fit(frame, ["x", "y", "z"])
    got = boosting.cut_points(frame, code)
    assert got["x"] == [0.0, *[float(rows_ * k // 32 - 1) for k in range(1, 32)]]
    # Three quarters are null and take the mode, which is the smallest of equals.
    filled = sorted([0] * (rows_ * 3 // 4) + [i % 1000 for i in range(0, rows_, 4)])
    assert got["y"] == sorted({float(filled[0]), *[float(filled[rows_ * k // 32 - 1]) for k in range(1, 32)]}) and got["z"] == [0.0, 1.0]


@pytest.mark.parametrize("weight", [1.0, 2.0**38])
def test_sums_of_gradients_are_whole(spark, monkeypatch, weight):
    """Also where doubles would not add them up exactly, and after a tree with an inner node that is no longer active."""
    monkeypatch.setattr(boosting, "BLOCK", 64)
    data = [(float(i % 5), "ab"[i % 3 == 0], i % 7 == 0) for i in range(500)]
    frame = spark.createDataFrame(data, "n double, text string, hit boolean").repartition(3)
    code = encoding.Encoder().fit(frame, ["n", "text"])
    columns = boosting.Columns(code, boosting.cut_points(frame, code))
    state = columns.coded(frame, code, F.col("hit"), F.lit(weight))
    names = code.names()
    tree = boosting.Tree({0: (names.index("n"), 1, 1.0)})
    before = boosting.Tree({}, {0: 0.5})
    chance = 1 / (1 + math.exp(-0.5))
    expected = {}
    for n, text, hit in data:
        if n <= 1:
            continue
        g = math.floor(weight * (chance - hit) * 65536 + 0.5)
        for key in ((2, names.index("n"), int(n)), (2, names.index(f"text={text}"), 1)):
            expected[key] = expected.get(key, 0) + g
    got = columns.sums(state, [before], tree, [2]).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    assert {(r["node"], r["f"], r["b"]): r["g"] for r in got} == expected and all(r["h"] > 0 for r in got)


def test_metrics_by_hand(spark):
    cells = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(1, 1)] * 2
    got = classifier.classification_metrics(spark.createDataFrame(cells, "propagated int, prediction int")).first()
    assert got["accuracy"] == pytest.approx(0.7)
    assert got["precision"] == pytest.approx((5 / 7 + 2 / 3) / 2)
    assert got["recall"] == pytest.approx((5 / 6 + 2 / 4) / 2)
    assert got["f1_score"] == pytest.approx((10 / 13 + 4 / 7) / 2)


def test_split_is_stable(training):
    train, test = classifier.hash_split(training)
    assert train.count() + test.count() == 200
    again = classifier.hash_split(training.repartition(3))[1]
    assert rows(test) == rows(again)
    assert 0 < classifier.hash_split(training, 0.3, keys=["noise"])[1].count() < 200


def test_pairs(d):
    eligible = pairs.eligible_cascades(d.posts, d.profiles, d.text_scores)
    positives = pairs.positive_pairs(eligible, d.nodes, d.tree.edges).cache()
    tree = d.tree.edges.join(eligible, "cascade_id", "left_semi").distinct().count()
    assert positives.count() == 2 * tree
    assert pairs.positive_pairs(eligible, d.nodes, d.tree.edges, num_samples=6).count() == 3
    negatives = pairs.negative_pairs(positives, d.network.edges)
    wrong = negatives.join(positives, ["source", "target"], "left_semi").count()
    near = undirected(d.network.edges).withColumnsRenamed({"author_id": "source", "other": "target"})
    assert wrong == 0 and negatives.join(near, ["source", "target"], "left_anti").count() == 0
    users = pairs.user_features(d.posts, d.profiles, d.standing)
    by_post = pairs.post_features(d.posts, d.text_scores)
    data = pairs.propagation_dataset(positives, negatives, by_post, users)
    # Four counters, the text scores present, and every user column in three roles.
    texts = [c for c in by_post.columns if c in pairs.TEXT_FEATURES]
    assert len(data.columns) == 4 + len(texts) + 3 * (len(users.columns) - 1) + 1
    assert rows(data.select("propagated").distinct()) == [(0,), (1,)]
    some = pairs.with_all_features(data, ["num_likes", "absent"])
    assert some.columns == ["num_likes", "absent"] and some.where("absent is not null").count() == 0
    none = d.text_scores.where("id < 0")
    assert pairs.eligible_cascades(d.posts, d.profiles, none).count() == 0
    assert pairs.eligible_cascades(d.posts, d.profiles, none, require_scores=False).count() >= eligible.count()
    with pytest.raises(LookupError):
        pairs.eligible_cascades(d.posts, d.profiles.where("user_id = 'x'"), d.text_scores)


class Everything:
    """Accepts every pair, or only pairs into some authors."""

    def __init__(self, only=None):
        self.only = only

    def predict(self, frame):
        if self.only is None:
            return frame.withColumn("prediction", F.lit(1))
        return frame.withColumn("prediction", F.col("target").isin(self.only).cast("int"))


def test_growth_reaches_what_the_model_accepts(d):
    by_post = pairs.post_features(d.posts, d.text_scores)
    users = pairs.user_features(d.posts, d.profiles, d.standing)
    cid = d.roots.orderBy("cascade_id").first()["cascade_id"]
    observed = {r[0] for r in d.nodes.where(F.col("cascade_id") == cid).select("author_id").collect()}
    args = (d.nodes, d.network.edges)
    grown = growth.grow_cascade(cid, *args, Everything([]), by_post, users)
    assert {r["author_id"] for r in grown.collect()} == observed
    from tests import brute

    root = d.roots.where(F.col("cascade_id") == cid).first()["author_id"]
    links = rows(d.network.edges, "source", "target")
    chosen = sorted({a for e in links for a in e} - observed)[:6]
    grown = growth.grow_cascade(cid, *args, Everything(chosen), by_post, users).collect()
    inside = [(a, b) for a, b in links if {a, b} <= {root, *chosen}]
    assert {r["author_id"] for r in grown} == observed | set(brute.distances(root, inside, directed=False))
    assert all(r["ground_truth"] == (r["source"] is None) for r in grown)
    with pytest.raises(LookupError):
        growth.grow_cascade("nope", *args, Everything(), by_post, users)


def test_growth_joins_the_cascades_posts_once_and_sends_no_users_to_the_driver(spark, monkeypatch):
    nodes = spark.createDataFrame([("1", "1", "a"), ("2", "2", "c")], "cascade_id string, post_id string, author_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    by_post = spark.createDataFrame([("1", 3), ("2", 4), ("9", 5)], "cascade_id string, num_likes int")
    users = spark.createDataFrame([(x, i) for i, x in enumerate("abcd")], "author_id string, rank int")
    cascades = nodes.select("cascade_id", F.col("author_id").alias("original_author")).where("cascade_id = '1'")
    kept, plans = {}, []

    def settle(df, name="step"):
        if name == "joined":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        kept[name] = session_settle(df, name)
        return kept[name]

    session_settle = growth.settle
    monkeypatch.setattr(growth, "settle", settle)
    upward = (F.col("rank_prev") < F.col("rank_curr")) & (F.col("num_likes") == 3) & (F.col("rank_original") == 0)
    grown = growth.grow_cascades(cascades, nodes, edges, upward, by_post, users)
    assert rows(grown, "author_id", "source", "ground_truth") == [("a", None, True), ("b", "a", False), ("c", "b", False), ("d", "c", False)]
    assert "post_features" not in kept and rows(kept["cascade_features"], "cascade_id", "num_likes", "rank_original") == [("1", 3, 0)]
    assert all(plan.count("SortMergeJoin") >= 2 for plan in plans) and len(plans) == 4


def test_registered_model_queries_run(spark):
    for name in ("propagation_model_metrics", "feature_importances"):
        assert catalogue.queries()[name](spark, SF).count() > 0


def test_pair_features_read_only_posts_of_the_cascades(spark, monkeypatch):
    made = []

    def cascade_features(heads, by_post, users, build=pairs.cascade_features):
        made.append(build(heads, by_post, users))
        return made[-1]

    monkeypatch.setattr(pairs, "cascade_features", cascade_features)
    chosen = spark.createDataFrame(
        [("a", "b", "1", "o"), ("a", "b", "1", "o"), ("b", "a", "2", "o"), ("a", None, "1", "o"), ("a", "b", None, "o"), ("a", "z", "1", "o")],
        "source string, target string, cascade_id string, original_author string",
    )
    by_post = spark.createDataFrame([("1", 5), ("1", 6), ("2", None), ("3", 7), (None, 8)], "cascade_id string, num_replies long")
    users = spark.createDataFrame([("a", 1.0), ("b", None), ("o", 3.0), (None, 9.0)], "author_id string, x double")
    out = pairs.pair_features(chosen, by_post, users)
    assert out.columns == ["original_author", "target", "source", "cascade_id", "num_replies", "x_prev", "x_curr", "x_original"]
    expected = [("o", "b", "a", "1", n, 1.0, None, 3.0) for n in (5, 5, 6, 6)] + [("o", "a", "b", "2", None, None, 1.0, 3.0)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)
    # Per post and author of a cascade once, however many pairs it has.
    assert made[0].count() == 3
