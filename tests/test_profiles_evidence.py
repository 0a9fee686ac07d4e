import json
import statistics

import pytest
from pyspark.sql import functions as F

from spreadlab.operators import actors, evidence, profiles, reports
from tests.conftest import at, make_posts, post, rows


def test_actor_lists(spark):
    suspects = spark.createDataFrame(
        [("https://x/abc?s=1", "Twitter"), ("https://x/abc", "Twitter"), ("https://x/def", "Other")], "link string, network string"
    )
    parties = spark.createDataFrame(
        [("https://x/def", " Left "), ("https://x/def", "Right"), ("No en té", "None")], "link string, party string"
    )
    posts = make_posts(spark, [post(i, n, at(0), username=n) for i, n in enumerate(("abc", "def", "ghi"))])
    marked = actors.annotate_actors(posts, suspects, parties)
    assert marked.schema == posts.schema or marked.columns == posts.columns
    assert rows(marked, "author.username", "author.actor.is_usual_suspect", "author.actor.party") == [
        ("abc", True, None),
        ("def", False, "Left"),
        ("ghi", False, None),
    ]


@pytest.fixture(scope="module")
def people(spark):
    data = [
        ("1", "1", "n1", "s" * 70, True, 10.0, 3.0, 0.5, "male", "<=18", "fake_spreaders"),
        ("2", "2", "n2", "short", False, 20.0, 4.0, 0.7, "female", "30-39", "fake_spreaders"),
        ("3", "3", "n3", "short", None, 60.0, None, 0.1, "robot", "30-39", "control"),
    ]
    return spark.createDataFrame(
        data,
        "user_id string, twitter_id string, anonymizedName string, user_summary string, is_verified boolean, "
        "followers_count double, friends_count double, joy_emolex double, gender_demo string, age_demo string, grp string",
    )


def test_cards(people):
    cards = {r["twitter_id"]: r for r in profiles.profile_cards(people).collect()}
    assert cards["1"]["description"] == "s" * 60 + "<br>" + "s" * 10
    assert (cards["1"]["gender"], cards["1"]["verified"], cards["1"]["followers"]) == ("Home", "Sí", "10")
    assert (cards["3"]["gender"], cards["3"]["verified"], cards["3"]["followed"]) == ("robot", "No", None)


def test_comparison_medians_and_shares(spark, people):
    medians = profiles.group_medians(people.withColumnRenamed("grp", "group"), "group", ["followers_count", "joy_emolex"])
    assert rows(medians) == [
        ("control", "followers_count", 60.0),
        ("control", "joy_emolex", 0.1),
        ("fake_spreaders", "followers_count", 15.0),
        ("fake_spreaders", "joy_emolex", pytest.approx(0.6)),
    ]
    listed = spark.createDataFrame(
        [("emociones", "joy_emolex", "alegría*", 0), ("interacciones", "followers_count", "f", 0), ("interacciones", "friends_count", "g", 2)],
        "category string, feature_name string, display_name string, rank int",
    )
    out = profiles.profile_comparison(people, listed, medians, "emociones").where("twitter_id = '2'").first()
    assert (out["display_name"], out["user"], out["fact_checkers"], out["control"]) == ("Joy*", 0.7, None, 0.1)
    panels = profiles.profile_comparison(people, listed, medians, "interacciones")
    assert rows(panels.where("twitter_id = '1'"), "feature", "panel") == [("followers_count", 1), ("friends_count", 2)]
    assert rows(profiles.group_share(people, "age_demo")) == [("30-39", pytest.approx(200 / 3)), ("<=18", pytest.approx(100 / 3))]


def test_behaviour_and_social(spark):
    hours = [0, 1, 4, 10, 34, 130]
    data = [post(i, "a", at(h), text="hi @x @ñu" if i else "") for i, h in enumerate(hours)]
    data += [post("r", "b", at(3), [(0, "quoted", "a", at(0))], retweets=4), post("s", "b", at(5))]
    posts = make_posts(spark, data)
    got = {r["author_id"]: r for r in profiles.behaviour_features(posts).collect()}
    gaps = [(b - a) * 3600 for a, b in zip(hours, hours[1:])]
    assert got["a"]["median_time_betweet_tweets_behav"] == statistics.median(gaps)
    assert got["a"]["weekend_days_count_ratio_behav"] == pytest.approx(1 / 6)  # hour 130 is a Saturday
    assert got["a"]["tweets_sleep_time_ratio_behav"] == pytest.approx(3 / 6)
    night = {r["author_id"]: r for r in profiles.behaviour_features(posts, 22, 2).collect()}
    assert night["a"]["tweets_sleep_time_ratio_behav"] == pytest.approx(2 / 6)
    social = {r["author_id"]: r for r in profiles.social_features(posts).collect()}
    assert social["a"]["mentions_count_social"] == pytest.approx(10 / 6)
    assert (social["b"]["ratio_quoted_tweet_types"], social["b"]["ratio_original_tweet_types"]) == (0.5, 0.5)
    assert social["b"]["retweets_count_social"] == 2.0


def test_lexicon(spark):
    lexicon = spark.createDataFrame(
        [("the", False, "art"), ("th", True, "start"), ("hat", True, "anger")], "word string, is_prefix boolean, category string"
    )
    texts = spark.createDataFrame([("u", "The hated THEME, hat"), ("u", "of"), ("v", "none")], "user_id string, text string")
    assert rows(profiles.lexicon_scores(texts, lexicon)) == [("u", "anger", 0.4), ("u", "art", 0.2), ("u", "start", 0.4)]


def test_evidence(spark):
    checks = spark.createDataFrame(
        [("7", "c", "v", "0.12345", "1", "0.5", "d")],
        "tweet_id string, claim_text string, visual_evidence_text string, text_evidence_similarity_score string, "
        "visual_evidence_similarity_score string, visual_evidence_graph_similarity_score string, visual_evidence_domain string",
    )
    assert evidence.fact_check_view(checks).first()["text_evidence_similarity_score"] == 0.123
    images = spark.createDataFrame(
        [("openarms", "1", "a"), ("openarms", "1", "b"), ("openarms", "2", "a"), ("x", "7", "claim_image")],
        "dataset string, id string, stem string",
    )
    metadata = spark.createDataFrame(
        [(1, ["i/b.png", "i/a.jpg"], (70, "REAL")), (2, ["a.png", "c.png"], (71, "FAKE")), (3, ["a.png"], (72, "REAL"))],
        "id_in_json int, image_paths array<string>, results struct<tweet_id:int, label:string>",
    )
    good, bad = evidence.ingest_fact_checks(metadata, images)
    row = good.first()
    assert good.count() == 1 and (row["dataset"], row["tweet_id"]) == ("Openarms", "70")
    assert "tweet_id" not in row["results"].asDict() and "image_paths" not in good.columns
    assert rows(bad) == [(2, "openarms", ["c"], []), (3, None, ["a"], [])]
    missing = {r["stem"] for r in evidence.missing_images(checks, images).collect()}
    assert missing == set(evidence.REQUIRED_IMAGES) - {"claim_image"}
    full = {f: "" for f in evidence.EXPECTED_FIELDS} | {"results": {f: 1 for f in evidence.EXPECTED_RESULTS}}
    odd = {**full, "more": 1}
    del odd["results"]
    records = spark.createDataFrame(
        [("openarms", "1", json.dumps(full)), ("openarms", "9", json.dumps(odd))], "dataset string, id string, json string"
    )
    report = {(r["id"], r["part"]): (r["unexpected"], r["missing"]) for r in evidence.validate_fact_checks(records, images, stems=("a", "b")).collect()}
    assert report == {
        ("9", "fields"): (["more"], ["results"]),
        ("9", "results"): ([], sorted(evidence.EXPECTED_RESULTS)),
        ("9", "images"): ([], ["a", "b"]),
    }


def test_reports(spark):
    data = [post(i, f"a{i % 3}", at(0), suspect=i % 2 == 1, retweets=i * 20) for i in range(30)]
    posts = make_posts(spark, data)
    top = reports.top_posts_by_class({"x": posts, "y": posts}, n=3)
    assert rows(top.where("dataset = 'y' and user_type = 'Suspect'"), "rank", "id") == [(1, "29"), (2, "27"), (3, "25")]
    assert reports.sampled_cascades(top, 4).count() == 8
    authors = reports.top_authors_by_class({"x": posts}, above=100, n=1)
    best = {r["user_type"]: r for r in authors.collect()}
    totals = {}
    for i in range(6, 30):
        key = ("Suspect" if i % 2 else "Normal", f"a{i % 3}")
        totals[key] = totals.get(key, 0) + i * 20
    for kind in ("Normal", "Suspect"):
        assert best[kind]["retweet_count"] == max(v for (k, _), v in totals.items() if k == kind)
    from spreadlab.operators.network import Network

    net = Network(
        spark.createDataFrame([("a", "a"), ("b", "b")], "author_id string, username string"),
        spark.createDataFrame([("a", "b", 1)], "source string, target string, weight int"),
    )
    assert rows(reports.network_table({"d": net})) == [("d", 2, 1, 1.0)]
    assert F is not None
