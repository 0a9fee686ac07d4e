import datetime as dt

import pytest
from pyspark.sql import functions as F

from spreadlab.functions import columns as C
from spreadlab.operators import activity, board, emotions
from spreadlab.operators import posts as ops
from tests.conftest import at, make_posts, post, rows


@pytest.fixture(scope="module")
def data():
    flags = [(False, None), (True, None), (False, "P"), (True, "P"), (None, None)]
    out = []
    for i in range(40):
        suspect, party = flags[i % 5]
        refs = None if i % 3 else ([] if i % 2 else [(1, "quoted", "a1", at(0))])
        tags = [t for t, n in (("x", 2), ("y", 3)) if i % n == 0]
        out.append(post(i, f"a{i % 7}", at(i * 7), refs, suspect, party, tags, f"n{i} #Tag{i % 4} #ñu", retweets=i * 10))
    return out


def test_time_bins(spark):
    day = spark.createDataFrame([(dt.datetime(2024, 1, 10, 13, 5),)], "t timestamp")

    def binned(unit, size):
        return day.select(C.time_bin(F.col("t"), unit, size)).first()[0].date()

    assert binned("day", 1) == dt.date(2024, 1, 10)
    assert binned("week", 1) == dt.date(2024, 1, 7)  # a Sunday
    assert binned("month", 1) == dt.date(2024, 1, 1)
    assert binned("month", 5) == dt.date(2023, 10, 1)  # 285 months after 2000-01
    assert binned("year", 1) == dt.date(2024, 1, 1)
    assert binned("year", 10) == dt.date(2020, 1, 1)
    days = (dt.date(2024, 1, 10) - dt.date(2000, 1, 1)).days
    assert binned("day", 4) == dt.date(2000, 1, 1) + dt.timedelta(days=days // 4 * 4)
    with pytest.raises(ValueError):
        C.time_bin(F.col("t"), "hour")


def test_histograms(spark, data):
    posts = make_posts(spark, data)
    got = {r["time"].date(): tuple(r[1:]) for r in activity.post_histogram(posts).collect()}
    flags = [(False, None), (True, None), (False, "P"), (True, "P")]
    marked = [p for p in data if p["author"]["actor"]["is_usual_suspect"] is not None]
    expected = {
        day: tuple(
            sum(
                p["created_at"].date() == day
                and (p["author"]["actor"]["is_usual_suspect"], p["author"]["actor"]["party"]) == f
                for p in marked
            )
            for f in flags
        )
        for day in {p["created_at"].date() for p in marked}
    }
    assert got == expected  # posts with a missing flag are in no class
    people = activity.author_histogram(posts, unit="year").first()
    assert people["Normal"] == len({p["author"]["username"] for i, p in enumerate(data) if i % 5 == 0})
    both = activity.post_histogram(posts, hashtags=["x", "y"], unit="year").first()
    assert sum(both[1:]) == sum(i % 6 == 0 and i % 5 != 4 for i in range(40))
    late = activity.post_histogram(posts, start=at(70), end=at(140), unit="year").first()
    assert sum(late[1:]) == sum(10 <= i <= 20 and i % 5 != 4 for i in range(40))


def test_hashtags(spark, data):
    posts = make_posts(spark, data)
    assert rows(activity.hashtag_counts(posts)) == [("x", 20), ("y", 14)]
    assert rows(activity.hashtag_counts(posts, top=1)) == [("x", 20)]
    assert rows(activity.hashtag_counts(posts, author_id="a0", end=at(100))) == [("x", 2), ("y", 1)]
    weights = dict(rows(activity.hashtag_weights(activity.hashtag_counts(posts))))
    assert weights == {"x": 1.0, "y": 0.7}
    text = posts.select(C.hashtags_in_text(F.col("text")).alias("t")).first()["t"]
    assert text == ["Tag0", "ñu"]
    one = spark.createDataFrame([("no tag # here",), ("#a\t#b x#c",)], "t string")
    assert [r[0] for r in one.select(C.hashtags_in_text(F.col("t"))).collect()] == [None, ["a", "b", "c"]]
    assert [r[0] for r in one.select(C.hashtag_tokens(F.col("t"))).collect()] == [[""], ["a", "b"]]


def test_classes_bounds_and_lookups(spark, data):
    posts = make_posts(spark, data)
    assert ops.of_class(posts, "Suspect politician").count() == 8
    with pytest.raises(ValueError):
        ops.of_class(posts, "Robot")
    assert ops.originals(posts).count() == sum(i % 3 != 0 for i in range(40))
    assert ops.engaging_originals(posts, "Suspect", 100).count() == sum(
        i % 3 != 0 and i % 5 == 1 and i * 10 > 100 for i in range(40)
    )
    assert ops.normalise_bounds(posts, "2024-01-01", "2024-01-12") == (None, None)
    assert ops.normalise_bounds(posts, "2024-01-02", None) == (dt.date(2024, 1, 2), None)
    assert ops.get_post(posts, "3")["id"] == "3"
    assert ops.author_id_of(posts, "ua2") == "a2" and ops.username_of(posts, "a2") == "ua2"
    with pytest.raises(LookupError):
        ops.author_id_of(posts, "nobody")
    assert not ops.has_row(ops.flat(posts), "id", "999")
    assert ops.window(posts, end="2024-01-02", mode="board", hashtags=()).count() == 7
    assert ops.window(posts, end="2024-01-02", mode="activity").count() == 4


def test_cascade_count_per_day_and_week(spark):
    def counts(days, unit):
        data = [post(f"o{d}", "a", at(24 * d + 5)) for d in days]
        data += [post(f"r{d}", "b", at(24 * d + 6), [(f"o{d}", "quoted", "a", at(0))]) for d in days]
        out = activity.cascade_count_over_time(make_posts(spark, data), unit)
        return {r["time"].date(): r["cascades"] for r in out.collect()}

    few = counts([0, 2, 3], "day")
    assert few == {dt.date(2024, 1, 1): 1, dt.date(2024, 1, 2): 0, dt.date(2024, 1, 3): 1, dt.date(2024, 1, 4): 1}
    many = counts([0, 1, 160], "week")
    assert len(many) == 23 and many[dt.date(2024, 1, 7)] == 2 and sum(many.values()) == 3
    assert all(d.weekday() == 6 for d in many)


def test_sample_per_period(spark, data):
    posts = make_posts(spark, data)
    got = activity.sample_per_period(posts, "day", 2)
    assert all(n <= 2 for (n,) in rows(got.groupBy("period").count(), "count"))
    assert rows(got, "id") == rows(activity.sample_per_period(posts, "day", 2), "id")


@pytest.fixture(scope="module")
def table(spark):
    posts = make_posts(
        spark,
        [
            post("1", "a", at(0), text="first #One", retweets=5, suspect=True, party="P"),
            post("2", "b", at(30), text="second", retweets=9),
            post("3", "c", at(60), text="Third #two #three", retweets=9),
            post("4", "c", at(61), [("1", "quoted", "a", at(0))]),
        ],
    )
    checks = spark.createDataFrame([("1",), ("1",)], "tweet_id string")
    people = spark.createDataFrame([("b",), ("c",)], "user_id string")
    scores = spark.createDataFrame([("3", 0.256), ("2", 0.5)], "id_str string, fakeness_probabilities double")
    levels = spark.createDataFrame(
        [("a", "High", "Low", "Null")],
        "author_id string, legitimacy_level string, reputation_level string, status_level string",
    )
    return board.board(posts, checks, people, scores, levels).cache()


def test_board_rows(table):
    got = [tuple(r) for r in board.by_retweets(table).drop("created_at").collect()]
    assert got == [
        ("2", "ub", "second", 9, False, None, False, True, 0.5, None, None, None, "b", None),
        ("3", "uc", "Third #two #three", 9, False, None, False, True, 0.256, None, None, None, "c", ["two", "three"]),
        ("1", "ua", "first #One", 5, True, "P", True, False, None, "High", "Low", "Null", "a", ["One"]),
    ]


@pytest.mark.parametrize(
    "query, ids",
    [
        ("{Retweets} ge 9", "23"),
        ("{Retweets} > 8 && {User} eq 'uc'", "3"),
        ("{Text} contains FIRST", "1"),
        ("{Text} contains f.r", "1"),
        ("{Profiling} contains Yes", "23"),
        ("{Multimodal} contains no", "23"),
        ("{created_at} datestartswith 2024-01-02", "2"),
        ("{User} ne ub && {Suspicious content} <= 0.3", "3"),
        ("{ID} = 2", "2"),
        ("{Retweets} roughly 3", "123"),
        ("nonsense && {Retweets} lt 9", "1"),
        ("{Party} eq 'P'", "1"),
        ("{Text} contains 'change ge '", ""),
        ("{Retweets} eq many", ""),
    ],
)
def test_board_filters(table, query, ids):
    assert "".join(r[0] for r in rows(board.select_board(table, query=query), "ID")) == ids


def test_board_pages_windows_and_rendering(table):
    order = [{"column_id": "Retweets", "direction": "desc"}]
    pages = [board.select_board(table, sort_by=order, skip=i, amount=1).first()["ID"] for i in range(3)]
    assert pages == ["2", "3", "1"]
    assert board.select_board(table).columns == list(board.PUBLIC)
    assert rows(board.select_board(table, hashtags=["two", "One"]), "ID") == [("1",), ("3",)]
    assert rows(board.select_board(table, start="2024-01-02", end="2024-01-02"), "ID") == [("2",)]
    assert tuple(board.board_size(table, page_size=2).first()) == (3, 2)
    assert board.page_count(21, 10) == 3
    shown = board.rendered(table).where("ID = '3'").first()
    assert (shown["User"], shown["Profiling"], shown["Suspicious content"]) == ("d38af049", "Yes", 0.26)


def test_emotions(spark):
    names = list(emotions.EMOTIONS)
    data = [("2024-01-01 05:00:00", *[i / 10 for i in range(11)]), ("2024-01-02 05:30:00", *[i / 5 for i in range(11)])]
    scores = spark.createDataFrame(data, "date string, " + ", ".join(f"{n} double" for n in names))
    mean = emotions.average_emotion(scores).collect()
    assert mean[0]["emotion"] == "Irony" and mean[0]["level"] == pytest.approx(1.5)
    hours = emotions.emotion_by_hour(scores, start="2024-01-02").collect()
    assert len(hours) == 1 and hours[0]["hour"] == 5 and hours[0]["Irony"] == pytest.approx(2.0)


def test_small_functions(spark):
    df = spark.createDataFrame([("https://x.example/a/name?lang=es", "['caption', 'place']", "x" * 130)], "l string, p string, w string")
    row = df.select(
        C.handle_of(F.col("l")), C.parsed_list(F.col("p")), C.wrapped(F.col("w")), C.pseudonym(F.lit("abc")), C.yes_no(F.lit(None).cast("boolean"))
    ).first()
    assert row[0] == "name" and row[1] == ["caption", "place"]
    assert row[2] == "x" * 60 + "<br>" + "x" * 60 + "<br>" + "x" * 10
    assert row[3] == "90015098" and row[4] == "No"
    text = df.select(C.level_summary(F.lit("High"), F.lit(None), F.lit("Low"))).first()[0]
    assert text == "Legitimacy: High<br>Reputation: <br>Status: Low"
    assert df.select(C.level_rank(F.lit("Medium")), C.level_rank(F.lit("?"))).first()[:] == (2, None)
    codes = df.select(*[C.level_code(F.lit(x).cast("string"), C.LEVEL_SIZES) for x in ("High", "Null", None)]).first()
    assert codes[:] == (3.0, 0.5, 0.5)
