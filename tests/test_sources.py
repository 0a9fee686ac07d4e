import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from spreadlab.operators import activity, network
from spreadlab.plans import build as plans
from spreadlab.plans.dataset import SocialDataset
from spreadlab.sources import posts as files
from spreadlab.sources import tables
from spreadlab.sources.store import Store
from tests.conftest import at, make_posts, post, rows

WHEN = dt.datetime(2019, 5, 6, 7, 8, 9)


def raw_line(pid, time, ref_time=None, **extra):
    line = {
        "id": pid,
        "text": "t",
        "created_at": time,
        "author": {"id": 1, "username": "u", "marks": {"is_usual_suspect": True, "party": None}},
        **extra,
    }
    if ref_time:
        line["referenced_tweets"] = [{"id": "9", "type": "quoted", "created_at": ref_time, "author": {"id": "2", "username": "v"}}]
    return line


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "posts.jsonl.gz"
    content = [
        raw_line("1", "2019-05-06T07:08:09.000Z", {"$date": "2019-05-06T07:08:09Z"}),
        raw_line(2, {"$date": "2019-05-06 07:08:09"}, "2019-05-06 07:08:09", attachments={"media": [{"media_key": "m"}]}),
    ]
    with gzip.open(path, "wt") as out:
        out.write("\n".join(map(json.dumps, content)) + "\nnot json\n")
    return str(path)


def test_read_cast_and_write_posts(spark, lines, tmp_path):
    raw = files.read_posts(spark, lines, actor_field="marks").cache()
    assert raw.where(F.col(files.CORRUPT).isNotNull()).count() == 1
    good = raw.where(F.col(files.CORRUPT).isNull()).drop(files.CORRUPT)
    cast = files.cast_times(good)
    got = cast.orderBy("id").collect()
    assert [r["created_at"] for r in got] == [WHEN, WHEN]
    assert [r["referenced_tweets"][0]["created_at"] for r in got] == [WHEN, WHEN]
    assert got[0]["author"]["actor"]["is_usual_suspect"] is True
    assert files.cast_times(cast).schema == cast.schema
    partly = files.cast_reference_times(good)
    assert partly.schema["created_at"].dataType.simpleString() == "string"
    assert partly.first()["referenced_tweets"][0]["created_at"] == WHEN
    assert files.actor_field_of(cast.schema) == "actor"
    posts = files.as_posts(good)
    assert posts.where(F.col("public_metrics").isNull()).count() == 2

    files.write_ingest_outputs(cast, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/media")).count() == 1
    assert spark.read.json(str(tmp_path / "out/usual_suspects_and_politicians")).count() == 2
    back = spark.read.json(str(tmp_path / "out/mongoimport"))
    assert back.first()["created_at"]["$date"].startswith("2019-05-06T07:08:09")
    assert {r["created_at"] for r in files.cast_times(back).collect()} == {WHEN}


def test_malformed_time_structures_raise(spark):
    bad = spark.createDataFrame([(("x",),)], "created_at struct<other:string>")
    with pytest.raises(ValueError):
        files.cast_times(bad)
    text = spark.createDataFrame([('{"other": "x"}',)], "created_at string")
    with pytest.raises(Exception, match="date"):
        files.cast_times(text).collect()


def test_flatten_pages(spark, tmp_path):
    page = {
        "data": [
            {"id": "1", "text": "a", "created_at": "2024-01-01T00:00:00Z", "author_id": "7", "attachments": {"media_keys": ["k"]}},
            {"id": "2", "text": "b", "created_at": "2024-01-01T00:00:00Z", "author_id": "8", "referenced_tweets": [{"id": "5", "type": "quoted"}, {"id": "6", "type": "replied_to"}]},
        ],
        "includes": {
            "users": [{"id": "7", "username": "u7"}, {"id": "8", "username": "u8"}],
            "tweets": [{"id": "5", "text": "five", "created_at": "2023-01-01T00:00:00Z", "author_id": "7"}],
            "media": [{"media_key": "k", "url": "U"}],
        },
    }
    (tmp_path / "p.json").write_text(json.dumps(page))
    flat = {r["id"]: r for r in files.flatten_pages(spark.read.json(str(tmp_path / "p.json"))).collect()}
    assert flat["1"]["author"]["username"] == "u7" and flat["1"]["attachments"]["media"][0]["url"] == "U"
    known, unknown = flat["2"]["referenced_tweets"]
    assert (known["text"], known["author"]["id"], unknown["text"], unknown["author"]) == ("five", "7", None, None)
    plain = spark.range(1)
    assert files.flatten_pages(plain) is plain


def test_store_and_build(spark, tmp_path):
    data = [post("0", "a", at(0), text="x #T"), post("1", "b", at(30), [("0", "quoted", "a", at(0))], suspect=True)]
    store = Store(spark, str(tmp_path / "lake"))
    assert store.list_datasets() == []
    with pytest.raises(LookupError):
        store.require_dataset("d")
    posts = make_posts(spark, data)
    store.save_raw(posts, "d")
    store.save_raw(posts, "d")
    assert store.raw("d").count() == 2 and store.list_datasets() == ["d"]
    with pytest.raises(LookupError, match="not been computed"):
        store.load_table("d", "tweet_table")

    d = SocialDataset(store.raw("d"))
    written = plans.build(store, "d", d, ["network", "cascades", "cascade_statistics", "standing", "activity", "hashtags"])
    assert set(written) <= set(store.list_tables("d"))
    for name, fresh in (
        ("diffusion_metrics", d.curves),
        ("network_metrics", d.standing),
        ("tweet_time_series", activity.post_histogram(posts)),
        ("hidden_network_edges", d.network.edges),
    ):
        assert rows(store.load_table("d", name)) == rows(fresh.select(store.load_table("d", name).columns))
    full = plans.series(store, "d", start="2024-01-01", end="2024-01-02")
    assert rows(full) == rows(store.load_table("d", "tweet_time_series"))
    assert plans.series(store, "d", start="2024-01-02").count() == 1
    assert rows(plans.stored_network(store, "d").edges) == rows(network.network(posts).edges)
    assert plans.stored_network(store, "d", start="2024-01-02").edges.count() == 0
    assert rows(plans.cascade(store, "d", "0")["edges"], "parent", "child") == [("0", "1")]
    assert plans.cascade(store, "d", "1")["nodes"].count() == 1
    with pytest.raises(LookupError):
        plans.cascade(store, "d", "1", recompute=False)

    other = Store(spark, str(tmp_path / "other"))
    assert store.copy_table(other, {"d": "e"}, "raw") == {"d": 2}
    assert store.copy_table(other, {"d": "e"}, "raw") == {"d": 2}
    assert other.raw("e").count() == 4


def test_small_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("f1\t0.5\nf2\t2.0\nf3\tx\n")
    (tmp_path / "rel").write_text("topics:\nf1\nf3\nother:\nf2\n")
    (tmp_path / "features_seleccion_ingles.csv").write_text("﻿category;feature_name;display_name\ntemas;f1;one\ntemas;f2;two\nedad;f3;três\n", encoding="utf-8")
    (tmp_path / "lex.dic").write_text("%\n1\tfunct\n2\tanger\n%\nThe\t1\nhat*\t1\t2\n")
    relevant = tables.read_relevant_features(spark, str(tmp_path / "rel"))
    assert rows(relevant) == [("other:", "f2"), ("topics:", "f1"), ("topics:", "f3")]
    assert rows(tables.read_medians(spark, str(tmp_path / "m.tsv"))) == [("f1", 0.5), ("f2", 2.0), ("f3", None)]
    assert len(rows(tables.read_medians(spark, str(tmp_path / "m.tsv"), relevant))) == 3
    listed = tables.read_feature_catalogue(spark, str(tmp_path), "en")
    assert rows(listed) == [("edad", "f3", "três", 0), ("temas", "f1", "one", 0), ("temas", "f2", "two", 1)]
    with pytest.raises(KeyError):
        tables.read_feature_catalogue(spark, str(tmp_path), "fr")
    assert rows(tables.read_lexicon(spark, str(tmp_path / "lex.dic"))) == [
        ("hat", True, "anger"),
        ("hat", True, "funct"),
        ("the", False, "funct"),
    ]
    for name in ("d1/7/claim_image.jpg", "d1/7/evidence.png", "d1/8/x.txt"):
        (tmp_path / "img" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / name).write_bytes(b"1")
    assert rows(tables.list_images(spark, str(tmp_path / "img")), "dataset", "id", "stem") == [
        ("d1", "7", "claim_image"),
        ("d1", "7", "evidence"),
    ]
    tables.export_csv(listed, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    tables.to_markdown(spark.range(3000), str(tmp_path / "table"))
    lines = spark.read.text(str(tmp_path / "table")).collect()
    assert {r.value for r in lines} == {"| id |", "| --- |", *(f"| {i} |" for i in range(3000))} and len(lines) == 3002
