import datetime as dt
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from spreadlab import schemas  # noqa: E402
from spreadlab.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, partitions=4, memory="6g")
    yield session
    session.stop()


def at(hours):
    return START + dt.timedelta(hours=hours)


def post(pid, author, when, refs=None, suspect=False, party=None, tags=(), text="", retweets=0, username=None):
    """A post row; ``refs`` is None for an original, or (id, type, author, time) tuples."""
    pid, author = str(pid), None if author is None else str(author)
    return {
        "id": pid,
        "text": text,
        "created_at": when,
        "author": {
            "id": author,
            "username": username or f"u{author}",
            "name": None,
            "description": None,
            "actor": {"is_usual_suspect": suspect, "party": party},
        },
        "public_metrics": {"retweet_count": retweets, "reply_count": 0, "like_count": 0, "quote_count": 0},
        "entities": {"hashtags": [{"tag": t} for t in tags]},
        "referenced_tweets": None
        if refs is None
        else [
            {
                "id": str(r[0]),
                "type": r[1],
                "text": None,
                "created_at": r[3],
                "author": None if r[2] is None else {"id": str(r[2]), "username": f"u{r[2]}"},
            }
            for r in refs
        ],
    }


def make_posts(spark, rows):
    return spark.createDataFrame(rows, schemas.POST)


def rows(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
