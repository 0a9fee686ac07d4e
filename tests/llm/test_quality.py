import zlib

import numpy as np
import pytest

from spreadlab.llm import quality as Q

DOCS = "doc_id long, text string, lang string, score double"


def good(i):
    return f"a calm line {i} of plain words, and another one\nwith number {i * 7}"


def junk(i):
    return f"BUY!! NOW!! {i} BUY!! NOW!! WIN!! " * 5


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, good(i) if i % 3 else junk(i), "en", 1.0) for i in range(300)]
    rows += [(1000, None, None, None), (1001, "", "en", 0.0), (None, good(5), "en", 0.0), (3, junk(3), "en", 1.0), (1002, "word " * 200_000, "en", 0.0)]
    labels = [(i, 1 if i % 3 else 0) for i in range(300)] + [(3, 0), (4, None), (5, 7), (99999, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_columns(made):
    docs, labels = made
    found = Q.classify(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert held and all(r.predicted == (1 if r.doc_id % 3 else 0) for r in held)
    assert len({r.score for r in rows if r.doc_id in (1000, 1001)}) == 1  # null is empty
    assert len({r.score for r in rows if r.doc_id == 3}) == 1  # repeated rows


def test_held_out_labels_do_not_matter(spark, made):
    docs, labels = made
    flipped = labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    score = lambda x: {(r.doc_id, round(r.score, 9)) for r in Q.classify(docs, x).collect()}
    assert score(labels) == score(flipped)


def test_dual_coordinate_descent_reaches_the_optimum():
    random = np.random.default_rng(1)
    rows = [np.unique(random.integers(0, 12, 5)) for _ in range(60)]
    signs = np.where(random.random(60) < 0.5, 1.0, -1.0)
    ratios = random.normal(size=12)
    weights, bias = Q.fit_hinge(rows, signs, ratios, 1.0, 3000, 0)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / np.linalg.norm(ratios[r])
    x[:, 12] = 1

    def loss(w):
        return w @ w / 2 + np.maximum(0, 1 - signs * (x @ w)).sum()

    best = np.append(weights, bias)
    assert all(loss(best) <= loss(best + random.normal(scale=s, size=13)) + 1e-2 for s in (0.01, 0.1, 1) for _ in range(200))


def test_no_labels_and_no_documents(spark, made):
    docs, labels = made
    assert {r.score for r in Q.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.classify(docs.limit(0), labels).count() == 0


def test_accepted_keeps_rows_as_they_are(made):
    docs, labels = made
    kept = Q.accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(300) if i % 3} <= ids and not {i for i in range(300) if i % 3 == 0} & ids


def test_features_of_slices(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(999))
    whole = Q.Hasher().features(text, 1 << 18)
    monkeypatch.setattr(Q, "SLICE", 100)
    assert list(Q.Hasher().features(text, 1 << 18)) == list(whole)
