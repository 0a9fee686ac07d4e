"""Language identification: steps against plain computation, and held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlab.llm import languages

SF = "/root/testdata/sf0.01/documents.parquet"


def test_families():
    assert languages.family_of("en") == languages.family_of("de-AT") == "germanic"
    assert languages.family_of("ES_mx") == "romance" and languages.family_of("tlh") == "tlh"


def test_words_and_grams(monkeypatch):
    assert [*languages.words("Été, 3x² don't_go ² ٣")] == [["été", "x²", "don", "t", "go"]]
    assert [*languages.words("123 ²!")] == [] == [*languages.words("")]
    monkeypatch.setattr(languages, "SLICE", 5)
    assert [w for part in languages.words("abcdefgh ij klm nopqrst uvw") for w in part] == ["abcdefgh", "ij", "klm", "nopqrst", "uvw"]
    long = "a" * 200
    assert [len(w) for part in languages.words(long) for w in part] == [64, 64, 64, 8]
    assert sum(len(f) for f, _ in languages.grams(["ab"], 1 << 16)) == 2 + 3 + 2 + 1


def features_of(word, size):
    """The same, one n-gram at a time."""
    spelled, out = f" {word} ", [zlib.crc32(word.encode()) % size]
    for n in (1, 2, 3):
        for i in range(len(spelled) - n + 1):
            gram = spelled[i : i + n]
            if gram != " ":
                mixed = sum((ord(c) + 1) * int(m) for c, m in zip(gram, languages._MIX)) * int(languages._MIX[3]) + n * int(languages._MIX[0])
                out.append((mixed % (1 << 64) >> 32) % size)
    return out


def test_grams_of_several_words():
    some = ["a", "ab", "straße", "世界", "x" * 64]
    found = [[] for _ in some]
    for features, word in languages.grams(some, 512):
        assert (np.diff(word) >= 0).all() and set(word) == set(range(len(some)))
        for f, w in zip(features, word):
            found[w].append(f)
    assert [sorted(f) for f in found] == [sorted(features_of(w, 512)) for w in some]


def test_counts_of_a_text_in_slices(monkeypatch):
    text = "The cat and the dog; the END. " * 30
    whole = languages.text_features(text, 1 << 10)
    monkeypatch.setattr(languages, "SLICE", 40)
    parts = languages.text_features(text, 1 << 10)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_counts_of_languages(spark):
    rows = [(i, ["the cat", "le chat", "12"][i % 3], "en fr en".split()[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = {(r["lang"], r["feature"]): r["n"] for r in languages.language_counts(languages.to_learn_from(docs), 64).collect()}
    wanted = Counter()
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            wanted[lang, -1] += 1
            wanted.update((lang, f) for part in languages.words(text) for w in part for f in features_of(w, 64))
    assert found == wanted


def test_pair_reaches_the_optimum():
    random = np.random.default_rng(1)
    rows = [(np.array([0, 1]), random.normal([s, 0.3], 0.8)) for s in (1.0, -1.0) * 40]
    signs = np.array([1.0, -1.0] * 40)
    weights, bias = languages.fit_pair(rows, signs, 2, 1.0, 500, 0)

    def loss(w):
        margins = np.array([v @ w[:2] for _, v in rows]) + w[2]
        return 0.5 * w @ w + np.maximum(0, 1 - signs * margins).sum()

    ours = np.append(weights, bias)
    for _ in range(300):
        assert loss(ours) <= loss(ours + random.normal(0, 0.05, 3)) + 1e-3


def test_prediction_is_a_sum_over_words():
    random = np.random.default_rng(2)
    model = languages.Model(
        random.normal(size=(64, 5)), ["g", "r"], np.log([0.5, 0.5]), {"g": ["x"], "r": ["a", "b", "c"]}, [("a", "b"), ("a", "c"), ("b", "c")], random.normal(size=3)
    )
    text = "some words and some more words"
    features = np.concatenate([features_of(w, 64) for w in text.split()])
    fit = model.priors + model.sums[features, :2].sum(0)
    margins = model.biases + model.sums[features, 2:].sum(0) * languages.SHARE / len(features)
    votes = {lang: sum((margins[k] >= 0) == (lang == p[1]) for k, p in enumerate(model.pairs) if lang in p) for lang in "abc"}
    (lang, score), = languages.Scorer(model).predict([text])
    assert (lang == "x") if fit[0] > fit[1] else votes[lang] == max(votes.values())
    assert 0 <= score <= 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    found = languages.classify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert found.count() == docs.count() and right > 0.97


def test_learns_nothing_from_held_out_rows(spark):
    rows = [(i, f"word{'abcdefgh'[i % 8]} the cat", "en" if zlib.crc32(str(i).encode()) % 4 != 2 else "xx") for i in range(60)]
    rows += [(100 + i, "perro gato el la", "es") for i in range(0, 40) if zlib.crc32(str(100 + i).encode()) % 4 != 2]
    found = languages.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in found} == {"en", "es"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)


def test_odd_rows(spark):
    rows = [(None, "the cat sat", "en"), (None, "the cat sat", "en"), (1, None, "en"), (2, "", "fr"), (3, "12 !?", None), (4, "le chat est", "fr"), (5, "x " * 300_000, None)]
    rows = [(*r, 0.5, "x") for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, features string")
    found = languages.classify(docs).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3))
    assert by_id[4]["lang_pred"] == "fr" and by_id[None]["lang_pred"] == "en" and by_id[5]["lang_pred"] in ("en", "fr")
    nothing = languages.classify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert languages.classify(docs.limit(0)).count() == 0
