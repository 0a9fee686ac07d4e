"""Spelling variants against pairs of all words."""

import random
import zlib
from collections import Counter

import re
import numpy as np
import pytest

from spreadlab.llm import variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def expected(counts, ratio=5):
    out = {}
    for word, n in counts.items():
        close = [w for w in counts if one_edit(word, w)]
        best = min(close, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[word] = [n, len(close), form, counts[form] if form else None]
    for word in out:
        root = word
        while out[root][2]:
            root = out[root][2]
        out[word].append(root)
    return {w: tuple(v) for w, v in out.items()}


def grouped(spark, counts, **options):
    vocabulary = spark.createDataFrame(list(counts.items()) or [], "word string, n long")
    rows = variants.group(vocabulary, **options).collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(rows) == len(out)
    return out


def test_suffix_ranks():
    pick = random.Random(3)
    for _ in range(50):
        symbols = np.array([pick.randrange(3) for _ in range(pick.randrange(1, 40))] + [0])
        suffixes = [tuple(symbols[i:]) for i in range(len(symbols))]
        assert [sorted(suffixes).index(s) for s in suffixes] == variants.suffix_ranks(symbols).tolist()


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_index_finds_all_with_a_half(letters):
    pick = random.Random(5)
    words = sorted({"".join(pick.choice(letters) for _ in range(pick.randrange(1, 9))) for _ in range(120)})
    index = variants.Index([w[::-1] for w in words])
    names = [w[::-1] for w in index.words]
    queries = [*words, "zz", "azb"]
    a, b = variants.near(index, queries, [len(q) // 2 for q in queries])
    found = {(queries[i], names[j]) for i, j in zip(a, b)}
    for q in queries:
        half = q[: len(q) // 2]
        wanted = {w for w in words if w.startswith(half) and (one_edit(q, w) and one_edit(q[len(half) :], w[len(half) :]))}
        assert {w for x, w in found if x == q} == wanted


@pytest.mark.parametrize("block", [16, 200, 1 << 18])
def test_groups_equal_brute_force(spark, block):
    pick = random.Random(block)
    words = {"".join(pick.choice("abö") for _ in range(pick.randrange(1, 9))) for _ in range(150)}
    words |= {"aaaaaaaaaaaa" * 20, "aaaaaaaaaaaa" * 20 + "b", "prefix", "prefixa", "prefiy", "refix"}
    counts = {w: pick.choice([1, 2, 5, 10, 25, 100, 500]) for w in words}
    assert grouped(spark, counts, block=block, together=37) == expected(counts)


def test_crowded_half_over_many_blocks(spark):
    words = ["abcabc" + x + y for x in "abcdefghij" for y in "abcdefghijklmnop"]
    counts = {w: i + 1 for i, w in enumerate(words)}
    assert grouped(spark, counts, block=100) == expected(counts)


def test_ties_and_nothing(spark):
    assert grouped(spark, {}) == {}
    found = grouped(spark, {"houses": 10, "housez": 10, "housex": 2})
    assert found["housex"] == (2, 2, "houses", 10, "houses") and found["houses"] == (10, 2, None, None, "houses")
    with pytest.raises(ValueError):
        variants.group(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_words_of_texts(spark):
    texts = [(i, f"Übung übung ÜBUNG7Straße_straßen GARDEN garden's {'longer' * 3000} x") for i in range(400)]
    texts += [(None, "garden garden"), (7, None), (8, ""), (9, "1234 ?!")]
    wanted = Counter()
    for doc_id, text in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            wanted[run] += 1
    wanted = {w: n for w, n in wanted.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, n long, word string")
    rows = variants.words(docs).collect()
    assert {r["word"]: r["n"] for r in rows} == wanted and len(rows) == len(wanted) > 3
    assert variants.spelling_variants(docs.limit(0)).count() == 0
