import random
import re
from collections import Counter

import pytest

from spreadlab.llm import decontaminate as D


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(some, k):
    return [tuple(some[i : i + k]) for i in range(len(some) - k + 1)]


def brute(docs, items, threshold):
    best = {}
    for doc, text in docs:
        whole = words(text)
        for item, said in items:
            own = words(said)
            if not own or len(whole) < len(own):
                continue
            k = min(5, len(own))
            want, have = Counter(grams(own, k)), grams(whole, k)
            n = len(own) - k + 1
            for start in range(len(have) - n + 1):
                common = sum((Counter(have[start : start + n]) & want).values())
                similarity = common / (2 * n - common)
                if similarity >= threshold - 1e-12:
                    best[doc, item] = max(best.get((doc, item), (0, 0)), (similarity, -start))
    return best


@pytest.fixture(scope="module")
def made(spark):
    dice = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(dice.choices(vocabulary, k=dice.choice([6, 12, 12, 30, 31])))) for i in range(12)]
    items += [(50, "one two three"), (51, ""), (52, None), (53, "la " * 20), (54, "word"), (55, items[0][1]), (None, items[1][1])]
    docs = []
    for i in range(60):
        passage = words(dice.choice(items[:12])[1])
        for _ in range(dice.randint(0, 2)):
            passage[dice.randrange(len(passage))] = "changed"
        around = [" ".join(dice.choices(vocabulary, k=dice.randint(0, 30))) for _ in range(2)]
        docs.append((i, f"{around[0]}. {' '.join(passage).upper()}!\n{around[1]}"))
    docs += [(100, None), (101, ""), (102, "One, two; three"), (103, "two three"), (None, items[2][1]), (104, "la " * 300), (105, items[4][1]), (105, items[4][1])]
    docs += [(106, "x one two three " * 3000 + items[5][1])]
    return docs, items


def frames(spark, made):
    docs = spark.createDataFrame([(*d, "clash") for d in made[0]], "doc_id long, text string, item_id string")
    return docs, spark.createDataFrame([(*b, 3) for b in made[1]], "item_id long, text string, size int")


@pytest.mark.parametrize("threshold, rows", [(0.8, D.BROADCAST_ROWS), (0.8, 0), (0.95, D.BROADCAST_ROWS)])
def test_matches_brute_force(spark, made, monkeypatch, threshold, rows):
    monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
    want = brute(*made, threshold)
    got = {(r.doc_id, r.item_id): (r.similarity, -r.start_word) for r in D.find(*frames(spark, made), threshold).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_documents_with_items_go(spark, made):
    docs, benchmark = frames(spark, made)
    held = {d for d, _ in brute(*made, 0.8)}
    kept = D.without_items(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in made[0] if d not in held)


def test_clean_rows_of_an_id_with_items_stay(spark):
    said = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, said)], "item_id long, text string")
    rows = [(None, said), (None, "nothing of it"), (None, None), (7, "x " + said), (7, "clean text"), (8, said[:18]), (8, said[18:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in D.without_items(docs, items).collect()), key=str)
    assert kept == sorted([r for r in rows if said not in (r[1] or "")], key=str)
    assert {r.doc_id for r in D.find(docs, items).collect()} == {None, 7}


def test_blocks_guarantee_the_radius():
    dice = random.Random(9)
    for _ in range(500):
        differ = sum(1 << b for b in dice.sample(range(64), D.RADIUS))
        assert any((differ >> D.WIDTH * j & 255).bit_count() <= D.FLIPS for j in range(D.BLOCKS))


def test_empty_tables(spark, made):
    docs, benchmark = frames(spark, made)
    assert D.find(docs.limit(0), benchmark).count() == 0
    assert D.find(docs, benchmark.limit(0)).count() == 0
    assert D.without_items(docs, benchmark.limit(0)).count() == len(made[0])
