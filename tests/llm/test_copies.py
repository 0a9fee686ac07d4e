import random

import corpus_pipeline
from spreadlab.llm import copies as C
from spreadlab.llm import simhash as S


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stage_removes_copies_of_similarity_from_0_8(spark):
    dice = random.Random(8)
    texts = [None, "", "too short", "Too  SHORT"]
    for _ in range(4):
        base = [f"w{dice.randrange(10**6)}" for _ in range(300)]
        texts.append(" ".join(base))
        for changes in (1, 3, 5, 6, 7, 8, 12, 30):
            copy = list(base)
            for at in dice.sample(range(300), changes):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    near = lambda a, b: len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))
    group = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(texts):
            for j in range(i):
                if group[i] != group[j] and near(a, texts[j]):
                    group[i] = group[j] = min(group[i], group[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_duplicates"]
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(group))


def test_crowds_are_connected_through_hubs(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:i] + ["x"] * (i % 3) + base[i:]) for i in range(0, 60, 2)] + [" ".join(base[i:] + [f"v{j}" for j in range(i)]) for i in range(0, 40, 4)]
    near = [[C.similarity(a.encode(), b.encode()) >= 0.8 for b in texts] for a in texts]
    rows = spark.createDataFrame([(1, i) for i in range(len(texts))], "key long, t long")
    said = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "t long, text binary")
    found = [(r.u, r.v) for r in C._links(rows, said, 5, 0.8).collect()]
    assert len(found) < len(texts) ** 2 / 4
    assert all(near[u][v] for u, v in found)
    reach = lambda some: [min(x) for x in some]
    group, want = list(range(len(texts))), list(range(len(texts)))
    for _ in texts:
        for u, v in found:
            group[u] = group[v] = min(group[u], group[v])
        want = reach([[want[j] for j in range(len(texts)) if near[i][j]] for i in range(len(texts))])
    assert group == want


def test_crowded_keys_are_told_apart_by_longer_ones(spark):
    dice = random.Random(4)
    common = [f"c{i}" for i in range(100)]
    texts = []
    for _ in range(20):
        own = [f"w{dice.randrange(10**6)}" for _ in range(100)]
        copy = list(own)
        copy[50] = "changed"
        texts += [" ".join(common + own), " ".join(common + copy)]
    keys = [C.keys(t.encode()) for t in texts]
    rows = spark.createDataFrame([(k, i) for i, some in enumerate(keys) for k in some], "key long, t long")
    said = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "t long, text binary")
    for crowd, depth in ((1, 1), (3, 2), (500, 0)):
        found = {(min(r.u, r.v), max(r.u, r.v)) for r in C._links(rows, said, 5, 0.8, crowd, depth).collect()}
        assert found == {(i, i + 1) for i in range(0, len(texts), 2)}


def test_stage_removes_what_fingerprints_link(spark):
    # The repeated shingles set the bits of all fingerprints; most different shingles are of one text only.
    often = ["a b c d e f g"] * 60
    texts = [" ".join([*often, f"x{i}", f"y{i}", f"z{i}"] + [f"w{i}-{j}" for j in range(8)]) for i in range(4)]
    assert max(C.similarity(a.encode(), b.encode()) for i, a in enumerate(texts) for b in texts[:i]) < 0.8
    prints = [S.fingerprint(t.encode(), 4) for t in texts]
    assert max(bin((a ^ b) % 2**64).count("1") for a in prints for b in prints) <= 4
    docs = spark.createDataFrame([*enumerate(texts), (9, " ".join(f"v{i}" for i in range(50)))], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [0, 9]
