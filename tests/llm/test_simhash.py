import random
import re

import numpy as np
import pytest
import xxhash

from spreadlab.llm import simhash as S


def slow_print(text, size=4):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    left, out = set(range(len(prints))), [0] * len(prints)
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            near = {j for j in left if (prints[todo[-1]] ^ prints[j]).bit_count() <= radius}
            todo.pop()
            left -= near
            group |= near
            todo += near
        for i in group:
            out[i] = min(group)
    return out


TEXTS = [None, "", " \t\n\x0b\x0c\r ", "One", "one", "ONE two Three", "É é x", "a b c d", "a b c d a b c d", "x " * 3000]


def test_fingerprints(spark, monkeypatch):
    want = [slow_print(t) for t in TEXTS]
    assert [S.fingerprint((t or "").encode(), 4) % (1 << 64) for t in TEXTS] == want
    monkeypatch.setattr(S, "SLICE", 7)
    assert [S.fingerprint((t or "").encode(), 4) % (1 << 64) for t in TEXTS] == want
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, fingerprint int")
    got = {r.doc_id: r.hex for r in S.fingerprints(docs).select("doc_id", S.hexadecimal(S.F.col("fingerprint")).alias("hex")).collect()}
    assert got == {i: f"{w:016x}" for i, w in enumerate(want)}


def near_prints(n, seed):
    """Fingerprints in crowds: copies of a few centres with some bits changed."""
    dice = random.Random(seed)
    centres = [dice.getrandbits(64) for _ in range(6)]
    out = []
    for _ in range(n):
        f = dice.choice(centres) if dice.random() < 0.8 else dice.getrandbits(64)
        for b in dice.sample(range(64), dice.randint(0, 6)):
            f ^= 1 << b
        out.append(f)
    return sorted(set(out))


@pytest.mark.parametrize("blocks, crowd", [(6, 2000), (6, 5), (5, 3)])
def test_links_connect_what_all_pairs_connect(spark, blocks, crowd):
    prints = near_prints(150, 2)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(f,) for f in signed], "f long")
    at = {f: i for i, f in enumerate(signed)}
    found = [(at[r.u], at[r.v]) for r in S.links(rows, 4, blocks, crowd).collect()]
    assert all((prints[u] ^ prints[v]).bit_count() <= 4 for u, v in found)
    group = list(range(len(prints)))
    for _ in group:
        for u, v in found:
            group[u] = group[v] = min(group[u], group[v])
    assert group == components(prints, 4)


def test_near_duplicates(spark):
    dice = random.Random(1)
    base = [" ".join(dice.choice("abcdefgh") * dice.randint(1, 3) for _ in range(300)) for _ in range(4)]
    texts = base + [b + " tail" for b in base] + base[:2] + [None, "", "  ", "alone here"]
    rows = [(i + 10, t, "z") for i, t in enumerate(texts)] + [(10, texts[0], "z"), (None, texts[1], "z"), (None, "nobody else says this", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    want = components([slow_print(t) for _, t, _ in rows], 4)
    least = {}
    for (i, _, _), c in zip(rows, want, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert got == sorted(((i, signed(slow_print(t)), least[c]) for (i, t, _), c in zip(rows, want, strict=True)), key=str)
    kept = S.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(i) for i in least.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0 and S.first_of_each(docs).count() == 0
