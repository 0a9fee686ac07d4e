"""Alignment of two tokenizers against whole texts, byte by byte."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spreadlab.llm import alignment

TEXTS = [
    "The quick brown fox, and the fox.\nAnother line\n\nwith  two spaces\t tab",
    "héllo 世龘界 😀 ok<|endoftext|></s> <unk> ▁x",
    " leading and trailing \n",
    "ñandú ́ é ﬁ 1234567 don't we'll\r\nx   y z\x1c a\x85b",
    "word " * 300 + "x" * 5000 + " 龘" * 50,
    "a\0b <0x41> ▁",
    "👩‍👩‍👧 family",
]


ALIGNER = alignment.Aligner()


@pytest.fixture(scope="module")
def aligner():
    return ALIGNER


def whole(aligner, text):
    """Tokens of the whole text by both libraries and their bytes, without any cut."""
    a = aligner.first.encode(" " + text, add_special_tokens=False).ids
    b = aligner.second.encode(text)
    return a, b, [aligner.first_bytes[i] for i in a], [aligner.second_bytes[i] for i in b]


def brute(aligner, text):
    a, b, a_bytes, b_bytes = whole(aligner, text) if text else ([], [], [], [])
    raw = (" " + (text or "")).encode()
    if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return 0, 0, 0, "", []
    owners = [[i for i, part in enumerate(parts) for _ in part] for parts in (a_bytes, b_bytes)]
    links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(*owners))]
    ends = [{sum(map(len, parts[: i + 1])): i + 1 for i in range(len(parts))} for parts in (a_bytes, b_bytes)]
    groups, i, j = [], 0, 0
    for end in sorted(ends[0].keys() & ends[1].keys()):
        groups.append(",".join(map(str, a[i : ends[0][end]])) + "|" + ",".join(map(str, b[j : ends[1][end]])))
        i, j = ends[0][end], ends[1][end]
    return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def same(aligner, text):
    (found,) = aligner.align([text])
    a, b, groups, digest, links = brute(aligner, text)
    assert found[:4] == (a, b, groups, digest)
    assert Counter(found[4].tolist()) == Counter(x * alignment.IDS + y for x, y in links)


@pytest.mark.parametrize("text", [*TEXTS, "", None])
def test_texts(aligner, text):
    same(aligner, text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.'aeé世▁1́\r\x85")), max_size=40))
def test_cut_texts_equal_whole_ones(aligner, text):
    same(aligner, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n.'aeé世▁")), max_size=20), max_size=12))
def test_parts_learned_together(texts):
    fresh = ALIGNER
    fresh.forget()
    for text, found in zip(texts, fresh.align(texts)):
        a, b, groups, digest, links = brute(fresh, text)
        assert found[:4] == (a, b, groups, digest)
        assert Counter(found[4].tolist()) == Counter(x * alignment.IDS + y for x, y in links)


def test_refined_ends():
    def ends(spans, widths, decoded):
        spans, at = np.array(spans), np.concatenate([[0], np.cumsum(widths)])
        return alignment.refined_ends(spans[:, 0], spans[:, 1], at, np.array([len(d) for d in decoded])).tolist()

    # Three tokens of one character, reported as one span each, then a plain one.
    assert ends([(0, 1), (0, 1), (0, 1), (1, 2)], [3, 1], [b"\xe4", b"\xb8", b"\x96", b"x"]) == [1, 2, 3, 4]
    # Byte fallback: all but the last token have an empty span.
    assert ends([(0, 3), (3, 3), (3, 3), (3, 4)], [1, 1, 1, 3], [b"abc", b"\xe9", b"\xbe", b"\x98"]) == [3, 4, 5, 6]
    assert ends([(0, 4), (4, 5)], [1] * 5, [b"abcd", b"e"]) == [4, 5]


def expected(aligner, texts):
    rows = [brute(aligner, t) for t in texts]
    counts = Counter(link for row in rows for link in set(row[4]))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    return [
        (r[0], r[1], r[2], len(r[4]), sum(counts[x] == most[x[0]] for x in r[4]), sum(counts[x] for x in r[4]), r[3]) for r in rows
    ]


@pytest.mark.parametrize("links", [1, 50, alignment.BLOCK_LINKS])
def test_counts_over_all_rows(spark, aligner, links):
    texts = [*TEXTS, "", None, "the fox and the fox", "the fox and the fox", "the dog and the fox", "龘", "▁"]
    ids = [*range(len(texts) - 3), None, 2, None]
    rows = [(i, t, 5, "z") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long, pair string").repartition(3)
    found = alignment.align(docs, block_links=links).collect()
    wanted = Counter((i, *row) for i, row in zip(ids, expected(aligner, texts)))
    assert Counter(tuple(r) for r in found) == wanted


def test_no_rows_and_no_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.align(docs).collect()) == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]
    assert alignment.align(docs.limit(0)).count() == 0


def test_worker_forgets(monkeypatch, aligner):
    monkeypatch.setattr(alignment, "KNOWN_PARTS", 3)
    for text in TEXTS:
        same(aligner, text)
