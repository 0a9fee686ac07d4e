import base64
import hashlib

import pytest

from spreadlab.llm import warc as W
from spreadlab.llm.common import folder

PAGES = "page_id long, url string, html string, payload string, sha string"


def brute(rows):
    best = {}
    for page, html in rows:
        payload = (html or "").encode()
        best[payload] = max((p for p in (best.get(payload), page) if p is not None), default=None)
    out = []
    for page, html in rows:
        payload = (html or "").encode()
        mark = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = best[payload]
        out.append((page, payload, mark, "response" if page == first else "revisit", None if page == first else first))
    return sorted(out, key=str)


def test_round_trip(spark):
    texts = ["<p>é☃</p>" * 4000, "", None, "\r\n\r\nWARC/1.1\r\n0\r\n\r\n", "same", "same", "same", "x" * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "same"), (6, "same"), (0, texts[0]), (None, "alone")]
    pages = spark.createDataFrame([(p, "http://a/\r\nb" if p else None, t, "clash", "clash") for p, t in rows], PAGES)
    path = folder(spark, "warc-test")
    W.write(pages, path, segment=1000, chunk=300, file_records=7)
    found = W.read(spark, path).collect()
    assert all(r.valid for r in found)
    got = [
        (r.page_id and int(r.page_id), r.payload, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to), r.payload_bytes) for r in found
    ]
    want = brute(rows)
    assert sorted(((a, c, d, e) for a, _, c, d, e, _ in got), key=str) == sorted(((a, c, d, e) for a, _, c, d, e in want), key=str)
    lengths = {c: len(b) for _, b, c, _, _ in want}
    assert all(n == lengths[c] for _, _, c, _, _, n in got)
    assert all(hashlib.sha1(b).digest() == base64.b32decode(c) for _, b, c, d, _, _ in got if d == "response")


def test_empty_table(spark):
    path = folder(spark, "warc-test")
    W.write(spark.createDataFrame([], PAGES), path)
    assert W.read(spark, path).count() == 0


def records(spark, rows):
    return spark.createDataFrame(rows, W.RECORD)


def segment(origin, number, block, total=None):
    first = number == 1
    return (origin if first else f"{origin}-{number}", "response" if first else "continuation", "u", "d", "1", None, None if first else origin, number, total, block)


def test_reassembly_checks_numbers_and_length(spark):
    rows = [segment("a", 2, b"cd"), segment("a", 1, b"ab"), segment("a", 3, b"e", 5)]
    rows += [segment("gap", 1, b"x"), segment("gap", 3, b"y", 2), segment("short", 1, b"x"), segment("short", 2, b"y", 9)]
    rows += [segment("open", 1, b"x"), segment("open", 2, b"y"), segment("lost", 2, b"y", 1)]
    rows += [segment("twice", 1, b"p"), segment("twice", 2, b"q", 2)] * 2
    rows += [("whole", "response", "u", "d", "1", None, None, None, None, b"all")]
    found = sorted((r.record_id, bytes(r.block), r.segments, r.complete) for r in W.reassemble(records(spark, rows)).collect())
    assert found == [
        ("a", b"abcde", 3, True), ("gap", b"xy", 2, False), ("lost", b"y", 1, False), ("open", b"xy", 2, False), ("short", b"xy", 2, False),
        ("twice", b"pq", 2, True), ("twice", b"pq", 2, True), ("whole", b"all", 1, True),
    ]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_chunked_framing(size):
    for payload in (b"", b"a", b"\r\n0\r\n\r\n", bytes(range(256)) * 3):
        assert W.dechunked(W.chunked(payload, size)) == payload


@pytest.mark.parametrize("body", [b"", b"5\r\nab", b"zz\r\n", b"2\r\nabc\r\n0\r\n\r\n"])
def test_broken_framing(body):
    with pytest.raises(ValueError):
        W.dechunked(body)
    assert W.payload_of(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body, "X", False)[3] is False


def test_broken_archive():
    with pytest.raises(ValueError):
        list(W.parse(b"nothing"))
    with pytest.raises(ValueError):
        list(W.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
