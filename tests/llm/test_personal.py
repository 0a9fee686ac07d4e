import hashlib
import math
import re
import time
from collections import Counter

import pytest

from spreadlab.llm import personal as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "mail a@b.cd@e.fg_h@i.jk 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (234) 567-890x +12 3 4111-1111-1111-1111-1111-1111 01.002.0255.256 ☃😀 x@y.z 5555555555554444",
    None, "", "9" * 5000 + " " + "a" * 30_000 + "@" + "b." * 3000, "1 2 3 4 5 6 7 8 9 0 1 2 3 +1-+2 345 678 9012", "x@y @z.w a@b. c@-.- %@1.2",
    "same zebra me@x.org Zebra", "more zebra 12345 me@x.org", "some zebra ME@x.org, (zebra)", "+1 (555) 010-9999 4111 1111 1111 1112 256.1.1.1 1.1.1.1",
    "no personal data but zebra", "4111-1111-1111-1111 4111 1111 1111 1111", "☃ 😀 00000000000000 0000000000000 +123456789 +1.2.3.4.5.6.7.8.9",
]


def digits(x):
    return re.sub("[^0-9]", "", x)


def luhn(x):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(x[::-1])) % 10 == 0


def holds(kind, x):
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in x.split(".")),
        "card": lambda: 13 <= len(digits(x)) <= 19 and luhn(digits(x)), "phone": lambda: 9 <= len(digits(x)) <= 15,
    }[kind]()


def base(text):
    return {k: [(m.start(), m.end(), m[0]) for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in PLAIN.items()}


def terms(texts, support, threshold):
    """The disclosing (entity, word) pairs by counting everything."""
    norm = {"email": str.lower, "ip": str, "card": digits, "phone": digits}
    holders, words = [], []
    for t in texts:
        holders.append({f"{k}:{norm[k](v)}" for k, spans in base(t).items() for _, _, v in spans})
        plain = t or ""
        for p in PLAIN.values():
            plain = re.sub(p, " ", plain)
        words.append(set(re.findall(r"[^\W_]+", plain.lower())))
    n = len(texts)
    n_e, n_t, n_te, differ = Counter(), Counter(), Counter(), {}
    for t, es, ws in zip(texts, holders, words, strict=True):
        n_e.update(es)
        n_t.update(ws)
        n_te.update((e, w) for e in es for w in ws)
        for e in es:
            for w in ws:
                differ.setdefault((e, w), set()).add(t)
    told = {
        (e, w) for (e, w), c in n_te.items() if len(differ[e, w]) >= support and math.log2(n * c / (n_e[e] * n_t[w])) >= threshold * math.log2(n / n_e[e])
    }
    return [ws & {w for _, w in told} for ws in words]


@pytest.fixture(scope="module")
def made(spark):
    texts = TEXTS + [TEXTS[6]] * 3 + [f"filler {i} text" for i in range(20)]
    rows = [(i if i != 7 else None, t, "clash", "clash") for i, t in enumerate(texts)]
    return texts, spark.createDataFrame(rows, "doc_id long, text string, term string, entity string")


def test_spans_match_brute_force(made):
    texts, docs = made
    told = terms(texts, 3, 0.9)
    assert any(told)
    want = []
    for i, t in enumerate(texts):
        spans = base(t)
        written = [f"{k}:{a}:{b}" for k in PLAIN for a, b, _ in spans[k]]
        taken = [(a, b) for some in spans.values() for a, b, _ in some]
        found = [m.span() for m in re.finditer(r"[^\W_]+", t or "") if m[0].lower() in told[i]]
        added = [f"term:{a}:{b}" for a, b in found if all(b <= c or d <= a for c, d in taken)]
        counts = [len(spans[k]) for k in PLAIN]
        digest = hashlib.sha256(",".join(written).encode()).hexdigest()
        want.append((i if i != 7 else None, *counts, digest, ",".join(written + added)))
    got = [tuple(r) for r in P.report(P.find(docs)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sanitised_text(made):
    texts, docs = made
    found = {r.doc_id: r.sanitised for r in P.sanitised(P.find(docs)).collect()}
    assert found[6] == "same  [EMAIL] [NAME]"
    assert found[8] == "some  [EMAIL], ()"
    # The number's match goes on over all that follows, has too many digits and is not tried again.
    assert found[9] == "+1 (555) 010-9999 4111 1111 1111 1112 256.1.1.1 [IP]"
    # A disclosing term goes also where the value itself does not stand.
    assert found[10] == "no personal data but "
    assert found[1] is None and found[2] is None


def test_more_support_adds_nothing(made):
    _, docs = made
    assert not any("term" in r.spans for r in P.report(P.find(docs, support=4)).collect())


def test_empty_table(made):
    assert P.report(P.find(made[1].limit(0))).count() == 0


def test_many_spans_in_one_text(spark):
    n = 32_000
    docs = spark.createDataFrame([(1, " ".join(f"u{i}@x.org" for i in range(n)))], "doc_id long, text string")
    began = time.monotonic()
    row = P.report(P.find(docs)).first()
    assert row.n_email == n and row.spans.endswith(f"email:{len(docs.first().text) - 12}:{len(docs.first().text)}")
    assert time.monotonic() - began < 60
