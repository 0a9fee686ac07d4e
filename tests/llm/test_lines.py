import random

import pytest

from spreadlab.llm import lines as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def edited(text, most, letters, dice):
    out = list(text)
    for _ in range(dice.randint(0, most)):
        at, kind = dice.randint(0, len(out)), dice.random()
        if kind < 0.4 or at == len(out):
            out.insert(at, dice.choice(letters))
        elif kind < 0.7:
            out.pop(at)
        else:
            out[at] = dice.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_banded_distance(edits):
    dice = random.Random(3)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("é😀", "😀")]
    for _ in range(2000):
        a = "".join(dice.choice("ab") for _ in range(dice.randint(0, 14)))
        pairs.append((a, edited(a, 4, "abc", dice)))
    assert list(L.within(pairs, edits)) == [distance(a, b) <= edits for a, b in pairs]


def corpus(dice, n):
    seeds = ["".join(dice.choice("abc ") for _ in range(dice.randint(20, 60))).strip() for _ in range(12)]
    return [edited(dice.choice(seeds), 3, "abcd", dice).strip() for _ in range(n)]


def brute(rows, edits=2, min_chars=20):
    """(doc_id, line_no) -> (names of the lines in the class, links, kept)."""
    placed = [(d, i, x.strip()) for d, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip()]
    texts = sorted({x for _, _, x in placed})
    near = {a: {b for b in texts if a != b and min(len(a), len(b)) >= min_chars and distance(a, b) <= edits} for a in texts}
    group = {}
    for x in texts:
        if x not in group:
            todo, seen = [x], {x}
            while todo:
                for y in near[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            group |= dict.fromkeys(seen, frozenset(seen))
    last = float("inf")
    keeper = {}
    for d, i, x in placed:
        keeper[group[x]] = min(keeper.get(group[x], (last, last)), (last if d is None else d, i))
    return {(d, i): (group[x], len(near[x]), keeper[group[x]] == (last if d is None else d, i)) for d, i, x in placed}


@pytest.mark.parametrize("crowd, rounds", [(500, 2), (3, 2), (3, 1), (3, 0)])
def test_classes_match_brute_force(spark, crowd, rounds):
    dice = random.Random(5)
    lines = corpus(dice, 90)
    rows = [(i, "\n".join(dice.choices(lines, k=3)) + "\n\n short \n") for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\t\n"), (None, lines[0] + "\nonly here"), (103, "x" * 5000), (104, "x" * 4999 + "y")]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, line string, id int")
    got = {(r.doc_id, r.line_no): r for r in L.line_duplicates(docs, crowd=crowd, rounds=rounds).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert all((got[k].n_links, got[k].kept) == want[k][1:] for k in want)
    assert len({(got[k].class_id, want[k][0]) for k in want}) == len({got[k].class_id for k in want}) == len({want[k][0] for k in want})


@pytest.mark.parametrize("crowd, rounds", [(3, 1), (3, 0), (500, 2)])
def test_classes_without_all_links_are_the_same(spark, crowd, rounds):
    dice = random.Random(6)
    lines = corpus(dice, 120)
    rows = [(i, x) for i, x in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r for r in L._placed(docs, "doc_id", "text", crowd=crowd, rounds=rounds, all_links=False).collect()}
    want = brute(rows)
    assert set(got) == set(want) and all(got[k].kept == want[k][2] for k in want)
    assert len({(got[k].class_id, want[k][0]) for k in want}) == len({got[k].class_id for k in want}) == len({want[k][0] for k in want})


def test_copies_in_a_crowd_take_few_links(spark):
    base = "a line that thousands of documents hold with a mark at its end or within it "
    lines = [base] + [base[:i] + x + base[i:] for i in range(len(base)) for x in "qz"]
    rows = L.lines_of(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    distinct = rows.select(*L.line_id(L.F.col("line")), L.F.col("line").alias("text"), L.F.length("line").alias("n")).distinct()
    assert L.class_links(distinct, crowd=10).count() <= 30 * len(lines)


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_reach_of_close_texts(edits):
    dice = random.Random(8)
    for _ in range(500):
        hub = "".join(dice.choice("ab") for _ in range(dice.randint(0, 20)))
        a = edited(hub, 6, "abc", dice)
        first, far = L.reach(a, hub, edits)
        assert hub[:first] == a[:first] and (first == min(len(a), len(hub)) or hub[first] != a[first])
        assert far == max(j for j in range(len(hub) + 1) if any(distance(hub[:j], a[:i]) <= edits for i in range(len(a) + 1)))


def test_pairs_of_unlike_lines_in_a_crowd_are_few(spark):
    dice = random.Random(9)
    base = "".join(dice.choice("abcdefgh ") for _ in range(300))
    spots = [(dice.randint(0, 300), "".join(dice.choices("stuvwxyz", k=5))) for _ in range(150)]
    lines = [base[:i] + x + base[i:] for i, x in spots]
    lines += [edited(x, 1, "abc", dice) for x in lines[:15]]
    rows = [(i, x, len(x)) for i, x in enumerate(dict.fromkeys(lines))]
    got = {(r.a, r.b) for r in L.candidates(spark.createDataFrame(rows, "id long, text string, n int")).collect()}
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    near = L.within([(rows[i][1], rows[j][1]) for i, j in pairs], 2)
    assert {(j, i) for (i, j), x in zip(pairs, near, strict=True) if x} <= got
    assert len(got) <= 20 * len(rows)


def test_texts_without_duplicates(spark):
    rows = [(2, "a line\n\nkept here\na line", "x"), (1, "a line\nand more", "y"), (3, "a line", "z"), (4, None, None), (4, None, None), (5, "", "q"), (None, "kept here\nnew", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    got = L.without_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(
        [(2, "\nkept here", "x"), (1, "a line\nand more", "y"), (3, "", "z"), (4, None, None), (4, None, None), (5, "", "q"), (None, "new", "n")], key=str
    )


def test_rows_of_one_id_lose_only_their_own_lines(spark):
    rows = [(1, "said before"), (None, "said before\nfirst alone"), (None, "second alone\nsaid before"), (7, "third alone\nsaid before"), (7, "said before\nfourth alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in L.without_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, "said before"), (None, "first alone"), (None, "second alone"), (7, "third alone"), (7, "fourth alone")], key=str)


def test_one_line_stays_of_those_without_id(spark):
    docs = spark.createDataFrame([(None, "twice here\none"), (None, "twice here\nother"), (3, "a\nb"), (3, "b\na")], "doc_id long, text string")
    assert sorted("".join(r.text for r in L.without_duplicates(docs).collect())) == sorted("twice here\none" + "other" + "a\nb")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_duplicates(docs).count() == 0 and L.without_duplicates(docs).count() == 0
