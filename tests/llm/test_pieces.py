import random

import pytest

from spreadlab.llm import pieces as P


@pytest.fixture(scope="module")
def model():
    return P.load()


TEXTS = [
    None, "", " ", "a", "The quick brown fox", "word\nNext  line", "   " * 20 + "a" + "  \n\n " * 20, "漢字 ☃ é" * 20, "=-" * 100, "x" * 150, "\n", "▁ literal",
    "tion anened " * 40, "0123456789 +1 (234)",
]


def slow_ids(text, model):
    """The best segmentation over the whole text, one position after another."""
    whole = P.normalised(text or "", model)
    best = [(0, [])]
    for end in range(1, len(whole) + 1):
        options = []
        for at in range(max(0, end - model.longest), end):
            score = model.scores.get(whole[at:end], model.worst if at == end - 1 else None)
            if score is not None:
                options.append((best[at][0] + score, -at))
        top, at = max(options)
        best.append((top, [*best[-at][1], whole[-at:end]]))
    return [i for p in best[-1][1] for i in P.ids_of(p, model)]


@pytest.mark.parametrize("chunk", [5, 33, 1000])
def test_chunks_do_not_matter_and_text_comes_back(spark, model, chunk):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "a", ""), (None, TEXTS[4], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = P.decode(P.encode(docs, model, chunk))
    want = sorted(((i, slow_ids(t, model), (t or "").replace("▁", " ")) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in coded.collect()), key=str) == want


def test_long_words_without_spaces(model):
    dice = random.Random(6)
    for signs in ("漢字中文日本語", "0123456789", "กขคงจ", "a漢1"):
        text = "".join(dice.choices(signs, k=5000))
        whole = P.normalised(text, model)
        assert P.Encoder(model).encode(whole).tolist() == slow_ids(text, model)


def test_matrices_of_any_vocabulary(model):
    """A vocabulary whose pieces span words: no cuts, only matrices."""
    dice = random.Random(2)
    letters = "ab▁\n"
    scores = {c: -dice.randint(1, 9) for c in letters} | {"".join(dice.choices(letters, k=dice.randint(2, 5))): -dice.randint(1, 12) for _ in range(40)}
    names = list(scores)
    own = P.Model({p: i for i, p in enumerate(names)}, scores, [*names, "?"], [], len(names), False, False)
    assert not own.cuts
    for _ in range(30):
        text = "".join(dice.choices(letters + "z", k=dice.randint(1, 60)))
        size = dice.randint(1, 9)
        parts = [(text[max(0, i - own.longest) : i], text[i : i + size]) for i in range(0, len(text), size)]
        matrices = P.np.stack([P.transfer(c, t, own) for c, t in parts])
        entries = P.scan(matrices)
        total = P._product(entries[-1:], matrices[-1])[0, 0]
        state, found = 0, []
        for (c, t), entry in zip(reversed(parts), reversed(entries), strict=True):
            if state > len(t):
                state -= len(t)
                continue
            state, some = P.trace(c, t, entry, [state], own)[state]
            found = some + found
        assert found == P.segment(text, own)
        assert total == sum(own.scores.get(p, own.worst) for p in found)


def test_product_is_associative():
    dice = P.np.random.default_rng(1)
    a, b, c = (dice.integers(-50, 0, (4, 4)) for _ in range(3))
    assert (P._product(P._product(a, b), c) == P._product(a, P._product(b, c))).all()


def test_library_agrees(model):
    """The library's lattice, set to the same algorithm, finds segmentations of the same score."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as protocol

    proto = protocol.ModelProto()
    with open(P.MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1  # unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    dice = random.Random(3)
    encoder = P.Encoder(model)
    for _ in range(200):
        text = " ".join("".join(dice.choices(["th", "er", "ing", "on", "é", "a", "tion", ",", "B"], k=dice.randint(1, 5))) for _ in range(dice.randint(1, 6)))
        best = library.nbest_encode(text, nbest_size=2)[0]
        mine = encoder.encode(P.normalised(text, model))
        assert sum(map(library.get_score, map(int, mine))) == sum(map(library.get_score, best))
        assert library.decode(mine.tolist()) == text


def test_too_large_model(spark, model, monkeypatch):
    monkeypatch.setattr(P, "MOST_PIECES", 10)
    with pytest.raises(ValueError):
        P.encode(spark.createDataFrame([], "doc_id long, text string"), model)


def test_empty_table(spark, model):
    assert P.decode(P.encode(spark.createDataFrame([], "doc_id long, text string"), model)).count() == 0


def test_broken_ids(spark, model):
    rows = spark.createDataFrame([(None,), ([],), ([model.bytes_at[0xE9]],), ([1, 2],)], "ids array<int>")
    assert [r.decoded for r in P.decode(rows, model).collect()] == ["", "", "", ""]
