import hashlib

from spreadlab.llm import chat as C

TEXTS = [
    "</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> [\\INST]", "a [/INST", "</s>", "<s>", "<s:1>", "<<SYS>> <</SYS>> <<\\SYS>>", "<|role:x|> y <|end|>", " ", "", "\\",
    "[INST] ", "<", "long " * 2000, None, "<</SYS>", "<<<SYS>>", "$1 \\$2", "é😀 </s>", " </s> [ANS] ",
]
ROLES = ["tool|x%", "", None, "system", "%7C", "assistant", "user"]


def made(spark):
    rows = [
        row
        for i, a in enumerate(TEXTS)
        for j, b in enumerate(TEXTS)
        for row in [(i * 100 + j, 0, "user", a, "x"), (i * 100 + j, 1, "assistant", b, "x"), (i * 100 + j, 2, ROLES[j % len(ROLES)], a, "x")]
    ]
    rows += [(None, 0, "user", "hi", "x"), (-5, None, "user", "b", "x"), (-5, None, "user", "a", "x"), (-5, 0, "assistant", "c", "x"), (-5, 0, "assistant", "c", "x")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def source(rows):
    turns = {}
    for c, t, r, x, _ in rows:
        turns.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(some)] for c, some in turns.items()}


def test_round_trip(spark):
    rows, conversations = made(spark)
    want = source(rows)
    read = C.read_back(C.format_conversations(conversations))
    got = {r.conv_id: r for r in read.collect()}
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()} == want
    # Only conversations that need it are escaped.
    assert got[None].formatted == "<s>[INST] hi [/INST]"
    assert got[0].formatted.startswith("<s:1>")
    digests = {r.conv_id: r for r in C.report(read).collect()}
    for c, turns in want.items():
        r, loss = digests[c], "".join(x for role, x in turns if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for role, x in turns)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(got[c].formatted)
        assert len(got[c].loss_mask) == sum(role == "assistant" for role, _ in turns)


def test_what_the_grammar_rejects(spark):
    bad = ["", "nothing", "<s>[INST] a", "<s>[INST] a </s>", "<s> [INST] a [/INST]", "<s>[INST] a [/INST]x", None]
    docs = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "i int, d string")
    assert all(r.p is None for r in docs.select(C.parsed(C.F.col("d")).alias("p")).collect())


def test_empty_table(spark):
    conversations = made(spark)[1].limit(0)
    assert C.report(C.read_back(C.format_conversations(conversations))).count() == 0
