"""Conversations as one text with marked turns, parsed back and compared until nothing is lost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import text_of

# The template, as fixed values. A document is <s> or <s:1>, the number of escapes in its
# texts, and then its turns:
#   user       [INST] text [/INST]
#   assistant  [ANS] text </s>
#   system     <<SYS>> text <</SYS>>
#   any other  <|role:name|> text <|end|>
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("<|role:", "|> ", " <|end|>")
START, START_ESCAPED = "<s>", "<s:1>"
# A turn as the grammar reads it: mark, name, text, end mark. A text holds no mark.
TURN = r"(?s)(\[INST\] |\[ANS\] |<<SYS>> |<\|role:([^|]*)\|> )(.*?)( \[/INST\]| </s>| <</SYS>>| <\|end\|>)"
# Control strings, behind their first character any number of escapes.
CONTROL = r"([<\[])(\\*)(/?INST\]|ANS\]|/?s>|s:[0-9]>|</?SYS>>|/SYS>>|\|role:|\|end\|>)"
ESCAPED = r"([<\[])\\(\\*)(/?INST\]|ANS\]|/?s>|s:[0-9]>|</?SYS>>|/SYS>>|\|role:|\|end\|>)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def escape(text: Column) -> Column:
    """A backslash more behind the first character of each control string, so that none is left."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def _name(role: Column) -> Column:
    """A role's name without the characters that end it."""
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))


def _role(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))


def rendered(turns: Column, start: str) -> Column:
    """The document of an array of turns (role, text)."""

    def one(turn: Column) -> Column:
        marked = F.concat(F.lit(OTHER[0]), _name(turn["role"]), F.lit(OTHER[1]), turn["text"], F.lit(OTHER[2]))
        for role, (before, after) in MARKS.items():
            marked = F.when(turn["role"] == role, F.concat(F.lit(before), turn["text"], F.lit(after))).otherwise(marked)
        return marked

    return F.concat(F.lit(start), F.array_join(F.transform(turns, one), ""))


def parsed(document: Column) -> Column:
    """array<struct<role, text, start, end>> that the grammar reads; positions are of the text in the document, in code points.

    Null if the document is not of the grammar: what lies between the turns must be
    empty, and each mark must end as it began.
    """
    start = F.when(F.startswith(document, F.lit(START_ESCAPED)), F.lit(START_ESCAPED)).when(F.startswith(document, F.lit(START)), F.lit(START))
    body = F.substring(document, F.length(start) + 1, F.length(document))
    part = lambda i: F.regexp_extract_all(body, F.lit(TURN), F.lit(i))
    found = F.arrays_zip(part(1).alias("mark"), part(2).alias("name"), part(3).alias("text"), part(4).alias("end"))

    def turn(x: Column) -> Column:
        role, right = _role(x["name"]), x["end"] == OTHER[2]
        for name, (before, after) in MARKS.items():
            here = x["mark"] == before
            role, right = F.when(here, name).otherwise(role), F.when(here, x["end"] == after).otherwise(right)
        plain = F.when(start == START, x["text"]).otherwise(unescape(x["text"]))
        return F.struct(role.alias("role"), plain.alias("text"), right.alias("right"), F.length(x["mark"]).alias("before"), F.length(x["text"]).alias("long"), F.length(x["end"]).alias("after"))

    def checked(turns: Column) -> Column:
        length = F.aggregate(turns, F.lit(0), lambda n, t: n + t["before"] + t["long"] + t["after"])
        return F.when((length == F.length(body)) & F.forall(turns, lambda t: t["right"]), turns)

    return _once(F.transform(found, turn), checked)


def _same(turns: Column, back: Column) -> Column:
    return F.coalesce(F.transform(back, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == turns, F.lit(False))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted): each conversation in the template.

    The rows of a conversation are its turns in the order of ``turn`` (equal and null
    turns by role and text, null first); a null role or text counts as empty. The text is
    rendered, parsed back and compared with the source; only where they differ are its
    control strings escaped, until they are identical, which the result is: a conversation
    that could not be read back would fail the job. Repeated rows are turns like any
    other; a null conv_id is a conversation. Other columns are not read.
    """
    rows = conversations.select("conv_id", F.struct("turn", text_of("role").alias("role"), text_of("text").alias("text")).alias("row"))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    turns = gathered.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))
    escaped = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text")))
    source, lost = F.col("turns"), F.raise_error(F.lit("a conversation is not read back identically"))

    def until_identical(ways: list[Column]) -> Column:
        if not ways:
            return lost
        return _once(ways[0], lambda tried: F.when(_same(source, parsed(tried)), tried).otherwise(until_identical(ways[1:])))

    ways = [rendered(source, START), rendered(escaped, START_ESCAPED)]
    return turns.select("conv_id", until_identical(ways).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_mask): turns as parsed, and the spans of ``formatted`` that a loss is taken on.

    ``turns`` is array<struct<role, text>>, ``loss_mask`` array<struct<start, end>> in code
    points: the texts of the assistant, escapes included.
    """
    read = formatted.withColumn("parsed", parsed(F.col("formatted")))
    first = F.length("formatted") - F.aggregate("parsed", F.lit(0), lambda n, t: n + t["before"] + t["long"] + t["after"])
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + t["before"]
        mask = F.when(t["role"] == "assistant", F.array_append(acc["mask"], F.struct(start.alias("start"), (start + t["long"]).alias("end")))).otherwise(acc["mask"])
        return F.struct((start + t["long"] + t["after"]).alias("at"), mask.alias("mask"))

    mask = F.aggregate("parsed", F.struct(first.alias("at"), none.alias("mask")), step, lambda acc: acc["mask"])
    turns = F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return read.select("conv_id", "formatted", turns.alias("turns"), mask.alias("loss_mask"))


def report(read: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, both as read back."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole, escaped = F.col("formatted"), F.startswith("formatted", F.lit(START_ESCAPED))
    under = F.transform("loss_mask", lambda m: F.substring(whole, m["start"] + 1, m["end"] - m["start"]))
    loss = F.array_join(F.when(escaped, F.transform(under, unescape)).otherwise(under), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
