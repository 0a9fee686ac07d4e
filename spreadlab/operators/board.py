"""The joined table of original posts, its filter language, sorting and paging."""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlab.functions.columns import hashtags_in_text, level_rank, pseudonym, rounded, yes_no
from spreadlab.operators.posts import flat, originals, window

log = logging.getLogger(__name__)

# The public columns of the board, in order.
PUBLIC = (
    "ID",
    "User",
    "Text",
    "Retweets",
    "Is usual suspect",
    "Party",
    "Multimodal",
    "Profiling",
    "Suspicious content",
    "Legitimacy",
    "Reputation",
    "Status",
    "Author ID",
)


def board(posts: DataFrame, fact_checks: DataFrame, profiles: DataFrame, text_scores: DataFrame, standing: DataFrame) -> DataFrame:
    """Originals with evidence and profile flags, fakeness and standing levels.

    The side tables are merged by key before they meet the posts, so the texts
    cross the network twice rather than once per table.
    """
    by_post = (
        fact_checks.select(
            F.col("tweet_id").alias("id"), F.lit(True).alias("checked"), F.lit(None).cast("double").alias("fakeness")
        )
        .unionByName(
            text_scores.select(
                F.col("id_str").alias("id"), F.lit(False).alias("checked"), F.col("fakeness_probabilities").alias("fakeness")
            )
        )
        .groupBy("id")
        .agg(F.bool_or("checked").alias("checked"), F.max("fakeness").alias("fakeness"))
    )
    levels = ["legitimacy_level", "reputation_level", "status_level"]
    by_author = (
        profiles.select(F.col("user_id").alias("author_id"), F.lit(True).alias("profiled"))
        .unionByName(standing.select("author_id", *levels), allowMissingColumns=True)
        .groupBy("author_id")
        .agg(F.bool_or("profiled").alias("profiled"), *[F.max(c).alias(c) for c in levels])
    )
    rows = flat(originals(posts)).join(by_author, "author_id", "left").join(by_post, "id", "left")
    return rows.select(
        F.col("id").alias("ID"),
        F.col("username").alias("User"),
        F.col("text").alias("Text"),
        F.col("retweet_count").alias("Retweets"),
        F.col("is_usual_suspect").alias("Is usual suspect"),
        F.col("party").alias("Party"),
        F.coalesce("checked", F.lit(False)).alias("Multimodal"),
        F.coalesce("profiled", F.lit(False)).alias("Profiling"),
        F.col("fakeness").alias("Suspicious content"),
        F.col("legitimacy_level").alias("Legitimacy"),
        F.col("reputation_level").alias("Reputation"),
        F.col("status_level").alias("Status"),
        F.col("author_id").alias("Author ID"),
        hashtags_in_text(F.col("text")).alias("hashtags"),
        "created_at",
    )


def by_retweets(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("Retweets"), "ID")


# The operators of the filter language and their symbols.
_WORDS = {"ge": ">=", "le": "<=", "lt": "<", "gt": ">", "ne": "!=", "eq": "="}
_PART = re.compile(
    r"^\s*\{(?P<column>[^{}]*)\}\s*(?P<op>>=|<=|!=|<|>|=|[A-Za-z]+)\s*(?P<value>.*?)\s*$", re.DOTALL
)
_COMPARE = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "!=": lambda a, b: a != b,
    "=": lambda a, b: a == b,
}


def _value(text: str) -> str:
    quote = text[:1]
    if len(text) > 1 and quote in "'\"`" and text[-1] == quote:
        return text[1:-1].replace("\\" + quote, quote)
    return text


def _truth(text: str) -> bool:
    return text.lower() in ("yes", "true")


def _text_of(table: DataFrame, name: str) -> Column:
    if isinstance(table.schema[name].dataType, T.TimestampType):
        return F.date_format(F.col(f"`{name}`"), "yyyy-MM-dd HH:mm:ss")
    return F.col(f"`{name}`").cast("string")


def board_condition(table: DataFrame, text: str) -> Column:
    """Condition for ``{column} op value`` parts joined by `` && ``.

    Comparisons take words (ge, le, lt, gt, ne, eq) or symbols; ``contains`` is a
    case-insensitive pattern, or yes/true on the two flags; ``datestartswith`` is
    a case-insensitive prefix. A part that is not understood is skipped with a
    warning.
    """
    condition = F.lit(True)
    for part in text.split(" && "):
        match = _PART.match(part)
        op = match and _WORDS.get(match["op"].lower(), match["op"].lower())
        if not match or match["column"] not in table.columns:
            log.warning("filter part %r skipped", part)
            continue
        name, value = match["column"], _value(match["value"])
        kind = table.schema[name].dataType
        if op in _COMPARE:
            right = F.lit(_truth(value)) if isinstance(kind, T.BooleanType) else F.lit(value)
            if isinstance(kind, T.NumericType):
                right = F.expr("try_cast(%s AS double)" % _quoted(value))
            elif isinstance(kind, T.TimestampType):
                right = F.expr("try_cast(%s AS timestamp)" % _quoted(value))
            condition &= _COMPARE[op](F.col(f"`{name}`"), right)
        elif op == "contains" and isinstance(kind, T.BooleanType):
            condition &= F.col(f"`{name}`") == _truth(value)
        elif op == "contains":
            condition &= _text_of(table, name).rlike(f"(?iu){value}")
        elif op == "datestartswith":
            condition &= _text_of(table, name).rlike(f"(?iu)^{value}")
        else:
            log.warning("unknown operator %r in filter %r skipped", op, part)
    return condition


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def select_board(
    table: DataFrame,
    start=None,
    end=None,
    hashtags=(),
    query: str | None = None,
    sort_by: Sequence[dict] = (),
    skip: int | None = None,
    amount: int | None = None,
) -> DataFrame:
    """A page of the board: window, filter, sort, public columns, skip and limit.

    Sorting ends with the post id, so pages never overlap.
    """
    rows = window(table, start, end, hashtags, mode="board")
    if query:
        rows = rows.where(board_condition(table, query))
    if sort_by or skip is not None or amount is not None:
        order = [
            F.col(f"`{c['column_id']}`").asc() if c["direction"] == "asc" else F.col(f"`{c['column_id']}`").desc()
            for c in sort_by
        ]
        rows = rows.orderBy(*order, F.col("ID").asc())
    rows = rows.select(*[F.col(f"`{c}`") for c in PUBLIC])
    if skip is not None:
        rows = rows.offset(skip)
    return rows if amount is None else rows.limit(amount)


def board_size(table: DataFrame, start=None, end=None, hashtags=(), page_size: int = 10) -> DataFrame:
    """Rows in a window of the board and pages needed to show them."""
    rows = window(table, start, end, hashtags, mode="board")
    return rows.agg(F.count(F.lit(1)).alias("size")).withColumn("pages", F.ceil(F.col("size") / page_size))


def page_count(size: int, page_size: int) -> int:
    return math.ceil(size / page_size)


def rendered(page: DataFrame, anonymous: bool = True) -> DataFrame:
    """Board rows as shown: flags as Yes/No, two decimals, names replaced by pseudonyms."""
    page = page.withColumn("Multimodal", yes_no(F.col("Multimodal"))).withColumn("Profiling", yes_no(F.col("Profiling")))
    page = page.withColumn("Suspicious content", rounded(F.col("`Suspicious content`")))
    return page.withColumn("User", pseudonym(F.col("User"))) if anonymous else page


def level_order(table: DataFrame) -> DataFrame:
    """Numeric sort keys for the three level columns."""
    return table.select("*", *[level_rank(F.col(c)).alias(f"{c} rank") for c in ("Legitimacy", "Reputation", "Status")])
