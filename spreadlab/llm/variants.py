"""Spelling variants: words one edit apart, found by bidirectional FM-index search schemes.

The vocabulary is laid out in blocks of neighbouring words. Each block holds an index of its
delimited words: for both reading directions, the rows of the sorted suffixes by the symbol before
them, so that one lookup narrows an interval of suffix ranks by a symbol.

One edit leaves the first or the last half of a word as it is. Blocks of words in order answer
the first scheme (the first half matches exactly, the rest with at most one error, reading forward),
blocks of words in the order of their mirror images the second (the last half, reading
backward). A half is looked for only in the blocks whose words can begin with it.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import ascii_lower, keep, text_of

RUN = r"[A-Za-zÀ-ÿ]"
LETTERS = 6
OCCURRENCES = 5
# A word stands for another if it is this many times as frequent.
RATIO = 5
# Code points of a block of the vocabulary, on average.
BLOCK = 1 << 18
# Queries of a block that are searched together.
TOGETHER = 1 << 14


def words(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, damage: int = 199) -> DataFrame:
    """(word, n): the runs of letters in all whole texts with their number of occurrences.

    One in ``damage`` runs, by a hash of the document and the run, loses a code point before it
    is counted. A null id counts as the empty text in the hash, a null text has no runs.
    """
    # Runs only get shorter, so shorter ones cannot count.
    found = F.regexp_extract_all(text_of("text"), F.lit(f"{RUN}{{{letters},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    runs = runs.select("doc", ascii_lower(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    lost = (F.col("h") % F.col("size")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), lost), F.substring("run", lost + 2, F.col("size")))
    word = F.when(F.col("h") % damage == 0, shorter).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= occurrences)


# --------------------------------------------------------------------- index


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """The rank of every suffix, by doubling the compared length; the last symbol is the smallest."""
    rank = symbols.astype(np.int64)
    size, n = 1, len(symbols)
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[:-size] = rank[size:]
        key = rank * (n + 2) + ahead + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) > 0]))
        if size >= n or new.max(initial=0) == n - 1:
            return new
        rank, size = new, size * 2


class Index:
    """Suffix ranks of delimited words, read so that an interval is extended by the symbol before a suffix.

    ``narrow`` maps intervals of suffixes that start with a string x to those that start with c + x.
    Words are given mirrored where extension is to be at their end.
    """

    def __init__(self, words: list[str]):
        # The delimiter is 0; it stands before, between and behind the words.
        self.words = sorted(words)
        joined = np.array([ord(c) for c in "\0" + "\0".join(self.words) + "\0"], np.int64)
        self.alphabet, symbols = np.unique(joined, return_inverse=True)
        rank = suffix_ranks(symbols)
        self.n = len(symbols)
        # The rows that a symbol stands before, by symbol and row.
        self.keys = np.sort(symbols[np.arange(self.n) - 1] * (self.n + 1) + rank)
        first = np.empty(self.n, np.int64)
        first[rank] = np.arange(self.n)
        self.before = symbols[first - 1]

    def codes(self, text: str) -> np.ndarray:
        """The symbols of a text, -1 for those that no word holds."""
        points = np.array([ord(c) for c in text], np.int64)
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == points, at, -1)

    def narrow(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = symbol * (self.n + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def before_any(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which interval, symbol, low, high) of every extension of the intervals by a letter."""
        span = np.stack([low, high], 1)
        nodes, which = np.unique(span, axis=0, return_inverse=True)
        which = which.reshape(-1)
        size = nodes[:, 1] - nodes[:, 0]
        row = np.repeat(np.arange(len(nodes)), size)
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        pairs = np.unique(row * len(self.alphabet) + self.before[nodes[row, 0] + offset])
        row, symbol = pairs // len(self.alphabet), pairs % len(self.alphabet)
        row, symbol = row[symbol > 0], symbol[symbol > 0]
        new_low, new_high = self.narrow(nodes[row, 0], nodes[row, 1], symbol)
        begin, end = np.searchsorted(row, which), np.searchsorted(row, which, side="right")
        many = end - begin
        source = np.repeat(np.arange(len(which)), many)
        child = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        return source, symbol[child], new_low[child], new_high[child]


def near(index: Index, queries: list[str], halves: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers: words that start with a query's half and differ from the query by one edit behind it.

    ``index`` holds mirrored words, so that extending by the symbol before a suffix appends to what was
    read. Words are numbered in the order of their mirror images.
    """
    size = np.array([len(q) for q in queries], np.int64)
    half = np.array(halves, np.int64)
    starts = np.cumsum(size + 1) - size - 1
    # Queries end with the delimiter, as words do.
    flat = np.concatenate([np.append(index.codes(q), 0) for q in queries])
    n = index.n
    q = np.arange(len(queries))
    # The rows of the delimiter: what was read so far is the border before the word.
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(index.words) + 1, np.int64)
    for i in range(int(half.max(initial=0))):
        on = i < half[q]
        symbol = flat[starts[q] + np.minimum(i, half[q])]
        new_low, new_high = index.narrow(low, high, np.maximum(symbol, 0))
        low, high = np.where(on, new_low, low), np.where(on, new_high, high)
        left = ~on | ((symbol >= 0) & (high > low))
        q, low, high = q[left], low[left], high[left]
    at = half[q]
    # States: query, how much of it was read, interval, whether the error is spent.
    exact = (q, at, low, high)
    spent = tuple(np.empty(0, np.int64) for _ in range(4))
    found = []
    while len(exact[0]) or len(spent[0]):
        q, at, low, high = exact
        more = at < size[q]
        # The error: a symbol put in before the next one, one in its place, or the next one left out.
        source, symbol, new_low, new_high = index.before_any(low, high)
        put_in = (q[source], at[source], new_low, new_high)
        here = flat[starts[q] + at]
        other = more[source] & (symbol != here[source])
        instead = (q[source][other], at[source][other] + 1, new_low[other], new_high[other])
        left_out = (q[more], at[more] + 1, low[more], high[more])
        state = [np.concatenate(x) for x in zip(spent, put_in, instead, left_out)]
        # Read on: the spent ones match the rest exactly, up to the delimiter.
        q, at, low, high = state
        symbol = flat[starts[q] + at]
        new_low, new_high = index.narrow(low, high, np.maximum(symbol, 0))
        alive = (symbol >= 0) & (new_high > new_low)
        # Row 0 is the last delimiter, before no word.
        done = alive & (at == size[q]) & (new_low > 0)
        found.append((q[done], new_low[done] - 1))
        going = alive & (at < size[q])
        spent = (q[going], at[going] + 1, new_low[going], new_high[going])
        q, at, low, high = (x[more] for x in exact)
        symbol = flat[starts[q] + at]
        new_low, new_high = index.narrow(low, high, np.maximum(symbol, 0))
        alive = (symbol >= 0) & (new_high > new_low)
        exact = (q[alive], at[alive] + 1, new_low[alive], new_high[alive])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.concatenate([a * n + b for a, b in found]))
    return pairs // n, pairs % n


# -------------------------------------------------------------------- search


def _search(scheme: int, together: int):
    """Search a block's queries in its words; scheme 1 reads words and queries mirrored."""

    def of(block: pd.DataFrame, asked: pd.DataFrame) -> Iterator[pd.DataFrame]:
        way = slice(None, None, -1) if scheme else slice(None)
        # Extension is at the front of suffixes: the index holds the mirror images of what is read.
        index = Index([w[way][::-1] for w in block["word"]])
        names = np.array([w[::-1][way] for w in index.words], object)
        for i in range(0, len(asked), together):
            queries = asked["word"].iloc[i : i + together].tolist()
            half = [len(q) // 2 if scheme == 0 else len(q) - len(q) // 2 for q in queries]
            a, b = near(index, [q[way] for q in queries], half)
            out = pd.DataFrame({"word": np.array(queries, object)[a], "near": names[b]})
            yield out[out["word"] != out["near"]]

    def all_of(key: tuple, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"word": [], "near": []}, dtype=object)
        return pd.concat([none, *of(block, asked)]) if len(block) and len(asked) else none

    return all_of


def neighbours(vocabulary: DataFrame, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """(word, near): all pairs of words, in both orders, that differ by exactly one code point put in, left out or changed.

    Words of a block are neighbours in order; its borders are words chosen by hash with a chance that grows
    with their length, so a block has about ``block`` code points. What the driver and every task hold of the
    vocabulary is the borders.
    """
    spark = vocabulary.sparkSession
    found = None
    for scheme, spelled in enumerate((F.col("word"), F.reverse("word"))):
        keyed = vocabulary.select("word", spelled.alias("spelled"))
        border = F.pmod(F.xxhash64("word"), F.lit(block)) < F.length("word")
        borders = spark.sparkContext.broadcast(sorted(r["spelled"] for r in keyed.where(border).select("spelled").collect()))

        @F.pandas_udf("int")
        def place(spelled: pd.Series) -> pd.Series:
            return spelled.map(lambda w: bisect.bisect_right(borders.value, w)).astype("int32")

        @F.pandas_udf("array<int>")
        def places(spelled: pd.Series, half: pd.Series) -> pd.Series:
            def of(word: str, n: int) -> list[int]:
                first, last = bisect.bisect_right(borders.value, word[:n]), bisect.bisect_right(borders.value, word[:n] + "\U0010ffff")
                return list(range(first, last + 1))

            return pd.Series([of(w, n) for w, n in zip(spelled, half)], dtype=object)

        size = F.length("word")
        half = F.floor(size / 2) if scheme == 0 else size - F.floor(size / 2)
        blocks = keyed.select("word", place("spelled").alias("block"))
        asked = keyed.select("word", F.explode(places("spelled", half.cast("int"))).alias("block"))
        pairs = blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(_search(scheme, together), "word string, near string")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def group(vocabulary: DataFrame, ratio: int = RATIO, block: int = BLOCK, together: int = TOGETHER) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every (word, n) of the vocabulary.

    ``form`` is the most frequent word one edit away (of several the first in code-point order), if it is at
    least ``ratio`` times as frequent, else null; ``root`` is where forms lead in the end, the word itself if it has none.
    """
    if ratio <= 1:
        raise ValueError("forms could lead in a circle")
    vocabulary = keep(vocabulary.select("word", "n"), "words")
    pairs = neighbours(vocabulary, block, together)
    numbers = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # The largest n first, then the smallest word; the order of UTF-8 is that of code points.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    seen = pairs.join(numbers, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = vocabulary.join(seen, "word", "left")
    stands = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(stands, F.col("best.near")).alias("form"),
        F.when(stands, -F.col("best.less")).alias("form_n"),
    )
    rows = keep(rows, "forms")
    pointers = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # Every step multiplies n by the ratio, so chains are short; each round doubles what they reach.
    while True:
        ahead = pointers.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = keep(pointers.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        pointers = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return rows.join(pointers, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    """The variants among the words of all whole texts; see ``words`` and ``group``.

    Null and empty texts have no words, without words there are no rows, repeated rows count as often as
    they stand there. Other columns than doc_id and text are not read.
    """
    return group(words(docs), **options)
