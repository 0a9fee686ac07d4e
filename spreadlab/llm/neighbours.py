"""Approximate nearest neighbours by collision counting over sorted projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import keep

# Vectors of a block and queries of a group: what one task holds at a time.
BLOCK = 16384
GROUP = 1024


class SortedProjections:
    """One block of vectors: each projection is a sorted array of (value, vector)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: np.ndarray):
        self.ids, self.vectors = ids, vectors
        values = vectors @ lines.T
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(values, self.order.T, axis=0).T.copy()

    def search(self, own: np.ndarray, queries: np.ndarray, lines: np.ndarray, k: int, first: float, ratio: float, share: float) -> Iterator[tuple[int, float, int]]:
        """(query, distance, id): the best ``k`` of the vectors that collide with each query often enough.

        ``first`` is the first radius. Windows around the query's own projections grow by
        ``ratio`` (virtual rehashing: a window of twice the width is the bucket of twice
        the radius) until they hold the whole block. A vector that lies in the windows of
        at least ``share`` of the projections is verified by its exact distance. The
        search ends when ``k`` verified vectors are within the current radius.
        """
        m, n = self.values.shape
        at = queries @ lines.T
        reach = max(float(self.values.max() - self.values.min()), float(np.abs(at).max() + np.abs(self.values).max()))
        radii = [first]
        while WIDTH * radii[-1] / 2 < reach:
            wider = radii[-1] * ratio
            # A radius too small to grow is followed by one that holds all.
            radii.append(wider if wider > radii[-1] else max(reach, 2 * reach / WIDTH))
        half = WIDTH * np.array(radii) / 2
        low, high = (
            np.stack([np.searchsorted(v, (x[:, None] + sign * half).ravel(), side).reshape(len(own), -1) for v, x in zip(self.values, at.T, strict=True)], axis=1).tolist()
            for sign, side in ((-1, "left"), (1, "right"))
        )
        start = np.stack([np.searchsorted(v, x) for v, x in zip(self.values, at.T, strict=True)], axis=1).tolist()
        need, orders = int(np.ceil(share * m)), list(self.order)
        for q in range(len(own)):
            counts, seen = np.zeros(n, np.int64), np.zeros(n, bool)
            where, found = np.empty(0, np.int64), np.empty(0)
            inner = [(s, s) for s in start[q]]
            for r, radius in enumerate(radii):
                outer = [(lo[r], hi[r]) for lo, hi in zip(low[q], high[q], strict=True)]
                newly = [
                    part for order, (a, b), (lo, hi) in zip(orders, inner, outer, strict=True) for part in (order[lo:a], order[b:hi]) if len(part)
                ]
                if newly:
                    counts += np.bincount(np.concatenate(newly), minlength=n)
                inner = outer
                fresh = np.flatnonzero((counts >= need) & ~seen)
                seen[fresh] = True
                fresh = fresh[self.ids[fresh] != own[q]]
                gap = self.vectors[fresh] - queries[q]
                where, found = np.append(where, fresh), np.append(found, np.sqrt((gap * gap).sum(axis=1)))
                if (found <= radius).sum() >= k:
                    break
            for b in np.lexsort((self.ids[where], found))[:k]:
                yield int(own[q]), float(found[b]), int(self.ids[where[b]])


# The width of the window of radius one.
WIDTH = 2.0


def usable(vectors: Column) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, not zero."""
    finite = F.forall(vectors, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vectors, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    projections: int = 64,
    share: float = 0.65,
    ratio: float = 1.4,
    first: float = 0.05,
    seed: int = 7,
    block: int = BLOCK,
    group: int = GROUP,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank int, vec_id, score double): the ``k`` nearest found of every row for which ``queries`` holds.

    Nearness is the Euclidean distance; equal distances rank by the smaller vec_id, and
    the row with the query's own id is no candidate. Vectors are dealt by id into blocks
    of about ``block``, queries into groups of about ``group``; each pair of both is one
    small task in which the block's sorted projections are searched. Every vector is
    indexed. ``first`` is the first radius in units of the mean length of a vector.
    Rows that are null, zero or hold null or non-finite components take no part; a null
    vec_id takes none either. Rows that repeat id and vector count once. An id with
    several vectors is as near as the nearest of them, both as query and as candidate.
    Vectors of another length than a query's are no candidates of it. Other columns are
    not read.
    """
    chosen = vectors.select(F.col(vec_id).alias("id"), F.transform(embedding, lambda x: x.cast("double")).alias("v"), queries.alias("asked"))
    rows = keep(chosen.where(usable(F.col("v")) & F.col("id").isNotNull()).dropDuplicates(["id", "v"]), "vectors")
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    blocks, groups = max(1, -(-total // block)), max(1, -(-asked // group))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    held = rows.select("id", "v", dealt(blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    sought = rows.where("asked").select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), dealt(groups).alias("g"))

    def search(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        lengths = right["v"].map(len)
        for size, some in left.groupby(left["v"].map(len)):
            mates = right[lengths == size]
            if len(mates):
                out += _search(some, mates, int(size), k, projections, share, ratio, first, seed)
        return pd.DataFrame(out, columns=["query_id", "score", "vec_id"])

    kept = "query_id long, score double, vec_id long"
    found = sought.groupBy("b", "g").cogroup(held.groupBy("b", "g")).applyInPandas(search, kept)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("all"))
    return ranked.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score"
    )


def _search(some, mates, size, k, projections, share, ratio, first, seed) -> Iterator[tuple[int, float, int]]:
    lines = np.random.default_rng(seed).standard_normal((projections, size))
    base, asked = np.stack(mates["v"].to_numpy()), np.stack(some["v"].to_numpy())
    # A power of two that brings the largest component near one: squares of very small or large components
    # would be zero or infinite, and it changes no digit of the others' distances.
    power = int(np.frexp(max(np.abs(base).max(), np.abs(asked).max()))[1])
    base, asked = np.ldexp(base, -power), np.ldexp(asked, -power)
    index = SortedProjections(mates["id"].to_numpy(np.int64), base, lines)
    start = first * float(np.sqrt((base * base).sum(axis=1)).mean())
    for i in range(0, len(some), 256):
        own = some["id"].iloc[i : i + 256].to_numpy(np.int64)
        for query, distance, vec in index.search(own, asked[i : i + 256], lines, k, start, ratio, share):
            yield query, float(np.ldexp(distance, power)), vec
