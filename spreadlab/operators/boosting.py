"""Boosted trees from histograms of gradients: one aggregate per level of a tree."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.operators.encoding import Encoder, ValueCounts
from spreadlab.operators.prefix import running
from spreadlab.session import settle

# Cut points of a numeric feature.
BINS = 32
# Gradients are summed as whole numbers of this fraction, so sums do not depend on the order of rows.
UNIT = 1 << 16
# Common defaults: the penalty of leaf values, and the least sum of second derivatives on a side.
PENALTY = 1.0
LEAST = 1.0
# Rows whose gradients are summed at a time, and whole numbers that doubles add up exactly.
BLOCK = 1 << 14
EXACT = float(1 << 53)


def cut_points(rows: DataFrame, encoder: Encoder, counts: ValueCounts | None = None) -> dict[str, list[float]]:
    """The smallest value and the 31 quantiles between 32 equal parts, per numeric feature, without repeats.

    Exact, from running totals of (value, count) pairs; ``counts`` are those of the rows, if they are known. Rows without
    a value count for the fill. At most 32 numbers a feature reach the driver.
    """
    if not encoder.numbers:
        return {}
    counts = counts or ValueCounts(rows, encoder.numbers)
    total, spark = rows.count(), rows.sparkSession
    place = [counts.numbers.index(c) for c in encoder.numbers]
    fills = spark.createDataFrame([(i, float(encoder.fills[c])) for i, c in zip(place, encoder.numbers)], "c int, v double")
    known = counts.of_numbers.where(~F.isnan("v"))
    there = known.groupBy("c").agg(F.sum("n").alias("n"))
    missing = fills.join(there, "c", "left").select("c", "v", (F.lit(total) - F.coalesce("n", F.lit(0))).alias("n"))
    filled = known.unionByName(missing).groupBy("c", "v").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    upto = running(filled, ["c"], ["v"], sums={"upto": "n"})
    ranks = sorted({1, *(-(-total * k // BINS) for k in range(1, BINS))} - {0})
    holds = F.exists(F.lit(ranks).cast("array<bigint>"), lambda r: (r > F.col("upto") - F.col("n")) & (r <= F.col("upto")))
    out: dict[int, list[float]] = {i: [] for i in place}
    for r in upto.where(holds).select("c", "v").collect():
        if r["c"] in out:
            out[r["c"]].append(r["v"])
    return {c: sorted(out[i]) for i, c in zip(place, encoder.numbers)}


def _number(x: float) -> str:
    """A number as SQL text; constants are parsed at once, as there are many."""
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')" if isinstance(x, float) else str(x)


def best_splits(rows: DataFrame, totals: dict[int, tuple[int, int]]) -> DataFrame:
    """(node, f, b, gain, gl, hl): the split with the largest gain of each node, of equals the first feature and bin.

    ``rows(node, f, b, g, h)`` are sums of parts of the rows. ``gl`` and ``hl`` are the sums of the left side, ``totals``
    those of each node. Bin 0 may be left out where other bins are listed; it holds what is left of the totals.
    """
    nodes = ", ".join(f"{n}, struct({g}L AS g, {h}L AS h)" for n, (g, h) in totals.items())
    return rows.sparkSession.sql(
        f"""
        WITH sums AS (SELECT node, f, b, sum(g) AS g, sum(h) AS h FROM {{rows}} GROUP BY node, f, b),
        seen AS (
          SELECT node, f, b, g, h, element_at(map({nodes}), node) AS a, lag(b) OVER upto AS before,
            sum(g) OVER upto AS gl, sum(h) OVER upto AS hl, sum(g) OVER part AS gs, sum(h) OVER part AS hs
          FROM sums WINDOW upto AS (PARTITION BY node, f ORDER BY b), part AS (PARTITION BY node, f)),
        cuts AS (
          SELECT node, f, a, c.* FROM seen LATERAL VIEW inline(concat(
            array(struct(b AS b, gl + if(b > 0, a.g - gs, 0L) AS gl, hl + if(b > 0, a.h - hs, 0L) AS hl)),
            if(b > 0 AND before IS NULL, array(struct(0 AS b, a.g - gs AS gl, a.h - hs AS hl)), array())
          )) c AS b, gl, hl),
        sides AS (
          SELECT node, f, b, gl, hl, gl / {UNIT}D AS g1, hl / {UNIT}D AS h1, (a.g - gl) / {UNIT}D AS g2, (a.h - hl) / {UNIT}D AS h2,
            a.g / {UNIT}D AS g0, a.h / {UNIT}D AS h0 FROM cuts),
        gains AS (
          SELECT *, g1 * g1 / (h1 + {PENALTY}D) + g2 * g2 / (h2 + {PENALTY}D) - g0 * g0 / (h0 + {PENALTY}D) AS gain
          FROM sides WHERE h1 >= {LEAST}D AND h2 >= {LEAST}D)
        SELECT node, s.f, s.b, -s.loss AS gain, s.gl, s.hl FROM
          (SELECT node, min(struct(-gain AS loss, f, b, gl, hl)) AS s FROM gains WHERE gain > 0 GROUP BY node)
        """,
        rows=rows,
    )


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the rows has it."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


class Tree:
    """Splits (feature, bin, gain) and leaf values by node; the children of node n are 2n + 1 and 2n + 2."""

    def __init__(self, splits: dict[int, tuple[int, int, float]] | None = None, leaves: dict[int, float] | None = None):
        self.splits, self.leaves = splits or {}, leaves or {}

    def text(self, goes_left: Callable[[int, int], str], at: Callable[[int], str], node: int = 0) -> str:
        """``at`` of the node that a row ends in, as SQL text: a tree is parsed at once."""
        if node not in self.splits:
            return at(node)
        feature, cut, _ = self.splits[node]
        left, right = (self.text(goes_left, at, 2 * node + side) for side in (1, 2))
        return f"CASE WHEN {goes_left(feature, cut)} THEN {left} ELSE {right} END"

    def values(self, goes_left: Callable[[int, int], str]) -> Column:
        return F.expr(self.text(goes_left, lambda n: _number(self.leaves[n])))


class Columns:
    """Where the columns of the rows are among the bytes, and which features they are."""

    def __init__(self, encoder: Encoder, cuts: dict[str, list[float]]):
        names = encoder.names()
        self.places = {name: i for i, name in enumerate(names)}
        self.numbers = [c for c in encoder.numbers if len(cuts[c]) > 1]
        self.texts = list(encoder.texts)
        self.cuts = [np.array(cuts[c]) for c in self.numbers]
        # The features of a text column's slots; a number has one feature and its bins.
        self.slots = [
            np.array([self.places[f"{c}={v}"] for v in encoder.frequent[c]] + [self.places[f"{c}#{k}"] for k in range(encoder.width)])
            for c in self.texts
        ]
        self.sizes = [len(some) + 1 for some in self.cuts] + [len(some) for some in self.slots]
        self.kind = np.dtype(np.uint8 if max(self.sizes, default=0) <= 256 else np.uint32).str
        # Per feature its column, and its slot there or -1.
        self.at = {self.places[c]: (j, -1) for j, c in enumerate(self.numbers)}
        for j, some in enumerate(self.slots, len(self.numbers)):
            self.at.update({int(f): (j, k) for k, f in enumerate(some)})

    def coded(self, rows: DataFrame, encoder: Encoder, label: Column, weight: Column) -> DataFrame:
        """(y, w, codes) of every row."""
        plain = rows.select(
            label.cast("double").alias("y"),
            weight.cast("double").alias("w"),
            *[encoder.value(rows, c).alias(f"n{i}") for i, c in enumerate(self.numbers)],
            *[encoder.slot(rows, c, self.places).alias(f"t{i}") for i, c in enumerate(self.texts)],
        )
        cuts, kind, width = self.cuts, self.kind, len(self.sizes)
        slot_of = np.zeros(len(self.places), np.int64)
        for some in self.slots:
            slot_of[some] = np.arange(len(some))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.empty((batch.num_rows, width), kind)
                for j in range(width):
                    values = batch.column(2 + j).to_numpy(zero_copy_only=False)
                    codes[:, j] = np.searchsorted(cuts[j], values) if j < len(cuts) else slot_of[values]
                ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (width * codes.itemsize)
                packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["y", "w", "codes"])

        return plain.mapInArrow(of, "y double, w double, codes binary")

    def _table(self, tree: Tree) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The tree's nodes, by place; per place its column, slot, bin and children's places, itself for a node without split; its values."""
        nodes = sorted({0, *(child for n in tree.splits for child in (2 * n + 1, 2 * n + 2))})
        place = {n: i for i, n in enumerate(nodes)}
        steps = np.zeros((5, len(nodes)), np.int64)
        for n, i in place.items():
            steps[:, i] = 0, -1, 0, i, i
            if n in tree.splits:
                f, b, _ = tree.splits[n]
                steps[:, i] = *self.at[f], b, place[2 * n + 1], place[2 * n + 2]
        return nodes, steps, np.array([tree.leaves.get(n, 0.0) for n in nodes])

    def sums(self, state: DataFrame, before: list[Tree], tree: Tree, active: list[int], histograms: bool = True) -> DataFrame:
        """(node, f, b, g, h): sums of the gradients after the trees ``before``, by the active nodes of a tree and the features' bins.

        A task has a row per sum that is not zero. A text's slots have bin 1 only. Without ``histograms`` they are by node.
        """
        done = [(steps, values) for _, steps, values in map(self._table, before)]
        nodes, steps, _ = self._table(tree)
        place = {n: i for i, n in enumerate(nodes)}
        rank = np.full(len(nodes), -1)
        rank[[place[n] for n in active]] = np.arange(len(active))
        ids = np.array(active, np.int32)
        kind, sizes = self.kind, self.sizes if histograms else []
        width = len(self.sizes)
        marks = [(np.full(size, self.places[c]), np.arange(size)) for c, size in zip(self.numbers, self.sizes)]
        marks += [(some, np.ones(len(some), np.int64)) for some in self.slots]
        deepest = 1 + max((n + 1).bit_length() for n in [0, *(n for t in [*before, tree] for n in t.splits)])
        unit, block_rows, exact = float(UNIT), BLOCK, EXACT

        def blocks(batches):
            held, n = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                column = batch.column(2)
                wide = pa.types.is_large_binary(column.type)
                starts = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
                size = batch.num_rows * width
                codes = np.frombuffer(column.buffers()[2], kind, size, int(starts[column.offset])) if size else np.empty(0, kind)
                y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                held.append((codes.reshape(batch.num_rows, width), y, w))
                n += batch.num_rows
                if n >= block_rows:
                    yield [np.concatenate(part) for part in zip(*held)]
                    held, n = [], 0
            if held:
                yield [np.concatenate(part) for part in zip(*held)]

        def ends(codes, steps):
            """The place of the node that each row ends in."""
            at, first = np.zeros(len(codes), np.int64), np.arange(len(codes)) * width
            flat = codes.reshape(-1)
            if not width:
                return at
            column, slot, cut, left, right = steps
            for _ in range(deepest):
                if (left[at] == at).all():
                    break
                value, here = flat[first + column[at]].astype(np.int64), slot[at]
                value = np.where(here >= 0, value == here, value)
                at = np.where(value <= cut[at], left[at], right[at])
            return at

        def added(index, whole, size):
            if not len(whole) or np.abs(whole).max() * len(whole) < exact:
                return np.bincount(index, whole, size).astype(np.int64)
            out = np.zeros(size, np.int64)
            np.add.at(out, index, whole.astype(np.int64))
            return out

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((2, len(ids)), np.int64)
            found = [np.zeros((2, len(ids) * size), np.int64) for size in sizes]
            for codes, y, w in blocks(batches):
                margin = np.zeros(len(y))
                for known, values in done:
                    margin = margin + values[ends(codes, known)]
                with np.errstate(over="ignore"):
                    chance = 1 / (1 + np.exp(-margin))
                both = np.floor(w * (chance - y) * unit + 0.5), np.floor(w * chance * (1 - chance) * unit + 0.5)
                node = rank[ends(codes, steps)]
                if (node < 0).any():
                    kept = node >= 0
                    codes, node, both = codes[kept], node[kept], [part[kept] for part in both]
                for side, part in enumerate(both):
                    totals[side] += added(node, part, len(ids))
                columns = np.ascontiguousarray(codes.T)
                for j, size in enumerate(sizes):
                    index = node * size + columns[j]
                    for side, part in enumerate(both):
                        found[j][side] += added(index, part, len(ids) * size)
            if not sizes:
                found, known = [totals], [(np.array([-1]), np.array([0]))]
            else:
                known = marks
            out = []
            for some, (feature, bin_) in zip(found, known):
                there = np.flatnonzero(some.any(axis=0))
                size = len(feature)
                out.append([ids[there // size], feature[there % size], bin_[there % size], *some[:, there]])
            if out:
                types = pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()
                arrays = [pa.array(np.concatenate(part), to) for part, to in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "f", "b", "g", "h"])

        return state.mapInArrow(of, "node int, f int, b int, g bigint, h bigint")


class BoostedTrees:
    """Trees for a 0/1 label with the log loss.

    Rows are stored once as a byte per column: the bin of a number, the slot of a text. A level of a tree is one scan that
    sums gradients by (node, feature, bin) in arrays, a part of the rows at a time, and one aggregate of these sums, at most
    nodes x features x bins a task; a split a node reaches the driver. Gradients follow from the trees so far
    and are not stored. Rows are never sorted or exchanged. Sums hold for about 10^14 rows of weight 1.
    """

    def __init__(self, rounds: int, depth: int, step: float):
        self.rounds, self.depth, self.step = rounds, depth, step
        self.cuts: dict[str, list[float]] = {}
        self.trees: list[Tree] = []

    def fit(self, rows: DataFrame, encoder: Encoder, label: Column, weight: Column, counts: ValueCounts | None = None) -> BoostedTrees:
        """Learn from the rows; ``counts`` are those of their columns, if they are known."""
        self.cuts = cut_points(rows, encoder, counts)
        columns = Columns(encoder, self.cuts)
        state = settle(columns.coded(rows, encoder, label, weight), "binned")
        self.trees = []
        for _ in range(self.rounds):
            self.trees.append(self._grow(state, columns))
        return self

    def _grow(self, state: DataFrame, columns: Columns) -> Tree:
        root = columns.sums(state, self.trees, Tree(), [0], histograms=False).agg(F.sum("g"), F.sum("h")).first()
        tree, totals, active = Tree(), {0: (root[0], root[1])}, [0]
        for _ in range(self.depth):
            rows = columns.sums(state, self.trees, tree, active)
            found = best_splits(rows, {n: totals[n] for n in active}).collect()
            for r in found:
                n, (g, h) = r["node"], totals.pop(r["node"])
                tree.splits[n] = r["f"], r["b"], r["gain"]
                totals[2 * n + 1], totals[2 * n + 2] = (r["gl"], r["hl"]), (g - r["gl"], h - r["hl"])
            active = [2 * r["node"] + side for r in found for side in (1, 2)]
            if not active:
                break
        tree.leaves = {n: -(g / UNIT) / (h / UNIT + PENALTY) * self.step for n, (g, h) in totals.items()}
        return tree

    def scored(self, rows: DataFrame, encoder: Encoder, margin: str = "margin") -> DataFrame:
        """The rows with the trees' sum; only the columns of their splits are read."""
        names = encoder.names()
        places = {name: i for i, name in enumerate(names)}
        owner = {c: c for c in encoder.numbers}
        owner.update({f"{c}={v}": c for c in encoder.texts for v in encoder.frequent[c]})
        owner.update({f"{c}#{k}": c for c in encoder.texts for k in range(encoder.width)})
        used = sorted({owner[names[f]] for tree in self.trees for f, _, _ in tree.splits.values()})
        at = {c: f"u{i}" for i, c in enumerate(used)}
        values = [(encoder.value(rows, c) if c in encoder.numbers else encoder.slot(rows, c, places)).alias(at[c]) for c in used]

        used_name = free_name(rows, "_used")

        def goes_left(f, b):
            column = owner[names[f]]
            if column not in encoder.numbers:
                return f"{used_name}.{at[column]} <> {f}"
            cuts = self.cuts[column]
            return f"{used_name}.{at[column]} <= {_number(cuts[b])}" if b < len(cuts) else "true"

        kept = [F.col(f"`{c}`") for c in rows.columns if c != margin]
        plain = rows.select(*kept, F.struct(F.lit(0.0).alias("none"), *values).alias(used_name))
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + tree.values(goes_left)
        return plain.select(*kept, total.alias(margin))

    def importances(self, encoder: Encoder) -> dict[str, float]:
        """Mean gain of a feature's splits, as a share of the sum over features."""
        gains: dict[int, list[float]] = {}
        for tree in self.trees:
            for feature, _, gain in tree.splits.values():
                gains.setdefault(feature, []).append(gain)
        means = {f: sum(some) / len(some) for f, some in gains.items()}
        whole, names = sum(means.values()), encoder.names()
        return {names[f]: mean / whole for f, mean in means.items()}
