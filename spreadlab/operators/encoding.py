"""Features as numbers: mode fills, categories of frequent values, the rest hashed, scaled and sparse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlab.session import settle

# A value held by at least one row in this many gets a feature of its own, so a column has at most as many.
SHARE = 100
# Features that the other values of a column are hashed to.
WIDTH = 32


class ValueCounts:
    """How many rows hold each value of each column, counted in one pass over the texts and one over the numbers.

    Both are stored as (c, v, n), ``c`` being the column's place: modes, frequent values and cut points are read
    from them, so that the rows are not read again for each. Nulls are not counted.
    """

    def __init__(self, rows: DataFrame, columns: Sequence[str]):
        self.columns = list(columns)
        self.texts = [c for c in columns if isinstance(rows.schema[c].dataType, T.StringType)]
        self.numbers = [c for c in columns if c not in self.texts]
        self.of_texts = self._counted(rows, self.texts, "string")
        self.of_numbers = self._counted(rows, self.numbers, "double")

    @staticmethod
    def _counted(rows: DataFrame, columns: Sequence[str], kind: str) -> DataFrame | None:
        if not columns:
            return None
        values = F.array(*[F.col(f"`{c}`").cast(kind) for c in columns])
        long = rows.select(F.posexplode(values).alias("c", "v")).where(F.col("v").isNotNull())
        return settle(long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")), "counts")

    def modes(self) -> dict:
        """Most frequent value of each column that has any (the smallest of equals); one row per column reaches the driver."""
        out: dict = {}
        for columns, counts in ((self.numbers, self.of_numbers), (self.texts, self.of_texts)):
            if columns:
                best = counts.groupBy("c").agg(F.min(F.struct(-F.col("n"), "v")).alias("b")).select("c", "b.v")
                out.update({columns[r["c"]]: r["v"] for r in best.collect()})
        return out

    def frequent(self, total: int, share: int) -> dict[str, list[str]]:
        """Texts that at least one of ``share`` of the ``total`` rows holds, per column, sorted: at most ``share`` a column."""
        if not self.texts:
            return {}
        kept = self.of_texts.where(F.col("n") * share >= total).collect()
        return {c: sorted(r["v"] for r in kept if r["c"] == i) for i, c in enumerate(self.texts)}


def modes(rows: DataFrame, columns: Sequence[str]) -> dict:
    """Most frequent value of each column (the smallest of equals), nulls ignored."""
    return ValueCounts(rows, columns).modes()


def frequent_values(rows: DataFrame, columns: Sequence[str], share: int = SHARE) -> dict[str, list[str]]:
    """Values that at least one row in ``share`` holds, per text column, sorted."""
    return ValueCounts(rows, columns).frequent(rows.count(), share) if columns else {}


class Encoder:
    """Fills, categories and scales learnt from some rows.

    A feature is a numeric column, ``column=value`` for a frequent value of a text column, or
    ``column#k`` for the others, ``k`` being the first eight hex digits of the value's MD5 modulo the width.
    Nulls take the mode; columns without any value are left out. Columns that are missing when rows are
    encoded count as null, further columns are not read.
    """

    def __init__(self, share: int = SHARE, width: int = WIDTH):
        self.share, self.width = share, width
        self.fills: dict = {}
        self.texts: list[str] = []
        self.numbers: list[str] = []
        self.frequent: dict[str, list[str]] = {}
        self.scales: dict[str, float] = {}

    def fit(self, rows: DataFrame, columns: Sequence[str], counts: ValueCounts | None = None) -> Encoder:
        """Learn from the rows; ``counts`` are those of their columns, if they are known."""
        counts = counts or ValueCounts(rows, columns)
        self.fills = counts.modes()
        self.texts = [c for c in counts.texts if c in self.fills]
        self.numbers = [c for c in counts.numbers if c in self.fills]
        frequent = counts.frequent(rows.count(), self.share)
        self.frequent = {c: frequent[c] for c in self.texts}
        return self

    def names(self) -> list[str]:
        """All features, sorted."""
        slots = [f"{c}={v}" for c in self.texts for v in self.frequent[c]]
        slots += [f"{c}#{k}" for c in self.texts for k in range(self.width)]
        return sorted([*self.numbers, *slots])

    def value(self, rows: DataFrame, column: str) -> Column:
        """A column of ``rows`` with nulls, and NaN, replaced by the mode."""
        kind = "string" if column in self.texts else "double"
        if column not in rows.columns:
            return F.lit(self.fills[column]).cast(kind)
        value = F.col(f"`{column}`").cast(kind)
        if kind == "double":
            value = F.nanvl(value, F.lit(None).cast("double"))
        return F.coalesce(value, F.lit(self.fills[column]))

    def bucket(self, value: Column) -> Column:
        """Where a value that is not frequent is hashed to."""
        digits = F.substring(F.md5(value.cast("binary")), 1, 8)
        return (F.conv(digits, 16, 10).cast("long") % self.width).cast("int")

    def slot(self, rows: DataFrame, column: str, places: dict[str, int]) -> Column:
        """The place of the feature that a text column's value is."""
        value = self.value(rows, column)
        hashed = F.get(F.lit([places[f"{column}#{k}"] for k in range(self.width)]), self.bucket(value))
        if not self.frequent[column]:
            return hashed
        known = F.create_map(*[F.lit(x) for v in self.frequent[column] for x in (v, places[f"{column}={v}"])])
        return F.coalesce(F.element_at(known, value), hashed)

    def fit_scales(self, rows: DataFrame) -> Encoder:
        """Learn every feature's standard deviation over the rows; constant features keep their values."""
        names = self.names()
        places = {name: i for i, name in enumerate(names)}
        plain = rows.select(
            *[self.value(rows, c).alias(f"n{i}") for i, c in enumerate(self.numbers)],
            F.array(*[self.slot(rows, c, places) for c in self.texts]).cast("array<int>").alias("slots"),
        )
        spread = plain.agg(F.count(F.lit(1)).alias("rows"), *[F.stddev_pop(f"n{i}").alias(f"n{i}") for i in range(len(self.numbers))]).first()
        found = {c: spread[f"n{i}"] or 0.0 for i, c in enumerate(self.numbers)}
        for r in plain.select(F.explode("slots").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect():
            part = r["n"] / spread["rows"]
            found[names[r["at"]]] = (part * (1 - part)) ** 0.5
        self.scales = {name: found[name] if found.get(name, 0.0) > 1e-9 else 1.0 for name in names}
        return self

    def encoded(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` and ``features``: (feature, value) of all that are not zero, divided by their deviation.

        Values are not centred, so zeros stay zeros and rows stay as short as they are.
        """
        names = self.names()
        places = {name: i for i, name in enumerate(names)}
        scale = F.array(*[F.lit(self.scales[name]) for name in names])
        label = F.array(*[F.lit(name) for name in names])
        entries = [F.struct(F.lit(places[c]).alias("at"), self.value(rows, c).alias("x")) for c in self.numbers]
        entries += [F.struct(self.slot(rows, c, places).alias("at"), F.lit(1.0).alias("x")) for c in self.texts]
        some = F.filter(F.array(*entries), lambda e: e["x"] != 0)
        scaled = F.transform(
            F.array_sort(some), lambda e: F.struct(F.get(label, e["at"]).alias("feature"), (e["x"] / F.get(scale, e["at"])).alias("value"))
        )
        return rows.select(*[F.col(f"`{c}`") for c in keep], scaled.alias("features"))
