"""Running totals and exact quantiles that hold up when one group is huge.

A plain window puts every row of a group into one task. These operators count
the groups first; when the largest is over a fixed size, rows are range
partitioned by (group, order), each slice is scanned by itself, and the totals
of the earlier slices are added. A slice continues at most one group of the
slice before it, so the carried totals have at most one row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.session import settle, shuffle_partitions

GROUP_ROWS = 2_000_000
_SLICE = "_slice"


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    group_rows: int = GROUP_ROWS,
    settled: bool = False,
    at_most: int | None = None,
) -> DataFrame:
    """Add running columns within ``keys``, in the order of ``order`` (unique per group).

    ``sums`` and ``maxes`` map a new column to the column accumulated up to and
    including the row; ``previous`` maps a new column to the value of the row before.
    ``at_most`` is a known upper bound on the rows: under the group limit it makes
    counting the groups unnecessary.
    """
    sums, maxes, previous = dict(sums or {}), dict(maxes or {}), dict(previous or {})
    keys, order = list(keys), list(order)
    largest = at_most
    if at_most is None or at_most > group_rows:
        if not settled:
            df = settle(df, "prefix")
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) <= group_rows:
        ordered = Window.partitionBy(*keys).orderBy(*order)
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            "*",
            *[F.sum(c).over(upto).alias(n) for n, c in sums.items()],
            *[F.max(c).over(upto).alias(n) for n, c in maxes.items()],
            *[F.lag(c).over(ordered).alias(n) for n, c in previous.items()],
        )

    slices = max(shuffle_partitions(df.sparkSession), -(-2 * total // max(group_rows, 1)))
    slices = min(slices, max(total, 1))
    ranged = df.repartitionByRange(int(slices), *keys, *order).withColumn(_SLICE, F.spark_partition_id())
    ranged = settle(ranged, "slices")
    ordered = Window.partitionBy(_SLICE, *keys).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select(
        "*",
        *[F.sum(c).over(upto).alias(n) for n, c in sums.items()],
        *[F.max(c).over(upto).alias(n) for n, c in maxes.items()],
        *[F.lag(c).over(ordered).alias(n) for n, c in previous.items()],
        F.row_number().over(ordered).alias("_at"),
    )
    place = F.struct(*order)
    parts = ranged.groupBy(_SLICE, *keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.max(c).alias(n) for n, c in maxes.items()],
        *[F.max_by(c, place).alias(n) for n, c in previous.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy(_SLICE)
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        _SLICE,
        *keys,
        F.lag("_rows").over(earlier).alias("_rows"),
        *[F.sum(n).over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(n).over(before).alias(f"_c_{n}") for n in maxes],
        *[F.lag(n).over(earlier).alias(f"_c_{n}") for n in previous],
    ).where(F.col("_rows").isNotNull()).drop("_rows")
    # At most one continued group per slice: this side has as many rows as there are slices.
    joined = local.join(carry, [_SLICE, *keys], "left")

    def merged(name: str) -> Column:
        here, carried = F.col(name), F.col(f"_c_{name}")
        if name in sums:
            return F.when(carried.isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + carried)
        if name in maxes:
            return F.greatest(here, carried)
        return F.when(F.col("_at") == 1, carried).otherwise(here)

    return joined.select(*df.columns, *[merged(n).alias(n) for n in [*sums, *maxes, *previous]])


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` within ``keys``.

    Works on (value, count) pairs and their running counts, never on a buffer of
    a whole group. Nulls are ignored.
    """
    keys = list(keys)
    counts = settle(
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "counts"
    )
    upto = running(counts, keys, [value], sums={"_upto": "_n"}, group_rows=group_rows, settled=True)
    if keys:
        upto = upto.join(counts.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys)
    else:
        total = counts.agg(F.sum("_n")).first()[0] or 0
        upto = upto.withColumn("_total", F.lit(total))

    def pick(position: Column) -> Column:
        holds = (F.col("_upto") - F.col("_n") <= position) & (position < F.col("_upto"))
        return F.max(F.when(holds, F.col(value)))

    aggs, out = [], []
    for i, (name, fraction) in enumerate(fractions.items()):
        spot = (F.col("_total") - 1) * F.lit(float(fraction))
        aggs += [
            pick(F.floor(spot)).alias(f"_lo{i}"),
            pick(F.ceil(spot)).alias(f"_hi{i}"),
            F.max(spot - F.floor(spot)).alias(f"_part{i}"),
        ]
        low, high, part = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_part{i}")
        out.append((low + (high - low) * part).alias(name))
    picked = upto.groupBy(*keys).agg(F.max("_total").alias("n"), *aggs)
    return picked.select(*keys, *out, "n")
