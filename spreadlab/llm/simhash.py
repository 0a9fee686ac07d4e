"""Near duplicates by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import keep, small_batches, text_of
from spreadlab.operators.components import connected

BITS = 64
SEED = 42
# Shingles whose bits are counted at a time, so that a huge text needs little memory.
SLICE = 1 << 16


def fingerprint(text: bytes, size: int) -> int:
    """The signed 64-bit SimHash of a UTF-8 text over ``size``-word shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = list(zip(starts, ends[size - 1 :], strict=False)) or [(0, len(flat))]
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(spans), SLICE):
        hashes = [xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in spans[i : i + SLICE]]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(spans)).view(">i8")[0])


def printed(size: int):
    """The column function that gives the ``fingerprint`` of a binary text."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: fingerprint(t, size)).astype("int64")

    return of


def fingerprints(docs: DataFrame, size: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint long) for every row; a null text counts as empty, an empty one has fingerprint 0."""
    small_batches(docs.sparkSession)
    whole = text_of(text)
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("text_hash"), printed(size)(whole.cast("binary")).alias("fingerprint"))


def _masks(blocks: int, shared: int) -> list[int]:
    """Bit masks of all choices of ``shared`` blocks out of ``blocks`` that part the 64 bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, shared)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _ball() -> Column:
    """All 64-bit masks with at most two bits set."""
    bit = lambda i: F.when(i == BITS, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i))
    one = lambda i: F.transform(F.sequence(i, F.lit(BITS)), lambda j: bit(i).bitwiseXOR(bit(j)))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BITS)), one)))


def _crowded_links(prints: DataFrame) -> DataFrame:
    """Links that connect fingerprints within four bits of each other as all pairs would, without the pairs.

    Two fingerprints differ in at most four bits just if some value is within two
    bits of both. All fingerprints around one value are therefore linked to each
    other, and a star per value connects them; around a value there are at most 2081.
    """
    around = prints.select("f", F.explode(_ball()).alias("mask")).select(F.col("f").bitwiseXOR(F.col("mask")).alias("z"), "f")
    stars = around.groupBy("z").agg(F.collect_list("f").alias("fs")).where(F.size("fs") > 1)
    return stars.select(F.array_min("fs").alias("u"), F.explode("fs").alias("v")).where("u <> v").distinct()


def links(prints: DataFrame, radius: int = 4, blocks: int = 6, crowd: int = 2000) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``f`` whose components are those of all pairs within ``radius`` bits.

    With ``blocks`` parts, two fingerprints within the radius agree in at least
    ``blocks - radius`` of them, so the pairs are joined on every choice of that many
    parts and verified. A bucket of more than ``crowd`` fingerprints is not paired:
    its members are linked by ``_crowded_links``, which serves a radius of up to four
    and costs a fixed number of rows for each.
    """
    if not blocks > radius >= 0 or radius > 4:
        raise ValueError("needs blocks > radius and a radius of at most 4")
    masks = _masks(blocks, blocks - radius)
    keyed = F.array(*[F.struct(F.lit(i).cast("byte").alias("c"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    keys = prints.select("f", F.explode(keyed).alias("key")).select("key.c", "key.k", "f")
    crowded = keep(keys.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("c", "k"), "crowded")
    calm = keys.join(crowded, ["c", "k"], "left_anti")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    pairs = (
        calm.withColumnRenamed("f", "u")
        .join(calm.withColumnRenamed("f", "v"), ["c", "k"])
        .where((F.col("u") < F.col("v")) & near)
        .select("u", "v")
    )
    many = keys.join(crowded, ["c", "k"], "left_semi").select("f").distinct()
    far = _crowded_links(many)
    if radius < 4:
        far = far.where(near)
    return pairs.unionByName(far).distinct()


def near_duplicates(
    docs: DataFrame, size: int = 4, radius: int = 4, blocks: int = 6, crowd: int = 2000, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, fingerprint long, component, component_id): one row per row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    component_id is the smallest doc_id that links reach. Equal fingerprints are
    always linked, so repeated rows and all empty or null texts (fingerprint 0) fall
    together. ``component`` is a fingerprint that stands for the component. A null doc_id
    keeps its row; it is component_id only where its component has no other. Other
    columns are not read.
    """
    prints = keep(fingerprints(docs, size, doc_id, text), "prints")
    distinct = keep(prints.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("least")), "distinct")
    found = connected(links(distinct.select("f"), radius, blocks, crowd))
    rooted = distinct.join(found, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("component", "f").alias("root"))
    rooted = keep(rooted, "rooted")
    least = keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    labels = keep(rooted.join(least, "root").select(F.col("f").alias("fingerprint"), F.col("root").alias("component"), "component_id"), "labels")
    return prints.join(labels, "fingerprint").select("doc_id", "text_hash", "fingerprint", "component", "component_id")


def hexadecimal(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: one of its smallest doc_id.

    Of different texts of that doc_id, and of rows without any in components that have
    no other, the one with the smallest hash stays; rows that repeat it stay once.
    """
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    return first_rows(docs, near_duplicates(docs, **options), doc_id, text)


def first_rows(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``first_of_each`` of the components ``found(doc_id, text_hash, component, component_id)``."""
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("component").agg(F.min("text_hash").alias("kept_hash"), F.min("component_id").alias("kept_id"))
    kept = keep(kept.select("kept_id", "kept_hash").distinct(), "kept")
    mark = "_text_hash"
    marked = docs.withColumn(mark, F.xxhash64(text_of(text)))
    same = marked[doc_id].eqNullSafe(kept["kept_id"]) & (marked[mark] == kept["kept_hash"])
    return marked.join(kept, same, "left_semi").dropDuplicates([doc_id, mark]).drop(mark)
