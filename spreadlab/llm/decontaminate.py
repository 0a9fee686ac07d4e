"""Benchmark items in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import keep, text_of

SHINGLE = 5
BITS, BLOCKS = 64, 8
WIDTH = BITS // BLOCKS
# Bits that may differ within a block: fingerprints within 23 bits of each other differ
# by at most two in one of the eight blocks.
FLIPS = 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
# Rows of a table made from the benchmark up to which it is broadcast; beyond it is joined by a shuffle.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few rows."""
    kept = keep(df, "items")
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def words_of(text: Column) -> Column:
    """The runs of letters and digits of a text, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """The hash of each ``size`` words in a row, repeats included; empty for fewer words."""
    hashed = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))
    return F.when(F.size(words) >= size, hashed).otherwise(F.array().cast("array<long>"))


def simhash(hashes: Column) -> Column:
    """64 bits: each is set where it is in over half of the hashes, which count as often as they occur."""

    def add(acc: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b))
        return F.when(ones * 2 > F.size(hashes), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), add)


def _block(fingerprint: Column, j: Column) -> Column:
    shifted = F.call_function("shiftrightunsigned", fingerprint, j * WIDTH)
    return shifted.bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _flipped() -> list[int]:
    """All masks of a block with at most FLIPS bits set."""
    return [m for m in range(1 << WIDTH) if m.bit_count() <= FLIPS]


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, size in words, k, hashes): items of under SHINGLE words are one shingle; items without words match nothing."""
    worded = benchmark.select("item_id", words_of(text_of("text")).alias("words")).select("item_id", "words", F.size("words").alias("size"))
    sized = worded.where("size > 0").withColumn("k", F.least(F.col("size"), F.lit(SHINGLE)))
    hashes = F.lit(None)
    for k in range(1, SHINGLE + 1):
        hashes = F.when(F.col("k") == k, shingles(F.col("words"), k)).otherwise(hashes)
    return sized.select("item_id", "size", "k", hashes.alias("hashes"))


def _starts(hits: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, text_hash, size, k, n, starts): the windows of ``size`` words that can be similar enough to an item of that size.

    A window and an item of its size have equally many shingles n; similarity t takes
    2tn / (1 + t) common ones. Windows with fewer known shingles are left out.
    """
    n = F.col("size") - F.col("k") + 1
    need = F.greatest(F.ceil(n * (2 * threshold / (1 + threshold)) - 1e-9).cast("int"), F.lit(1))
    at = F.array_sort(F.collect_set("pos")).alias("at")
    grouped = hits.groupBy("doc_id", "text_hash", "size", "k").agg(at).withColumns({"n": n, "need": need}).where(F.size("at") >= F.col("need"))

    def ranges(i: Column) -> Column:
        first, last = F.get("at", i), F.get("at", i + F.col("need") - 1)
        low = F.greatest(last - F.col("n") + 1, F.lit(0))
        return F.when(low <= first, F.sequence(low, F.greatest(first, low))).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), ranges)))
    return grouped.select("doc_id", "text_hash", "size", "k", "n", starts.alias("starts")).where(F.size("starts") > 0)


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, start, size) of all similar windows; see ``find``."""
    items = keep(benchmark_items(benchmark), "benchmark")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), words_of(text_of(text)).alias("words"))
    known = _small(items.select("size", "k", F.explode("hashes").alias("h")).distinct())
    lengths = [r["k"] for r in items.select("k").distinct().collect()]  # at most SHINGLE rows
    if not lengths:
        none = [F.lit(0).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("size")]
        return rows.select("doc_id", "text_hash", *none).limit(0)
    found = None
    for k in lengths:
        each = rows.select("doc_id", "text_hash", F.posexplode(shingles(F.col("words"), k)).alias("pos", "h"))
        hits = each.join(known.where(F.col("k") == k), "h").select("doc_id", "text_hash", "size", "k", "pos")
        windows = keep(_starts(hits, threshold), "starts")
        same = rows["doc_id"].eqNullSafe(windows["doc_id"]) & (rows["text_hash"] == windows["text_hash"])
        cut = rows.join(windows, same).select(rows["doc_id"], rows["text_hash"], "size", "n", "starts", shingles(F.col("words"), k).alias("h"))
        inside = F.filter("starts", lambda s: s + F.col("n") <= F.size("h"))
        part = F.transform(inside, lambda s: F.struct(s.alias("start"), F.slice("h", s + 1, F.col("n")).alias("hashes")))
        parts = cut.select("doc_id", "text_hash", "size", "n", F.explode(part).alias("w")).select("doc_id", "text_hash", "size", "n", "w.*")
        found = parts if found is None else found.unionByName(parts)
    printed = keep(found.withColumn("print", simhash(F.col("hashes"))), "windows")
    return matches(printed, items).where(F.col("similarity") >= threshold)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the benchmark items that documents hold, once per pair, where they are most similar.

    Windows with as many words as an item are fingerprinted and compared with the items
    of their size: every item within RADIUS bits is a candidate, whose weighted
    similarity is computed exactly, the sum of the smaller counts of each five-word
    shingle over the sum of the larger. Windows without enough shingles of any item have
    no such similarity and are not fingerprinted. Words are runs of letters and digits in
    lower case. Documents shorter than an item, null and empty texts hold none of it.
    Rows are searched each by itself; of those of a doc_id the best window counts. Rows
    of an item_id are one item; a null id is one too. Other columns are not read.
    """
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "size")).alias("best")
    similar = _found(docs, benchmark, threshold, doc_id, text)
    return similar.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.similarity", (-F.col("best.start")).cast("int").alias("start_word"), F.col("best.size").alias("n_words")
    )


def matches(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, size, item_id, similarity) of all windows and items of one size within RADIUS bits, each pair once.

    The blocks of an item are entered with all changes of up to FLIPS bits, those of a
    window as they are. A pair is taken at the first block in which they meet.
    """
    blocks = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    flips = F.array(*[F.lit(m) for m in _flipped()])
    printed = items.select("item_id", "size", F.col("hashes").alias("item_hashes"), simhash(F.col("hashes")).alias("item_print"))
    entered = printed.select("*", F.explode(blocks).alias("j")).select("*", F.explode(flips).alias("flip"))
    keys = _small(entered.select("item_id", "size", "item_print", "j", _block(F.col("item_print"), F.col("j")).bitwiseXOR(F.col("flip")).alias("value")))
    probes = windows.select("*", F.explode(blocks).alias("j")).withColumn("value", _block(F.col("print"), F.col("j")))
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    first = F.forall(F.slice(blocks, F.lit(1), F.col("j")), lambda i: F.bit_count(_block(differ, i)) > FLIPS)
    near = probes.join(keys, ["size", "j", "value"]).where((F.bit_count(differ) <= RADIUS) & first)
    texts = _small(printed.select(F.col("item_id").alias("own_id"), F.col("size").alias("own_size"), F.col("item_print").alias("own_print"), "item_hashes"))
    same = F.col("item_id").eqNullSafe(F.col("own_id")) & (F.col("size") == F.col("own_size")) & (F.col("item_print") == F.col("own_print"))
    pairs = near.select("doc_id", "text_hash", "start", "size", "hashes", "item_id", "item_print").join(texts, same)
    return pairs.select("doc_id", "text_hash", "start", "size", "item_id", similarity(F.col("hashes"), F.col("item_hashes")).alias("similarity"))


def similarity(a: Column, b: Column) -> Column:
    """The sum of the smaller over the sum of the larger counts of each shingle."""
    both = F.array_intersect(a, b)
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    repeats = (F.size(F.array_distinct(a)) < F.size(a)) | (F.size(F.array_distinct(b)) < F.size(b))
    common = F.when(repeats, F.aggregate(both, F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))).otherwise(F.size(both))
    return common / (F.size(a) + F.size(b) - common)


def without_items(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, unchanged, whose own text holds no benchmark item."""
    held = _found(docs, benchmark, threshold).select(F.col("doc_id").alias("held_id"), F.col("text_hash").alias("held_hash")).distinct()
    held = keep(held, "held")
    same = docs["doc_id"].eqNullSafe(held["held_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == held["held_hash"])
    return docs.join(held, same, "left_anti")
