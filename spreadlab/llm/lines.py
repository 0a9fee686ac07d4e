"""Repeated and nearly repeated lines by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import Steps, keep, small_batches, text_of
from spreadlab.operators.components import connected

# Edits up to which two lines are linked, and the characters a line needs for that;
# shorter lines repeat only as they are, since an edit makes another word of them.
EDITS = 2
MIN_CHARS = 20
# White space that is not part of a line.
BLANKS = " \t\r\v\f"
# Index entries of one segment beyond which its lines are told apart before they are compared.
CROWD = 16
# Parts of a hub by which lines are told apart, from its start and from its end.
SPOTS = 8
# How many further segments crowded entries are told apart by.
ROUNDS = 2
# Line ids up to which a set of them is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, line_no, line): the lines that are not blank, without white space around them."""
    own = [F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash")]
    each = docs.select(*own, F.posexplode(F.split(text_of(text), "\n")).alias("line_no", "raw"))
    return each.select("doc_id", "text_hash", "line_no", F.btrim("raw", F.lit(BLANKS)).alias("line")).where("line <> ''")


def line_id(line: Column) -> list[Column]:
    """Two hashes that together stand for a line."""
    return [F.xxhash64(line).alias("id"), F.xxhash64(F.lit(1), line).alias("id2")]


def _index(edits: int) -> list[tuple[int, int, int]]:
    """The segments of a line, what it is found by, as (how much shorter, segment, displacement)."""
    return [(0, i, 0) for i in range(edits + 1)]


def _probes(edits: int) -> list[tuple[int, int, int]]:
    """The substrings of a line that a line at most ``edits`` shorter may have as a segment.

    For a line shorter by d, segment i may be displaced by at most i edits to the left
    part and by at most edits - i to the right part; both limits hold at once.
    """
    out = []
    for d in range(edits + 1):
        for i in range(edits + 1):
            out += [(d, i, s) for s in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]
    return out


def _entries(lines: DataFrame, shapes: list[tuple[int, int, int]], edits: int, keys: DataFrame | None = None) -> DataFrame:
    """(key, id[, target, rest]) of the substrings ``shapes`` of ``lines(prefix, id, text, n)``; n is the length.

    A line of a length is cut evenly, the longer segments last. ``rest`` is the text
    without the substring, and ``target`` the length of the lines it is a segment of; they are
    given with the entries of ``keys(key)``, which are all then.
    """
    text, parts = F.col("text"), edits + 1
    listed = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in shapes])
    each = lines.select("prefix", "id", "text", "n", F.explode(listed).alias("e"))
    target, i = F.col("n") - F.col("e.d"), F.col("e.i")
    longer = target % parts
    short = ((target - longer) / parts).cast("int")
    start = short * i + F.greatest(longer + i - parts, F.lit(0)) + 1 + F.col("e.s")
    size = short + F.when(longer + i >= parts, 1).otherwise(0)
    placed = each.select("prefix", "id", "text", "n", target.alias("target"), i.alias("i"), start.alias("start"), size.alias("size"))
    placed = placed.where("start >= 1 AND start + size - 1 <= n").where(F.col("target") >= parts)
    key = F.xxhash64("prefix", "target", "i", F.substring(text, F.col("start"), F.col("size"))).alias("key")
    if keys is None:
        return placed.select(key, "id")
    held = placed.select(key, "id", "text", "n", "target", "start", "size").join(keys.select("key"), "key", "left_semi")
    left = F.substring(text, F.lit(1), F.col("start") - 1)
    rest = F.concat(left, F.substring(text, F.col("start") + F.col("size"), F.col("n")))
    return held.select("key", "id", "target", rest.alias("rest")).distinct()


def _of_lengths(lines: DataFrame, held: DataFrame, edits: int) -> DataFrame:
    """The lines that are as long as a segment's lines in ``held`` or at most ``edits`` longer; no other can hold it."""
    lengths = held.select(F.explode(F.array(*[F.col("target") + d for d in range(edits + 1)])).alias("n")).distinct()
    return lines.join(F.broadcast(lengths), "n", "left_semi")


def _few(df: DataFrame) -> DataFrame:
    """A stored table, broadcast unless it is large, so that what it is joined to is not exchanged for it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _common(a: str, i: int, b: str, j: int) -> int:
    """How many characters ``a`` from i and ``b`` from j have in common at their start."""
    most, done, step = min(len(a) - i, len(b) - j), 0, 8
    while done < most:
        step = min(step, most - done)
        if a[i + done : i + done + step] == b[j + done : j + done + step]:
            done, step = done + step, step * 2
        else:
            most, step = done + step - 1, max(1, step // 2)
    return done


def reach(text: str, hub: str, edits: int) -> tuple[int, int]:
    """How many characters of ``hub`` from its start some start of ``text`` equals, and comes within ``edits`` of.

    If texts are within ``edits`` of each other, the first number of either is at most
    the second of the other: what one has in common with the hub, the other has but for
    the edits.
    """
    far = {0: _common(hub, 0, text, 0)}
    first = far[0]
    for _ in range(edits):
        # By diagonal, the places in the text less those in the hub: an edit in the hub's place, less or more of the text.
        before = {d: max(far.get(d, -1) + 1, far.get(d + 1, -1) + 1, far.get(d - 1, 0)) for d in range(min(far) - 1, max(far) + 2)}
        capped = {d: min(j, len(hub), len(text) - d) for d, j in before.items()}
        far = {d: j + _common(hub, j, text, j + d) for d, j in capped.items() if j >= 0 and j + d >= 0}
    return first, max(far.values())


def _spotted(held: DataFrame, hubs: DataFrame, edits: int, steps: Steps) -> DataFrame:
    """``held(key, id, rest, ..)`` with the spots at which lines of a key are compared, and the ends of ``reach``.

    Of a line that differs from the hub (``hubs(key, hub_rest)``) at some place, lines
    within ``edits`` differ there too. So lines meet by the parts of the hub in which its
    ``reach`` ends, from the start and from the end, as far as some line ends there.
    """

    @F.pandas_udf("struct<p:int,f:int,s:int,t:int>")
    def ends(texts: pd.Series, hub_texts: pd.Series) -> pd.DataFrame:
        both = [reach(t, h, edits) + reach(t[::-1], h[::-1], edits) for t, h in zip(texts, hub_texts, strict=True)]
        return pd.DataFrame(both, columns=list("pfst"))

    size = F.greatest(F.lit(1), F.ceil(F.length("hub_rest") / F.lit(SPOTS)).cast("int"))
    near = held.join(_few(hubs), "key").withColumn("at", ends("rest", "hub_rest")).withColumn("size", size)
    near = steps.keep(near.select(*held.columns, "at.*", "size"), "near")
    cell = lambda end: F.floor(F.col(end) / F.col("size")).cast("int")
    cells = steps.keep(near.groupBy("key").agg(F.collect_set(cell("p")).alias("ps"), F.collect_set(cell("s")).alias("ss")), "cells")
    some = lambda have, a, b: F.array_intersect(have, F.sequence(cell(a), cell(b)))
    each = near.join(_few(cells), "key").withColumn("x", F.explode(some("ps", "p", "f"))).withColumn("y", F.explode(some("ss", "s", "t")))
    return steps.keep(each.select(F.xxhash64("key", "x", "y").alias("spot"), *held.columns, "p", "f", "s", "t"), "spots")


def _met(index: DataFrame, probes: DataFrame, also: str = "true") -> DataFrame:
    """Pairs (a, b) of ids that share a spot and reach as far as lines within the edits do."""
    side = lambda x, name: x.select("spot", F.struct(*[c for c in x.columns if c not in ("spot", "key", "rest")]).alias(name))
    reached = "x.p <= y.f AND y.p <= x.f AND x.s <= y.t AND y.s <= x.t"
    both = side(index, "x").join(side(probes, "y"), "spot").where(f"x.id <> y.id AND {reached} AND {also}")
    return both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def _matched(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids that share a key."""
    pairs = index.select("key", F.col("id").alias("a")).join(probes.select("key", F.col("id").alias("b")), "key").where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _crowded(index: DataFrame, key: str, crowd: int, steps: Steps) -> DataFrame:
    """The keys that more than ``crowd`` entries share, with their number."""
    return steps.keep(index.groupBy(key).agg(F.count(F.lit(1)).alias("n_key")).where(F.col("n_key") > crowd), "crowded")


def _cut_again(spots: DataFrame, full: DataFrame) -> DataFrame:
    """What remains of the lines of crowded spots, to be cut in turn."""
    rest = spots.join(full, "spot", "left_semi").select(F.col("spot").alias("prefix"), "id", F.col("rest").alias("text"), F.length("rest").alias("n"))
    return rest.distinct()


def candidates(lines: DataFrame, edits: int = EDITS, crowd: int = CROWD, rounds: int = ROUNDS) -> DataFrame:
    """Pairs (a, b) of ids of ``lines(id, text, n)``, n the length of the text, among which are all within ``edits``.

    A line is cut into edits + 1 segments; one of them is untouched by ``edits`` edits, so
    it is a substring of any line that close, near the same place. Each line is entered
    by its segments with its length, and looked up by the substrings that can be a
    segment of a line as long or shorter. A segment that more than ``crowd`` lines of a
    length share is no key by itself: what remains of its lines without it is within as
    many edits, and is compared with what remains of one of them, the hub. Lines meet only
    where they leave the hub at like places (``_spotted``). Where more than ``crowd`` do,
    what remains is cut and looked up in turn, ``rounds`` times at most.
    """
    steps = Steps(lines.sparkSession)
    todo = lines.select("id", "text", "n", F.lit(0).cast("long").alias("prefix"))
    entered, sought, found = todo, todo, None
    for again in range(rounds + 1):
        index, probes = _entries(entered, _index(edits), edits), _entries(sought, _probes(edits), edits)
        crowded = _crowded(index, "key", crowd, steps)
        if crowded.isEmpty():
            pairs = _matched(index, probes)
            found = pairs if found is None else found.unionByName(pairs)
            break
        keys = _few(crowded.select("key"))
        pairs = _matched(*(x.join(keys, "key", "left_anti") for x in (index, probes)))
        found = pairs if found is None else found.unionByName(pairs)
        owners = steps.keep(_entries(entered, _index(edits), edits, keys), "owners")
        holders = steps.keep(_entries(_of_lengths(sought, owners, edits), _probes(edits), edits, keys), "holders")
        hubs = steps.keep(owners.groupBy("key").agg(F.min_by("rest", "id").alias("hub_rest")), "hubs")
        both = owners.withColumn("entered", F.lit(True)).unionByName(holders.withColumn("entered", F.lit(False))).drop("target")
        spots = _spotted(both, hubs, edits, steps)
        index, probes = spots.where("entered"), spots.where("NOT entered")
        full = _crowded(index, "spot", crowd, steps)
        last = again == rounds or full.isEmpty()
        if last:
            found = found.unionByName(_met(index, probes))
            break
        full = _few(full.select("spot"))
        found = found.unionByName(_met(*(x.join(full, "spot", "left_anti") for x in (index, probes))))
        entered, sought = (steps.keep(_cut_again(x, full), "rest") for x in (index, probes))
    found = keep(found.distinct(), "candidates")
    steps.drop()
    return found


def within(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Whether each pair's edit distance is at most ``edits``: banded bit-parallel, all pairs at once.

    Bit b of a word stands for row j - edits + b of column j, so the words move along the
    diagonal; the distance follows the lowest diagonal of the band and then the last row.
    """
    ordered = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    m, n = (np.array([len(p[k]) for p in ordered], np.int64) for k in (0, 1))
    out = m - n <= edits
    if not len(ordered):
        return out
    band = 2 * edits + 1
    full, top = (1 << band) - 1, 1 << (band - 1)
    width = int(m.max()) + 2 * edits + 2
    rows, columns = np.zeros((len(ordered), width), np.uint32), np.zeros((len(ordered), int(n.max()) + 1), np.uint32)
    for i, (a, b) in enumerate(ordered):
        rows[i, edits + 1 : edits + 1 + len(a)] = np.frombuffer(a.encode("utf-32-le"), np.uint32)
        columns[i, 1 : 1 + len(b)] = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    # rows[i, edits + r] is character r of the first text; 0 is outside.
    vp = np.full(len(ordered), full ^ ((1 << edits) - 1), np.int64)
    vn = np.zeros(len(ordered), np.int64)
    score = np.full(len(ordered), edits, np.int64)
    for j in range(1, int(n.max()) + 1):
        same = np.zeros(len(ordered), np.int64)
        for b in range(band):
            at = rows[:, j + b]
            same |= ((at == columns[:, j]) & (at != 0)).astype(np.int64) << b
        d0 = ((((same & vp) + vp) ^ vp) | same | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        last = m - j + edits
        in_row = np.clip(last, 0, band - 1)
        along = ((hp >> in_row) & 1) - ((hn >> in_row) & 1)
        score += np.where(j > n, 0, np.where(last >= band - 1, (d0 & top) == 0, along))
        vp, vn = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
    return out & (score <= edits)


def _verified(pairs: DataFrame, lines: DataFrame, edits: int, steps: Steps) -> DataFrame:
    """The candidate pairs whose texts are within ``edits``."""
    ids = steps.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = steps.keep(lines.join(ids, "id", "left_semi").select("id", "id2", "text"), "texts")
    side = lambda x: texts.select(F.col("id").alias(x), F.struct("id", "id2").alias(f"{x}2"), F.col("text").alias(f"{x}_text"))

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        order = np.argsort(a.str.len().to_numpy(), kind="stable")
        out = np.zeros(len(a), bool)
        for i in range(0, len(order), 512):  # lines of like length together
            part = order[i : i + 512]
            out[part] = within(list(zip(a.iloc[part], b.iloc[part], strict=True)), edits)
        return pd.Series(out)

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(close("a_text", "b_text")).select(F.col("a2").alias("u"), F.col("b2").alias("v"))


def class_links(lines: DataFrame, edits: int = EDITS, crowd: int = CROWD, rounds: int = ROUNDS) -> DataFrame:
    """Links (u, v) of ``lines(id, id2, text, n)`` that connect what all pairs within ``edits`` connect.

    As ``candidates``, but of a segment that more than ``crowd`` lines share, all lines
    that can hold it are first compared with one of them, the hub: the one whose
    segments the most lines share. What that connects needs no more comparing. Where
    lines stay apart from their hub, they and the others of the segment meet as in
    ``candidates``, in pairs of which the classes differ and at least one is such a stranger.
    """
    steps = Steps(lines.sparkSession)
    todo = lines.select("id", "text", "n", F.lit(0).cast("long").alias("prefix"))
    entered, sought, links = todo, todo, None
    for again in range(rounds + 1):
        index, probes = _entries(entered, _index(edits), edits), _entries(sought, _probes(edits), edits)
        crowded = _crowded(index, "key", crowd, steps)
        if crowded.isEmpty():
            pairs = steps.keep(_matched(index, probes).distinct(), "candidates")
            found = steps.keep(_verified(pairs, lines, edits, steps), "links")
            links = found if links is None else links.unionByName(found)
            break
        keys = _few(crowded)
        rare = [x.join(keys, "key", "left_anti") for x in (index, probes)]
        owners = steps.keep(_entries(entered, _index(edits), edits, keys).join(keys, "key"), "owners")
        scored = owners.join(owners.groupBy("id").agg(F.sum("n_key").alias("score")), "id")
        hubs = scored.groupBy("key").agg(F.max(F.struct("score", "id", "rest")).alias("top"))
        hubs = steps.keep(hubs.select("key", F.col("top.id").alias("hub"), F.col("top.rest").alias("hub_rest")), "hubs")
        holders = steps.keep(_entries(_of_lengths(sought, owners, edits), _probes(edits), edits, keys), "holders")
        named = holders.join(_few(hubs.select("key", "hub")), "key")
        pairs = _matched(*rare).unionByName(named.where("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")))
        pairs = steps.keep(pairs.distinct(), "candidates")
        found = steps.keep(_verified(pairs, lines, edits, steps), "links")
        links = found if links is None else links.unionByName(found)
        known = steps.keep(connected(links).select(F.col("node.id").alias("id"), F.col("component.id").alias("part")).distinct(), "known")
        part_of = lambda x, out: known.select(F.col("id").alias(x), F.col("part").alias(out))
        both = owners.select("key", "id", "rest", F.lit(True).alias("entered")).unionByName(holders.select("key", "id", "rest", F.lit(False).alias("entered")))
        named = both.join(_few(hubs.select("key", "hub")), "key").join(part_of("id", "own"), "id", "left").join(part_of("hub", "hubs"), "hub", "left")
        named = named.select("key", "id", "rest", "entered", F.coalesce("own", "id").alias("part"), F.coalesce("hubs", "hub").alias("hub_part"))
        members = steps.keep(named.withColumn("stranger", F.col("part") != F.col("hub_part")).drop("hub_part"), "members")
        strange = steps.keep(members.where("stranger").select("key").distinct(), "strange")
        if strange.isEmpty():
            break
        spots = _spotted(members.join(_few(strange), "key", "left_semi"), hubs.select("key", "hub_rest"), edits, steps)
        index, probes = spots.where("entered"), spots.where("NOT entered")
        full = _crowded(index, "spot", crowd, steps)
        last = again == rounds or full.isEmpty()
        full = _few(full.select("spot"))
        some = (index, probes) if last else [x.join(full, "spot", "left_anti") for x in (index, probes)]
        more = steps.keep(_met(*some, "x.part <> y.part AND (x.stranger OR y.stranger)").distinct(), "met")
        links = links.unionByName(steps.keep(_verified(more, lines, edits, steps), "links"))
        if last:
            break
        entered, sought = (steps.keep(_cut_again(x, full), "rest") for x in (index, probes))
    links = keep(links.distinct(), "links")
    steps.drop()
    return links


def line_classes(
    lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, crowd: int = CROWD, rounds: int = ROUNDS, all_links: bool = True
) -> DataFrame:
    """(id, id2, class, keeper, n_links) of the different lines of ``lines_of``.

    Lines within ``edits`` insertions, deletions or substitutions of each other are
    linked, if both have ``min_chars`` characters; n_links counts the links of a line to
    other lines. What links reach is a class, named by its smallest line id. Its keeper
    is the smallest doc_id that holds one of its lines; null counts as the largest.
    Without ``all_links`` the classes are the same, but found without all pairs of a
    class, and n_links counts only the links that were taken.
    """
    steps = Steps(lines.sparkSession)
    distinct = lines.groupBy(F.col("line").alias("text")).agg(F.min("doc_id").alias("least")).select(
        *line_id(F.col("text")), "least", "text", F.length("text").alias("n")
    )
    distinct = steps.keep(distinct, "distinct")
    long = distinct.where(F.col("n") >= min_chars).select("id", "id2", "text", "n")
    if all_links:
        pairs = candidates(long, edits, crowd, rounds)
        links = steps.keep(_verified(pairs, long, edits, steps), "links")
    else:
        links = class_links(long, edits, crowd, rounds)
    classes = connected(links)
    degrees = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = steps.keep(classes.join(degrees, "node").select("node.*", F.col("component").alias("class"), "n_links"), "linked")
    rows = distinct.select("id", "id2", "least").join(linked, ["id", "id2"], "left")
    own = F.struct("id", "id2")
    rows = rows.select("id", "id2", "least", F.coalesce("class", own).alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = steps.keep(rows, "rows")
    keeper = rows.groupBy("class").agg(F.min("least").alias("keeper"))
    done = keep(rows.join(keeper, "class").select("id", "id2", F.col("class.id").alias("class"), "keeper", "n_links"), "classes")
    steps.drop()
    return done


def _placed(docs: DataFrame, doc_id: str, text: str, **options) -> DataFrame:
    """``line_duplicates`` with the text_hash of the row."""
    lines = lines_of(docs, doc_id, text)
    classes = line_classes(lines, **options)
    placed = lines.select("doc_id", "text_hash", "line_no", *line_id(F.col("line"))).join(classes, ["id", "id2"])
    mine = keep(placed.select("doc_id", "text_hash", "line_no", "class", "keeper", "n_links"), "placed")
    place = F.struct("text_hash", "line_no")
    home = mine.where(F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("class").agg(F.min(place).alias("first"))
    home = keep(home, "home")
    kept = F.col("doc_id").eqNullSafe(F.col("keeper")) & (place == F.col("first"))
    return mine.join(home, "class").select("doc_id", "text_hash", "line_no", F.col("class").alias("class_id"), "n_links", kept.alias("kept"))


def line_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, line_no, class_id, n_links, kept) for every line that is not blank.

    See ``line_classes``. Of each class the first line in the document with the smallest
    doc_id is kept. Rows that repeat a doc_id and its text are one document; different
    texts of a doc_id, or without one, are as many documents, the one with the smallest
    hash first. A null text counts as empty and has no lines. Other columns are not read.
    """
    return _placed(docs, doc_id, text, **options).drop("text_hash")


def without_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the text of each row reduced to its blank lines and those of its lines that are kept.

    No row is dropped; a text that has all its lines elsewhere becomes empty. A null text
    stays null. All other columns stay as they are.
    """
    small_batches(docs.sparkSession)
    dropped = _placed(docs, doc_id, text, all_links=False, **options).where(~F.col("kept"))
    own = [F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")]
    gone = keep(dropped.groupBy(*own).agg(F.collect_set("line_no").alias("gone")), "gone")

    @F.pandas_udf("string")
    def rest(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch, drops in texts:
            yield pd.Series([t if t is None or d is None else _rest(t, set(d)) for t, d in zip(batch, drops, strict=True)])

    same = docs[doc_id].eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == gone["gone_hash"])
    joined = docs.join(gone, same, "left")
    return joined.select(*[(rest(docs[text], gone["gone"]).alias(text) if c == text else docs[c]) for c in docs.columns])


def _rest(text: str, gone: set[int]) -> str:
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
