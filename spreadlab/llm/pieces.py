"""SentencePiece encoding as a max-plus scan over chunks, and decoding.

The best segmentation of a text has the largest sum of piece scores. Between two cuts
this is a product of max-plus matrices: the scores of the last positions before a cut
(the boundary states, as many as a piece is long) map to those before the next one.
Chunks of a giant document yield their matrices independently, an associative scan
gives every chunk the scores it starts from, and each is backtraced by itself.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.llm.common import keep, small_batches, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Characters of a chunk; longer documents are split.
CHUNK = 1 << 16
# An unknown character scores this much less than the worst piece (fixed value of the algorithm).
UNKNOWN_PENALTY = 10
NONE = -(1 << 60)
# The most pieces of a model that is broadcast.
MOST_PIECES = 1 << 20
# Words whose segmentation a worker remembers.
CACHED = 400_000


@dataclass
class Model:
    """The pieces of a model file, as plain data that executors can hold."""

    ids: dict[str, int]
    scores: dict[str, int]
    pieces: list[str]
    bytes_at: list[int]
    unknown: int
    fallback: bool
    dummy_prefix: bool
    cuts: bool = field(init=False)
    longest: int = field(init=False)
    # Neighbours within some piece; between two other characters none spans.
    neighbours: set[str] = field(init=False)
    # For the last two characters of some text: the score of the last one, of both as a piece or None, and the
    # lengths of the longer pieces that end in them.
    ends: dict[str, tuple[int, int | None, tuple[int, ...]]] = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.scores), default=1)
        # Then no piece spans a space that follows something else, or a line end.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in self.scores)
        self.neighbours = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.worst = min(self.scores.values(), default=0) - UNKNOWN_PENALTY
        longer: dict[str, set[int]] = {pair: set() for pair in self.neighbours}
        for piece in self.scores:
            if len(piece) > 2:
                longer[piece[-2:]].add(len(piece))
        get = self.scores.get
        self.ends = {pair: (get(pair[1], self.worst), get(pair), tuple(sorted(some))) for pair, some in longer.items()}


def load(path: str = MODEL) -> Model:
    """The pieces and scores of a SentencePiece model file; its scores must be whole numbers or are scaled to such."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = {i: sp.get_score(i) for i in plain}
    scale = 1 if all(s == int(s) for s in scores.values()) else 1 << 20
    bytes_at = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    fallback = all(sp.is_byte(i) for i in bytes_at)
    prefix = sp.encode("a", out_type=str)[0].startswith(SPACE)
    return Model(
        {pieces[i]: i for i in plain}, {pieces[i]: round(s * scale) for i, s in scores.items()}, pieces, bytes_at if fallback else [], sp.unk_id(), fallback, prefix
    )


def normalised(text: str, model: Model) -> str:
    """Spaces as the model writes them, and one before the text."""
    return (SPACE if model.dummy_prefix and text else "") + text.replace(" ", SPACE)


def ids_of(part: str, model: Model) -> list[int]:
    """The ids of a piece, or of the bytes of an unknown character."""
    known = model.ids.get(part)
    if known is not None:
        return [known]
    return [model.bytes_at[b] for b in part.encode()] if model.fallback else [model.unknown]


def candidates(text: str, end: int, model: Model, start: int = 0) -> Iterator[tuple[int, int]]:
    """(start, score) of the pieces of ``text`` that end at ``end``, longest first."""
    scores = model.scores
    for at in range(max(start, end - model.longest), end - 1):
        score = scores.get(text[at:end])
        if score is not None:
            yield at, score
    yield end - 1, scores.get(text[end - 1], model.worst)


def segment(text: str, model: Model) -> list[str]:
    """The best segmentation; of equal scores the one whose last piece is longest, at every position."""
    worst, get = model.worst, model.scores.get
    top = get(text[:1], worst)
    best, back = [0, top], [0, 0]
    # What ends at a place is looked up by the two characters before it; nothing longer than one does if it is not found.
    for end, found in enumerate(map(model.ends.get, map(add, text, text[1:])), 2):
        source = end - 1
        if found is None:
            top += get(text[source], worst)
        else:
            single, both, lengths = found
            top += single
            if both is not None and best[end - 2] + both >= top:
                top, source = best[end - 2] + both, end - 2
            for length in lengths:
                at = end - length
                if at < 0:
                    break
                score = get(text[at:end])
                if score is not None and best[at] + score >= top:
                    top, source = best[at] + score, at
        best.append(top)
        back.append(source)
    out, end = [], len(text)
    while end:
        out.append(text[back[end] : end])
        end = back[end]
    return out[::-1]


_WORDS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Encoder(dict):
    """Word to the bytes of its ids. Between words no piece spans, so each is segmented by itself and remembered.

    Nor does one span two characters that are not neighbours, so a word is cut there.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.older = model, {}

    def __missing__(self, word: str) -> bytes:
        found, near = self.older.get(word), self.model.neighbours
        whole = found is not None or near.issuperset(map(add, word, word[1:]))
        cuts = [] if whole else [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in near]
        if cuts:
            found = b"".join([self[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)])
        elif found is None:
            known, parts = self.model.ids, segment(word, self.model)
            found = array("i", [i for p in parts for i in ((known[p],) if p in known else ids_of(p, self.model))]).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a normalised text."""
        words = _WORDS.findall(text) if self.model.cuts else [text] * bool(text)
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def advance(context: str, text: str, entry: np.ndarray, model: Model) -> np.ndarray:
    """Boundary states after ``text``, from those before it (rows of ``entry``; column j is j characters before the cut).

    ``context`` holds the characters before the cut that pieces can start in.
    """
    width, before = model.longest, len(context)
    whole = context + text
    columns = [np.full(entry.shape[0], NONE, np.int64) for _ in range(max(0, before - width + 1))]
    columns += [entry[:, before - at] for at in range(len(columns), before + 1)]
    for end in range(before + 1, len(whole) + 1):
        top = np.full(entry.shape[0], NONE, np.int64)
        for at, score in candidates(whole, end, model, max(0, end - width)):
            np.maximum(top, columns[at] + score, out=top)
        columns.append(np.maximum(top, NONE))
    out = np.full((entry.shape[0], width), NONE, np.int64)
    for j in range(min(width, len(columns))):
        out[:, j] = columns[len(whole) - j]
    return out


def transfer(context: str, text: str, model: Model) -> np.ndarray:
    """The max-plus matrix of a chunk: from its entry states (rows) to its exit states."""
    unit = np.full((model.longest, model.longest), NONE, np.int64)
    np.fill_diagonal(unit, 0)
    cuts = [m.start() for m in _WORDS.finditer(text) if m.start() >= model.longest] if model.cuts else []
    if len(cuts) < 2:
        return advance(context, text, unit, model)
    # All paths pass both cuts: one number stands for what is between them.
    first, last = cuts[0], cuts[-1]
    entry = advance(context, text[:first], unit, model)[:, :1]
    middle = sum(model.scores.get(p, model.worst) for w in _WORDS.findall(text[first:last]) for p in segment(w, model))
    start = np.full((1, model.longest), NONE, np.int64)
    start[0, 0] = 0
    rest = advance(text[first:last][-model.longest :], text[last:], start, model)
    return np.maximum(entry + middle + rest, NONE)


def trace(context: str, text: str, entry: np.ndarray, exits: Sequence[int], model: Model) -> dict[int, tuple[int, list[str]]]:
    """For each exit state: the entry state its best path comes from, and the pieces between."""
    before, whole, width = len(context), context + text, model.longest
    best = {before - j: int(entry[j]) for j in range(min(width, before + 1))}
    back: dict[int, int] = {}
    for end in range(before + 1, len(whole) + 1):
        top, source = NONE, end - 1
        for at, score in candidates(whole, end, model, max(0, end - width)):
            if best.get(at, NONE) + score > top:
                top, source = best.get(at, NONE) + score, at
        best[end], back[end] = max(top, NONE), source
    out = {}
    for j in exits:
        pieces, end = [], len(whole) - j
        while end > before:
            pieces.append(whole[back[end] : end])
            end = back[end]
        out[j] = before - end, pieces[::-1]
    return out


def scan(matrices: np.ndarray) -> np.ndarray:
    """Entry states of every chunk: the products of all matrices before it, combined in log2 rounds."""
    width = matrices.shape[1]
    unit = np.full((width, width), NONE, np.int64)
    np.fill_diagonal(unit, 0)
    done = [unit, *matrices[:-1]]
    step = 1
    while step < len(done):
        done = [_product(done[i - step], d) if i >= step else d for i, d in enumerate(done)]
        step *= 2
    return np.stack([d[0] for d in done])


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, chunk, context, text) of normalised documents; ``row`` tells apart rows of one doc_id."""
    count = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    rows = docs.select(F.uuid().alias("row"), "doc_id", "text")
    cut = rows.select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    start = F.col("chunk") * chunk + 1
    back = F.least(F.col("chunk") * chunk, F.lit(overlap))
    return cut.select(
        "row", "doc_id", "chunk", F.substring("text", start - back, back).alias("context"), F.substring("text", start, F.lit(chunk)).alias("text")
    )


def _giants(docs: DataFrame, model, chunk: int) -> DataFrame:
    """(doc_id, ids) of documents that are split."""
    width = model.value.longest
    parts = keep(_chunks(docs, chunk, width), "chunks")

    @F.pandas_udf("array<long>")
    def matrix(contexts: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([transfer(c, t, model.value).ravel() for c, t in zip(contexts, texts, strict=True)])

    def entries(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        found = scan(np.stack(group["matrix"].to_numpy()).reshape(-1, width, width))
        return pd.DataFrame({"row": group["row"], "chunk": group["chunk"], "entry": list(found)})

    starts = parts.select("row", "chunk", matrix("context", "text").alias("matrix")).groupBy("row").applyInPandas(entries, "row string, chunk int, entry array<long>")
    ready = keep(parts.join(starts, ["row", "chunk"]), "entries")

    @F.pandas_udf("array<int>")
    def sources(contexts: pd.Series, texts: pd.Series, entry: pd.Series) -> pd.Series:
        # States that no path reaches have no source.
        def of(c, t, e):
            reach = [j for j in range(min(width, len(c) + len(t) + 1)) if j <= len(t)]
            found = trace(c, t, np.asarray(e), reach, model.value)
            return np.array([found[j][0] if j in found else j - len(t) for j in range(width)], np.int32)

        return pd.Series([of(c, t, e) for c, t, e in zip(contexts, texts, entry, strict=True)])

    def exits(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        state, out = 0, []
        for source in group["source"].to_numpy()[::-1]:
            out.append(state)
            state = int(source[state])
        return pd.DataFrame({"row": group["row"], "chunk": group["chunk"], "state": out[::-1]})

    ends = ready.select("row", "chunk", sources("context", "text", "entry").alias("source")).groupBy("row").applyInPandas(exits, "row string, chunk int, state int")

    @F.pandas_udf("array<int>")
    def ids(contexts: pd.Series, texts: pd.Series, entry: pd.Series, state: pd.Series) -> pd.Series:
        def of(c, t, e, s):
            if s > len(t):
                return np.empty(0, np.int32)
            pieces = trace(c, t, np.asarray(e), [int(s)], model.value)[int(s)][1]
            return np.array([i for p in pieces for i in ids_of(p, model.value)], np.int32)

        return pd.Series([of(*x) for x in zip(contexts, texts, entry, state, strict=True)])

    coded = ready.join(ends, ["row", "chunk"]).select("row", "doc_id", F.struct("chunk", ids("context", "text", "entry", "state").alias("ids")).alias("part"))
    joined = coded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("part")).alias("parts"))
    return joined.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def _shared(spark: SparkSession, model: Model | str):
    small_batches(spark)
    model = load(model) if isinstance(model, str) else model
    if len(model.pieces) > MOST_PIECES:
        raise ValueError(f"a model of {len(model.pieces)} pieces is too large to broadcast")
    return spark.sparkContext.broadcast(model)


def encode(docs: DataFrame, model: Model | str = MODEL, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the best segmentation of every whole text into the model's pieces.

    Texts over ``chunk`` characters are split and scanned, which gives the same ids.
    Characters that no piece holds become the ids of their UTF-8 bytes. A null text
    counts as empty and has no ids. Repeated rows and ids stay; other columns are not
    read. ``model`` is a file or a loaded model of at most ``MOST_PIECES`` pieces.
    """
    shared = _shared(docs.sparkSession, model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for batch in batches:
            yield batch.map(lambda t: encoder.encode(normalised(t, encoder.model)))

    short = rows.where(F.length("text") <= chunk).select("doc_id", ids("text").alias("ids"))
    prefix = F.lit(SPACE if shared.value.dummy_prefix else "")
    giants = rows.where(F.length("text") > chunk).withColumn("text", F.concat(prefix, F.replace("text", F.lit(" "), F.lit(SPACE))))
    return short.unionByName(_giants(giants, shared, chunk))


def decode(coded: DataFrame, model: Model | str = MODEL, ids: str = "ids") -> DataFrame:
    """``coded`` with a column ``decoded``: the text of its ids.

    It is the text that was encoded, except that the model's sign for a space is a
    space. Control pieces are empty, a null list is the empty text, bytes that are no
    UTF-8 become replacement characters.
    """
    shared = _shared(coded.sparkSession, model)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        said = bytes_of(shared.value)
        drop = shared.value.dummy_prefix
        for batch in batches:
            yield batch.map(lambda row: b"".join(map(said.__getitem__, row.tolist())).decode(errors="replace")[drop:])

    return coded.withColumn("decoded", text(F.coalesce(ids, F.array().cast("array<int>"))))


def bytes_of(model: Model) -> list[bytes]:
    """What each id stands for in UTF-8."""
    said = [b""] * len(model.pieces)
    for piece, at in model.ids.items():
        said[at] = piece.replace(SPACE, " ").encode()
    for byte, at in enumerate(model.bytes_at):
        said[at] = bytes([byte])
    if not model.fallback:
        said[model.unknown] = " \u2047 ".encode()
    return said
