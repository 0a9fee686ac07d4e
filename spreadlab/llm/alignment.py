"""Alignment of two tokenizers: groups of tokens between common cuts, and how usual each pair of ids is.

The spans that the libraries report are coarse cuts: character offsets of one tokenizer, and the
other's spans of its immutable result, which its newer versions return as an offset mapping. Where a cut falls
inside a multibyte character or belongs to a byte-fallback token, it is refined with the bytes that
the tokens decode to.

A text is cut at single spaces and line ends between other characters, which no token of
either tokenizer crosses, so the alignment of a whole text is that of its parts in a row, and
parts that were seen before are remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import keep, small_batches

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Between characters that are no white space, before a space or line end.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
# Parts and links that a worker remembers.
KNOWN_PARTS = 500_000
KNOWN_LINKS = 8_000_000
# Characters of new parts that are encoded as one text.
TOGETHER = 1 << 14
# Links of a block: documents whose ids are counted and looked up together.
BLOCK_LINKS = 1 << 21
# Ids of the second tokenizer are below this.
IDS = 1 << 32

_BLOCKED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
    "refs array<int>, times array<int>, pairs array<long>, holders array<int>"
)
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refined_ends(starts: np.ndarray, ends: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from their character spans, the byte each character starts at, and the bytes they decode to.

    A coarse end holds unless the token's span is empty or shares a character with the next token's: then
    the cut is as many bytes behind the last one that held as the tokens since decode to.
    """
    if not len(ends):
        return np.empty(0, np.int64)
    coarse, read = at[ends], np.cumsum(sizes)
    next_start, next_end = np.append(starts[1:], ends[-1]), np.append(ends[1:], ends[-1] + 1)
    shared = (starts == ends) | (next_start < ends) | (next_end <= ends)
    last = np.maximum.accumulate(np.where(shared, -1, np.arange(len(ends))))
    return np.where(last < 0, read, coarse[last] + read - read[last])


class Aligner:
    """What is known of the parts of texts: tokens, groups, and the id pair of every link."""

    def __init__(self, byte_level: str = BYTE_LEVEL, pieces: str = PIECES):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_level)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = byte_level_alphabet()
        with open(byte_level, encoding="utf-8") as file:
            added = {t["id"]: t["content"] for t in json.load(file)["added_tokens"]}
        size = self.first.get_vocab_size()
        self.first_bytes = [
            added[i].encode() if i in added else bytes(alphabet[c] for c in self.first.id_to_token(i) or "") for i in range(size)
        ]
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.second_bytes = [
            bytes([int(name[3:5], 16)]) if self.second.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)
        ]
        self.sizes = [np.array([len(b) for b in table], np.int64) for table in (self.first_bytes, self.second_bytes)]
        self.mark = self.second.piece_to_id(SPACE)
        # Only then may a text be cut: pieces have a space mark at their start alone and hold no line end.
        self.cuts = not any(SPACE in name.lstrip(SPACE) or "\n" in name for name in names)
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.empty((0, 4), np.int64)
        self.starts = np.empty(0, np.int64)
        self.codes = np.empty(0, np.int64)
        self.used = 0

    def parts(self, text: str) -> list[str]:
        """A space and the text, cut."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def learn(self, parts: list[str]) -> None:
        """Align new parts, many in a row as one text: each starts where a text may be cut."""
        row, size = [], 0
        for part in parts:
            # Behind white space nothing may follow.
            alone = not self.cuts or part[-1].isspace()
            if row and (alone or size > TOGETHER):
                self._learn(row)
                row, size = [], 0
            if alone:
                self._learn([part])
            else:
                row.append(part)
                size += len(part)
        if row:
            self._learn(row)

    def _learn(self, parts: list[str]) -> None:
        text = "".join(parts)
        raw = text.encode()
        ours = self.first.encode(text, add_special_tokens=False)
        # The second tokenizer puts a space before what it gets.
        spaced = text[0] == " "
        theirs = self.second.encode(text[1:] if spaced else text, return_type="offset_mapping")
        a_ids, b_ids = np.array(ours.ids, np.int64), np.array(theirs["ids"], np.int64)
        a_spans = np.array(ours.offsets, np.int64).reshape(-1, 2)
        b_spans = np.array(theirs["offsets"], np.int64).reshape(-1, 2) + spaced
        if spaced and len(b_ids):
            b_spans[0, 0] = 0
        elif len(b_ids) and b_ids[0] == self.mark:
            b_ids, b_spans = b_ids[1:], b_spans[1:]
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))]).astype(np.int64)
        spelled = [b"".join([table[i] for i in ids.tolist()]) for table, ids in ((self.first_bytes, a_ids), (self.second_bytes, b_ids))]
        if spelled[0] != raw or spelled[1] != raw:
            if len(parts) == 1:
                self._add(parts, [""], np.array([[-1, -1, -1, 0]]), np.empty(0, np.int64))
            else:
                self._learn(parts[: len(parts) // 2])
                self._learn(parts[len(parts) // 2 :])
            return
        a_ends = refined_ends(a_spans[:, 0], a_spans[:, 1], at, self.sizes[0][a_ids])
        b_ends = refined_ends(b_spans[:, 0], b_spans[:, 1], at, self.sizes[1][b_ids])
        # Between two neighbouring cuts of either tokenizer lies one token of each: a link.
        cuts = np.union1d(a_ends, b_ends)
        a, b = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        common = (a_ends[a] == cuts) & (b_ends[b] == cuts)
        a_names, b_names = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        groups, i, j = [], 0, 0
        for i1, j1 in zip((a[common] + 1).tolist(), (b[common] + 1).tolist()):
            groups.append(",".join(a_names[i:i1]) + "|" + ",".join(b_names[j:j1]))
            i, j = i1, j1
        stops = at[np.cumsum([len(p) for p in parts])]
        upto = [np.searchsorted(a_ends, stops) + 1, np.searchsorted(b_ends, stops) + 1, np.cumsum(common)[np.searchsorted(cuts, stops)], np.searchsorted(cuts, stops) + 1]
        counts = np.diff(np.stack(upto, 1), axis=0, prepend=0)
        of_part, k = [], 0
        for k1 in upto[2].tolist():
            of_part.append(";".join(groups[k:k1]))
            k = k1
        self._add(parts, of_part, counts, a_ids[a] * IDS + b_ids[b])

    def _add(self, parts: list[str], groups: list[str], counts: np.ndarray, codes: np.ndarray) -> None:
        n, links = len(self.groups), self.used
        self.places.update(zip(parts, range(n, n + len(parts))))
        self.groups += groups
        if n + len(parts) > len(self.counts):
            self.counts = np.concatenate([self.counts[:n], np.empty((n + len(parts), 4), np.int64)])
            self.starts = np.concatenate([self.starts[:n], np.empty(n + len(parts), np.int64)])
        if links + len(codes) > len(self.codes):
            self.codes = np.concatenate([self.codes[:links], np.empty(links + len(codes), np.int64)])
        self.counts[n : n + len(parts)] = counts
        self.starts[n : n + len(parts)] = links + np.cumsum(counts[:, 3]) - counts[:, 3]
        self.codes[links : links + len(codes)] = codes
        self.used += len(codes)

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """Per text the counts of tokens and groups, the digest of the groups, and the id pair of every link."""
        cut = [self.parts(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.places)
        if new:
            self.learn(list(new))
        out = []
        for parts in cut:
            places = [self.places[p] for p in parts]
            counts = self.counts[places]
            if not parts or counts[:, 0].min() < 0:
                out.append((0, 0, 0, "", np.empty(0, np.int64)))
                continue
            a, b, n, links = counts.sum(0).tolist()
            digest = hashlib.sha256(";".join([self.groups[i] for i in places]).encode()).hexdigest()
            skipped = self.starts[places] - np.cumsum(counts[:, 3]) + counts[:, 3]
            out.append((a, b, n, digest, self.codes[np.arange(links) + np.repeat(skipped, counts[:, 3])]))
        if len(self.places) > KNOWN_PARTS or self.used > KNOWN_LINKS:
            self.forget()
        return out


@lru_cache(maxsize=2)
def _aligner(byte_level: str, pieces: str) -> Aligner:
    """One per worker: what it knows outlives a task."""
    return Aligner(byte_level, pieces)


def _close(block: int, rows: list[tuple]) -> pd.DataFrame:
    """The rows of a block, whose id pairs refer to the last row's list, which says how many rows hold each."""
    pairs, refs, holders = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
    refs = np.split(refs.astype(np.int32), np.cumsum([len(r[5]) for r in rows])[:-1])
    out = pd.DataFrame([r[:5] for r in rows], columns=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])
    out = out.assign(refs=refs, times=[r[6] for r in rows], pairs=None, holders=None)
    out.loc[len(out)] = [None, None, None, None, None, None, None, pairs, holders.astype(np.int32)]
    out.insert(0, "block", block)
    return out.astype({c: "Int64" for c in ("doc_id", "n_a", "n_b", "n_groups")})


def blocked(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Every document aligned by itself, in blocks of neighbours, and one row per block with its id pairs."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(byte_level, pieces)
        block, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for doc_id, (a, b, groups, digest, codes) in zip(ids, aligner.align(texts)):
                distinct, times = np.unique(codes, return_counts=True)
                rows.append((doc_id, a, b, groups, digest, distinct, times.astype(np.int32)))
                held += len(codes)
                if held >= block_links:
                    yield _close(block, rows)
                    block, rows, held = block + 1, [], 0
        if rows:
            yield _close(block, rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(of, _BLOCKED)


def _look_up(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Sums over the links of each document of a block, from what is known of the block's id pairs."""
    known = known.sort_values("place")
    n, best = known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)
    sums = [
        (int(t.sum()), int(t[best[r]].sum()), int((n[r] * t.astype(np.int64)).sum()))
        for r, t in ((np.asarray(r, np.int64), np.asarray(t, np.int64)) for r, t in zip(rows["refs"], rows["times"]))
    ]
    out = rows[["doc_id", "n_a", "n_b", "n_groups"]].astype("Int64")
    for place, name in enumerate(("n_links", "n_best", "count_sum")):
        out[name] = pd.array([s[place] for s in sums], "Int64")
    return out.assign(groups_sha256=rows["groups_sha256"])


def align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row per row of ``docs``: tokens, groups and links of both tokenizers, and how usual the links are.

    (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256). A link is a pair of
    tokens whose bytes overlap; its count is the number of rows that hold its pair of ids linked,
    ``n_best`` are the links whose count is the highest of their first id. A text that is null
    or empty, or that the tokens of either tokenizer do not spell out, has zeros and an empty
    digest. Rows with the same or no id count as rows of their own; other columns are not read.

    Counts go to the documents by blocks: neighbouring documents list their id pairs once, the list
    is joined with the counts, and every document adds up what it holds. Neither the counts nor the
    documents are broadcast, and a block has about ``block_links`` links or a single document.
    """
    rows = keep(blocked(docs, byte_level, pieces, block_links), "aligned")
    lists = rows.where(F.col("pairs").isNotNull())
    each = lists.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "p")).select(
        "block", "place", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders")
    )
    counts = keep(each.groupBy("pair").agg(F.sum("holders").alias("n")), "pairs")
    first = F.expr(f"pair div {IDS}L")
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    ranked = counts.withColumn("a", first).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    known = each.drop("holders").join(ranked, "pair").select(F.col("block").alias("of_block"), "place", "n", "best")
    texts = rows.where(F.col("pairs").isNull()).drop("pairs", "holders")
    return texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInPandas(_look_up, _ALIGNED)
