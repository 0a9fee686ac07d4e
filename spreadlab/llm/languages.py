"""Language identification in two steps: the family first, then the language within it.

The family with the largest likelihood of a text's n-grams is predicted from counts over all texts that
may be learned from. Within it, one linear support vector machine for each two languages votes.
Both are sums over the text's words, so a worker computes a word's part once.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import small_batches

# Language families by ISO 639-1 code. A language that is not listed is its own family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
    "sinitic": "yue zh",
    "bantu": "rw sn sw xh zu",
}
# N-grams are hashed to this many features, which bounds the model: a number per feature, family and pair of languages.
FEATURES = 1 << 16
GRAMS = 3
# At most about this many texts of a language fit its support vector machines; all of them count for the families.
FIT_ROWS = 1500
# A longer run of letters is read in pieces of this many.
LONGEST = 64
# Characters of a text that are split into words at a time.
SLICE = 1 << 20
KNOWN_WORDS = 500_000
# Words that are looked up together, and parts of texts that they are from, at most.
HELD_WORDS = 1 << 17
HELD_PARTS = 64

_LETTERS = re.compile(r"[^\W\d_]+")
_OTHER = re.compile(r"[\W\d_]")


def family_of(lang: str, families: Mapping[str, str] = FAMILIES) -> str:
    code = re.split("[-_]", lang.lower())[0]
    return next((name for name, codes in families.items() if code in codes.split()), lang)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words(text: str) -> Iterator[list[str]]:
    """The lower-cased runs of letters of a text, a slice at a time."""
    start = 0
    while start < len(text):
        cut = _OTHER.search(text, start + SLICE) if len(text) - start > SLICE else None
        end = cut.start() if cut else len(text)
        found = _LETTERS.findall(text[start:end].lower())
        if not "".join(found).isalpha():
            found = [w for w in found if any(map(str.isalpha, w))]
        if max(map(len, found), default=0) > LONGEST:
            found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
        if found:
            yield found
        start = end


# Odd numbers that mix the code points of an n-gram.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def grams(words: Sequence[str], features: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, number of the word) of all n-grams of some words, a pair of arrays for each n, and one for whole words.

    A word's borders are spaces of its n-grams. Every word has n-grams of every size, and they come in the order of words.
    """
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = points == 32
    word = np.cumsum(space) - 1
    out = []
    for n in range(1, GRAMS + 1):
        last = len(points) - n + 1
        # Borders stand at an n-gram's ends alone, and are none by themselves.
        inner = range(1, n - 1) if n > 1 else range(1)
        whole = ~np.logical_or.reduce([space[k : last + k] for k in inner]) if len(inner) else np.ones(last, bool)
        mixed = sum((points[k : last + k] + np.uint64(1)) * _MIX[k] for k in range(n)) * _MIX[3] + np.uint64(n * int(_MIX[0]) % (1 << 64))
        at = (mixed >> np.uint64(32)) % np.uint64(features)
        out.append((at[whole].astype(np.int64), word[:last][whole]))
    hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
    out.append((hashed % features, np.arange(len(words))))
    return out


def text_features(text: str, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of a whole text and how often each occurs."""
    counts: Counter[str] = Counter()
    for part in words(text):
        counts.update(part)
    return _expand(counts, features)


def _expand(counts: Counter[str], features: int) -> tuple[np.ndarray, np.ndarray]:
    if not counts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    times = np.fromiter(counts.values(), np.int64, len(counts))
    spelled = grams(list(counts), features)
    at, times = np.concatenate([f for f, _ in spelled]), np.concatenate([times[w] for _, w in spelled])
    found, where = np.unique(at, return_inverse=True)
    return found, np.bincount(where, times, len(found)).astype(np.int64)


# ------------------------------------------------------------------- training


def to_learn_from(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) of the rows that may be learned from."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")


def language_counts(taught: DataFrame, features: int) -> DataFrame:
    """(lang, feature, n): the n-grams of all texts by language, and the texts themselves as feature -1.

    A task counts words first and spells out each once; it holds a number per language and feature.
    """
    small_batches(taught.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: Counter[str] = Counter()
        counts: dict[str, Counter[str]] = {}
        totals: dict[str, np.ndarray] = {}

        def spell() -> None:
            for lang, some in counts.items():
                at, times = _expand(some, features)
                totals.setdefault(lang, np.zeros(features, np.int64))[at] += times
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                texts[lang] += 1
                for part in words(text):
                    counts.setdefault(lang, Counter()).update(part)
            if sum(map(len, counts.values())) > KNOWN_WORDS:
                spell()
        spell()
        for lang in texts:
            found = np.flatnonzero(totals.get(lang, np.zeros(0)))
            yield pd.DataFrame({"lang": lang, "feature": np.append(found, -1), "n": np.append(totals[lang][found] if len(found) else [], texts[lang]).astype(np.int64)})

    each = taught.select("lang", "text").mapInPandas(of, "lang string, feature int, n long")
    return each.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def sample_features(taught: DataFrame, texts: dict[str, int], features: int, fit_rows: int) -> DataFrame:
    """(lang, pick, features, times) of about ``fit_rows`` texts of each language, chosen by hash of id and text."""

    @F.pandas_udf("features array<int>, times array<int>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [text_features(t, features) for t in batch]
            yield pd.DataFrame({"features": [r[0].astype(np.int32) for r in rows], "times": [r[1].astype(np.int32) for r in rows]})

    bound = F.lit(0)
    for lang, n in texts.items():
        bound = F.when(F.col("lang") == lang, int(min(1.0, fit_rows / n) * (1 << 20))).otherwise(bound)
    chosen = taught.withColumn("pick", F.xxhash64("doc_id", "text")).where(F.pmod("pick", F.lit(1 << 20)) < bound)
    return chosen.select("lang", "pick", of("text").alias("f")).select("lang", "pick", "f.*").where(F.size("features") > 0)


def fit_pair(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, features: int, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine, by dual coordinate descent on the hinge loss."""
    weights, bias = np.zeros(features), 0.0
    squares = [float(v @ v) + 1.0 for _, v in rows]
    alpha = np.zeros(len(rows))
    # The rarer language's texts weigh more, as if there were as many.
    share = np.where(signs > 0, (signs > 0).sum(), (signs < 0).sum())
    limit = cost * len(signs) / (2 * np.maximum(share, 1))
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            at, values = rows[i]
            slope = signs[i] * (float(weights[at] @ values) + bias) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                weights[at] += step * values
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return weights, bias


def scaled(features: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Shares of a text's n-grams, in a size that suits the hinge loss."""
    return times * (SHARE / max(times.sum(), 1))


# Shares add up to this, which makes typical texts vectors of a length near one.
SHARE = 10.0


@dataclass
class Model:
    """Sums per feature: log-likelihoods of the families, then margins of the pairs of languages within each."""

    sums: np.ndarray
    families: list[str]
    priors: np.ndarray
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    biases: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def fit(
    docs: DataFrame,
    families: Mapping[str, str] = FAMILIES,
    features: int = FEATURES,
    fit_rows: int = FIT_ROWS,
    smoothing: float = 0.5,
    cost: float = 1.0,
    rounds: int = 30,
    seed: int = 11,
) -> Model:
    """The model learned from all texts with a language that are not held out.

    N-grams are counted over all of them, per language. Each pair of languages of a family is fitted
    in a task of its own, on about ``fit_rows`` texts of either language, chosen by hash of the id and text.
    """
    taught = to_learn_from(docs)
    counted = language_counts(taught, features).toPandas()
    texts = dict(zip(counted["lang"][counted["feature"] < 0], counted["n"][counted["feature"] < 0].astype(int)))
    counted = counted[counted["feature"] >= 0]
    members: dict[str, list[str]] = {}
    for lang in sorted(texts):
        members.setdefault(family_of(lang, families), []).append(lang)
    names = sorted(members)
    pairs = [p for name in names for p in combinations(members[name], 2)]
    home = {lang: names.index(name) for name, langs in members.items() for lang in langs}

    counts = np.full((features, len(names)), smoothing)
    np.add.at(counts, (counted["feature"].to_numpy(np.int64), counted["lang"].map(home).to_numpy(np.int64)), counted["n"].to_numpy(np.float64))
    priors = np.zeros(len(names))
    for lang, n in texts.items():
        priors[home[lang]] += n
    sums = [np.log(counts / counts.sum(0))] if names else [np.zeros((features, 0))]

    weights, biases = np.zeros((features, len(pairs))), np.zeros(len(pairs))
    if pairs:
        chosen = sample_features(taught, texts, features, fit_rows)
        both = taught.sparkSession.createDataFrame([(lang, k) for k, p in enumerate(pairs) for lang in p], "lang string, pair int")

        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["pick", "lang"], kind="stable")
            rows = [(np.asarray(f, np.int64), scaled(np.asarray(f), np.asarray(t, np.float64))) for f, t in zip(group["features"], group["times"])]
            k = int(group["pair"].iloc[0])
            signs = np.where(group["lang"] == pairs[k][1], 1.0, -1.0)
            w, b = fit_pair(rows, signs, features, cost, rounds, seed)
            return pd.DataFrame({"pair": [k], "weights": [w], "bias": [b]})

        fitted = chosen.join(F.broadcast(both), "lang").groupBy("pair").applyInPandas(one, "pair int, weights array<double>, bias double")
        for row in fitted.toLocalIterator():
            weights[:, row["pair"]], biases[row["pair"]] = row["weights"], row["bias"]
    chances = np.log(priors / max(priors.sum(), 1)) if names else priors
    return Model(np.hstack([*sums, weights]), names, chances, members, pairs, biases)


# ----------------------------------------------------------------- prediction


class Scorer:
    """Words to their place in a table of sums over each word's features."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.table = np.empty((0, self.model.sums.shape[1] + 1))

    def learn(self, new: list[str]) -> None:
        parts = np.zeros((len(new), self.table.shape[1]))
        for at, word in grams(new, len(self.model.sums)):
            begin = np.searchsorted(word, np.arange(len(new)))
            parts[:, :-1] += np.add.reduceat(self.model.sums[at], begin)
            parts[:, -1] += np.bincount(word, minlength=len(new))
        first = len(self.places)
        if first + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty((len(self.table) + len(new), self.table.shape[1]))])
        self.table[first : first + len(new)] = parts
        self.places.update(zip(new, range(first, first + len(new))))

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        """The language and score of whole texts."""
        totals = np.zeros((len(texts), self.table.shape[1]))
        held: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            for part in words(text or ""):
                held.append((i, part))
                if sum(len(p) for _, p in held[-HELD_PARTS:]) > HELD_WORDS or len(held) == HELD_PARTS:
                    self._add(held, totals)
        self._add(held, totals)
        return [self.decide(total) for total in totals]

    def _add(self, held: list[tuple[int, list[str]]], totals: np.ndarray) -> None:
        """Add the parts of texts that are held to the texts' totals."""
        if len(self.places) > KNOWN_WORDS:
            self.forget()
        new = set().union(*(part for _, part in held)).difference(self.places)
        if new:
            self.learn(list(new))
        for i, part in held:
            totals[i] += self.table[[self.places[w] for w in part]].sum(0)
        held.clear()

    def decide(self, total: np.ndarray) -> tuple[str, float]:
        """The language and its score, 0 to 1; ``und`` and 0 where there is no letter or nothing was learned."""
        model = self.model
        if not total[-1] or not model.families:
            return "und", 0.0
        fit = model.priors + total[: len(model.families)]
        best = int(np.argmax(fit))
        sure = 1 / np.exp(np.clip(fit - fit[best], -500, 0)).sum()
        langs = model.members[model.families[best]]
        margins = model.biases + total[len(model.families) : -1] * (SHARE / total[-1])
        votes = {lang: [0, 0.0] for lang in langs}
        for k, (a, b) in enumerate(model.pairs):
            if a in votes:
                votes[b if margins[k] >= 0 else a][0] += 1
                votes[a][1] -= margins[k]
                votes[b][1] += margins[k]
        lang = max(langs, key=lambda x: (*votes[x], x))
        against = [abs(margins[k]) for k, p in enumerate(model.pairs) if lang in p]
        return lang, float(sure / (1 + np.exp(-2 * min(min(against), 250)))) if against else float(sure)


# What a worker remembers outlives a task, until another model comes.
_SCORERS: list[Scorer] = []


def _scorer(model: Model) -> Scorer:
    if not _SCORERS or _SCORERS[0].model.name != model.name:
        _SCORERS[:] = [Scorer(model)]
    return _SCORERS[0]


def classify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    The prediction depends on the text alone. It is a language that texts were learned from, or ``und`` with
    score 0 if the text is null or has no letter, or if there was nothing to learn from. Rows without an id are
    learned from; repeated rows and null ids stay; of equal votes and margins the last language in order wins. Other
    columns than doc_id, text and lang are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))

    @F.pandas_udf("lang string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(shared.value)
        for batch in texts:
            yield pd.DataFrame(scorer.predict(batch), columns=["lang", "score"])

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), of("text").alias("found"))
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
