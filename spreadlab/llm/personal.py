"""Personal data by patterns, and terms that disclose it by how often they occur together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import keep, once, text_of

# The kinds in order, and their patterns. A match starts where its first
# characters do, or at the end of the match before; possessive quantifiers keep long
# texts linear, and runs of under 13 digits are passed over. Neither changes the result.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=[0-9](?:[\x20-]?[0-9]){12})[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
KINDS = [*PATTERNS, TERM]
WORD = r"[\p{L}\p{N}]++"
# Matches whose positions are summed up together.
BLOCK = 256
NO_SPANS = "array<struct<start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of digits, every second from the right doubled and its digits added, is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of the pattern is personal data of its kind."""
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", ""))
        small = lambda p: (part(p) <= 3) & (F.right(F.concat(F.lit("00"), p), F.lit(3)) <= "255")
        return F.forall(F.split(value, r"\."), small)
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _starts(lengths: Column) -> Column:
    """Where each part begins, by the lengths of the parts: running sums, within blocks and over the blocks."""

    def sums(values: Column) -> Column:
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, step)

    count = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), count), lambda k: sums(F.slice(lengths, (k - 1) * BLOCK + 1, BLOCK)))
    moved = lambda done, before: F.transform(done["out"], lambda at: at + before)
    return once(blocks, lambda done: F.flatten(F.zip_with(done, sums(F.transform(done, lambda x: x["at"]))["out"], moved)))


def located(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, value>> of all matches, in code points from 0, the end exclusive.

    The text is what stands between the matches and the matches in turn, so positions
    are running sums of their lengths. The text is taken apart once, however many
    matches it has.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    taken = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"))

    def spans(parts: Column) -> Column:
        # Each part is a match and what stands before it.
        lengths = F.transform(parts["found"], lambda v, i: F.length(F.get(parts["between"], i)) + F.length(v))
        start = lambda i, at: at + F.length(F.get(parts["between"], i))
        span = lambda v, i, at: F.struct(start(i, at).alias("start"), (start(i, at) + F.length(v)).alias("end"), v.alias("value"))
        placed = once(lengths, lambda n: once(_starts(n), lambda at: F.transform(parts["found"], lambda v, i: span(v, i, F.get(at, i)))))
        return F.when(F.size(parts["found"]) > 0, placed).otherwise(F.array().cast(NO_SPANS))

    return once(taken, spans)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind that hold, leftmost first and not overlapping within the kind; failing matches are dropped."""

    def of(kind: str) -> Column:
        return F.filter(located(text, PATTERNS[kind]), lambda s: _holds(kind, s["value"]))

    return {kind: of(kind) for kind in PATTERNS}


def words_of(text: Column) -> Column:
    """The distinct words of a text in lower case, without what looks like personal data."""
    plain = text
    for pattern in PATTERNS.values():
        plain = F.regexp_replace(plain, pattern, " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(WORD), 0))


def _written(kinds: dict[str, Column]) -> Column:
    """All spans as kind:start:end, by kind as listed, then start, joined by commas."""

    def of(kind: str) -> Column:
        return F.transform(kinds[kind], lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def _entities() -> Column:
    """The distinct protected values of a row: emails in lower case, digits of cards and phones."""
    norm = {"email": F.lower, "ip": lambda v: v, "card": _digits, "phone": _digits}

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), norm[kind](s["value"])))

    return F.array_distinct(F.concat(*map(of, PATTERNS)))


def disclosing_terms(found: DataFrame, support: int, threshold: float) -> DataFrame:
    """(hash, terms): the words of each text that disclose an entity, whether or not the text holds the entity.

    Over all documents, n(t) hold the word t, n(e) the entity e, n(t, e) both. The word
    discloses the entity if PMI(t, e) = log2(N n(t, e) / (n(t) n(e))) is at least
    ``threshold`` times the information of the entity, log2(N / n(e)), and both occur
    together in at least ``support`` different texts. Entities in fewer texts cannot
    pass, so only the texts of the others are paired with their words.
    """
    texts = found.groupBy("hash").agg(F.any_value("text").alias("text"), F.any_value("entities").alias("entities"), F.count(F.lit(1)).alias("rows"))
    texts = keep(texts.select("hash", "rows", "entities", words_of(F.col("text")).alias("words")), "texts")
    counts = texts.select("rows", F.explode("entities").alias("entity")).groupBy("entity").agg(
        F.sum("rows").alias("n_entity"), F.count(F.lit(1)).alias("n_texts")
    )
    known = keep(counts.where(F.col("n_texts") >= support).select("entity", "n_entity"), "entities")
    worded = texts.select("hash", "rows", F.explode("words").alias("term"))
    total = found.count()
    terms = keep(worded.groupBy("term").agg(F.sum("rows").alias("n_term")), "terms")
    held = keep(texts.select("hash", "rows", "words", F.explode("entities").alias("entity")).join(known, "entity"), "held")
    both = held.select("rows", "entity", "n_entity", F.explode("words").alias("term"))
    pairs = both.groupBy("entity", "term").agg(F.sum("rows").alias("n_both"), F.count(F.lit(1)).alias("n_texts"), F.max("n_entity").alias("n_entity"))
    pairs = pairs.where(F.col("n_texts") >= support)
    pmi = F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    telling = pairs.join(terms, "term").where(pmi >= threshold * F.log2(F.lit(float(total)) / F.col("n_entity"))).select("term").distinct()
    telling = keep(telling, "telling")
    return worded.join(telling, "term").groupBy("hash").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def find(docs: DataFrame, support: int = 3, threshold: float = 0.9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, email, ip, card, phone, term): arrays of the spans in every whole text.

    Spans are struct<start, end, value> in code points, the end exclusive. Terms are the
    words that disclose an entity of any document, see ``disclosing_terms``; they are
    marked in all documents and never inside other spans. A null text counts as empty
    and has no spans. ``text`` is null in rows without spans. Repeated rows and ids stay
    and count as often as they occur, but a text supports a term once. Other columns are
    not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    spans = rows.select("doc_id", "text", *[column.alias(kind) for kind, column in base_spans(F.col("text")).items()])
    found = keep(spans.select("doc_id", *PATTERNS, "text", F.sha2("text", 256).alias("hash"), _entities().alias("entities")), "found")
    terms = keep(disclosing_terms(found, support, threshold), "terms")
    told = found.join(terms, "hash", "left")
    any_of = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    apart = lambda s: ~F.exists(F.concat(*PATTERNS), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    spans_of_terms = F.when(F.size("terms") > 0, F.filter(located(F.col("text"), any_of), apart)).otherwise(F.array().cast(NO_SPANS))
    marked = told.select("doc_id", "text", *PATTERNS, spans_of_terms.alias(TERM))
    return marked.withColumn("text", F.when(F.greatest(*[F.size(kind) for kind in KINDS]) > 0, F.col("text")))


def report(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, and all spans as text."""
    base = {kind: F.col(kind) for kind in PATTERNS}
    return found.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS], F.sha2(_written(base), 256).alias("base_sha256"),
        _written({kind: F.col(kind) for kind in KINDS}).alias("spans"),
    )


def sanitised(found: DataFrame) -> DataFrame:
    """(doc_id, sanitised): each text of ``find`` with personal data as its kind; null where nothing was found.

    A disclosing term is generalised to what kind of word it is where that tells
    nothing (a number, a capitalised word) and removed otherwise. Of overlapping spans
    the first in text order counts, the longer of two that start together.
    """

    def label(kind: str, value: Column) -> Column:
        if kind != TERM:
            return F.lit(f"[{kind.upper()}]")
        return F.when(value.rlike("^[0-9]+$"), "[NUMBER]").when(value.rlike(r"^\p{Lu}"), "[NAME]").otherwise("")

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), label(kind, s["value"]).alias("label")))

    whole = F.col("text")
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct((-s["back"]).alias("at"), F.concat(acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), s["label"]).alias("out")),
    ).otherwise(acc)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.array_sort(F.concat(*map(of, KINDS))), start, step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))))
    return found.select("doc_id", F.when(whole.isNotNull(), done).alias("sanitised"))
