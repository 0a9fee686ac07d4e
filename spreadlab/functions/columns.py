"""Column expressions: actor classes, time bins, hashtags, handles and rendering."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four actor classes under their two sets of labels, in the
# order Normal, suspect, politician, both.
CLASSES = ("Normal", "Suspect", "Politician", "Suspect politician")
SERIES = ("Normal", "Usual suspect", "Politician", "Usual suspect politician")
LEVELS = ("Null", "Low", "Medium", "High")


def actor_class(suspect: Column, party: Column, labels=CLASSES, strict: bool = False) -> Column:
    """Four-way class of an author.

    ``strict`` leaves rows whose suspect flag is missing without a class, as the
    activity histograms do; otherwise a missing flag counts as false.
    """
    normal, flagged, politician, both = labels
    flag = suspect if strict else F.coalesce(suspect, F.lit(False))
    return (
        F.when(flag & party.isNotNull(), both)
        .when(flag, flagged)
        .when(~flag & party.isNotNull(), politician)
        .when(~flag, normal)
    )


def time_bin(moment: Column, unit: str = "day", size: int = 1) -> Column:
    """Start of the calendar bin that holds ``moment``.

    Weeks start on Sunday. Bins of several units are counted from 2000-01-01
    (for weeks, from the Sunday after it).
    """
    day = F.to_date(moment)
    if unit == "day":
        n = F.floor(F.datediff(day, F.lit("2000-01-01").cast("date")) / size) * size
        start = F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int"))
    elif unit == "week":
        n = F.floor(F.datediff(day, F.lit("2000-01-02").cast("date")) / (7 * size)) * (7 * size)
        start = F.date_add(F.lit("2000-01-02").cast("date"), n.cast("int"))
    elif unit in ("month", "year"):
        width = size if unit == "month" else 12 * size
        months = (F.year(day) - 2000) * 12 + F.month(day) - 1
        start = F.add_months(F.lit("2000-01-01").cast("date"), (F.floor(months / width) * width).cast("int"))
    else:
        raise ValueError(f"unknown time unit {unit!r}")
    return start.cast("timestamp")


def week_ending_sunday(day: Column) -> Column:
    """The Sunday that closes the Monday-to-Sunday week of ``day``."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def hashtags_in_text(text: Column) -> Column:
    """Tags written as ``#word`` in any script; null when there are none."""
    # The pattern is a fixed value; (?U) gives \w its Unicode meaning.
    tags = F.regexp_extract_all(text, F.lit(r"(?U)#(\w+)"), F.lit(1))
    return F.when(F.size(tags) > 0, tags)


def hashtag_tokens(text: Column) -> Column:
    """Whitespace-separated tokens that start with ``#``, without it; null when none."""
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t.startswith("#"))
    tags = F.transform(tokens, lambda t: t.substr(F.lit(2), F.length(t)))
    return F.when(F.size(tags) > 0, tags)


def pseudonym(name: Column) -> Column:
    """First eight hex digits of the md5 of a name."""
    return F.substring(F.md5(name), 1, 8)


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def rounded(value: Column, digits: int = 2) -> Column:
    return F.round(value.cast("double"), digits)


def handle_of(link: Column) -> Column:
    """Last path segment of a profile link, without its query string."""
    return F.substring_index(F.substring_index(link, "/", -1), "?", 1)


def translated(value: Column, names: dict[str, str]) -> Column:
    """Replace values found in a small fixed dictionary, keep the others."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(F.element_at(table, value), value)


def wrapped(text: Column, width: int = 60) -> Column:
    """Insert ``<br>`` after every ``width`` characters that have a successor."""
    return F.regexp_replace(text, f"(?s)(.{{{width}}})(?=.)", "$1<br>")


def parsed_list(text: Column) -> Column:
    """Read a list printed as ``['a', 'b']``."""
    return F.from_json(F.regexp_replace(text, "'", '"'), "array<string>")


def level_rank(level: Column) -> Column:
    """Sort key of a level: Null 0, Low 1, Medium 2, High 3, anything else null."""
    rank = F.lit(None).cast("int")
    for number, name in enumerate(LEVELS):
        rank = F.when(level == name, number).otherwise(rank)
    return rank


# Numbers that stand for levels where they are drawn as sizes and colours.
LEVEL_SIZES = {"Null": 0.5, "Low": 1.0, "Medium": 2.0, "High": 3.0, "Unknown": 0.5}
LEVEL_COLOURS = {"Null": 0.5, "Low": 1.0, "Medium": 2.0, "High": 3.0, "Unknown": float("nan")}


def level_code(level: Column, codes: dict[str, float]) -> Column:
    """Number of a level; a missing level counts as 'Unknown'."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(codes.items())])
    return F.element_at(table, F.coalesce(level, F.lit("Unknown")))


def level_summary(legitimacy: Column, reputation: Column, status: Column) -> Column:
    """One line per standing level, blank when the level is unknown."""
    parts = [("Legitimacy", legitimacy), ("Reputation", reputation), ("Status", status)]
    return F.concat_ws("<br>", *[F.concat(F.lit(f"{n}: "), F.coalesce(c, F.lit(""))) for n, c in parts])
