"""Author standing: legitimacy, reputation, status and their levels.

Reputation changes only in periods in which an author is referenced, so it is
kept as runs: (author, first period, length, value). The rank of a value in a
period comes from how many authors hold each value, a table with one row per
period and distinct value; distinct values are few because they sum up to at
most the number of references. No task ever ranks all authors of a period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.functions.columns import CLASSES, actor_class, time_bin
from spreadlab.operators.posts import flat, one, references
from spreadlab.operators.prefix import quantiles
from spreadlab.session import settle

METRICS = ("legitimacy", "average_reputation", "average_status")


def _roster(posts: DataFrame) -> DataFrame:
    return posts.select(F.col("author.id").alias("author_id")).where(F.col("author_id").isNotNull()).distinct()


def legitimacy(posts: DataFrame) -> DataFrame:
    """References received by every posting author, zero when none."""
    received = references(posts, ["ref_author_id"]).groupBy(F.col("ref_author_id").alias("author_id")).agg(
        F.count(F.lit(1)).alias("received")
    )
    return _roster(posts).join(received, "author_id", "left").select(
        "author_id", F.coalesce("received", F.lit(0)).alias("legitimacy")
    )


def legitimacy_over_time(posts: DataFrame, unit: str = "day", size: int = 1) -> DataFrame:
    """References received per author and period of the referencing post."""
    return references(posts, ["ref_author_id"]).groupBy(
        F.col("ref_author_id").alias("author_id"), time_bin(F.col("created_at"), unit, size).alias("period")
    ).agg(F.count(F.lit(1)).alias("legitimacy"))


class Runs:
    """Reputation of all posting authors as runs of constant value over the periods."""

    def __init__(self, posts: DataFrame, unit: str = "day", size: int = 1):
        received = settle(legitimacy_over_time(posts, unit, size), "received")
        # One entry per period of the dataset: bounded by its length in time.
        self.periods = received.agg(F.array_sort(F.collect_set("period"))).first()[0]
        if not self.periods:
            raise ValueError("no references: standing over time is undefined")
        roster = settle(_roster(posts), "roster")
        calendar = F.array(*[F.lit(p) for p in self.periods])
        self.calendar = calendar
        known = received.join(roster, "author_id", "left_semi").select(
            "author_id", F.array_position(calendar, F.col("period")).cast("int").alias("at"), "legitimacy"
        )
        opening = roster.select("author_id", F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("legitimacy"))
        # An author has at most one row per period, so this window stays small.
        ordered = Window.partitionBy("author_id").orderBy("at")
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        end = F.coalesce(F.lead("at").over(ordered), F.lit(len(self.periods) + 1))
        runs = known.unionByName(opening).select(
            "author_id",
            F.greatest("at", F.lit(1)).alias("first"),
            (end - F.greatest("at", F.lit(1))).alias("length"),
            F.sum("legitimacy").over(upto).alias("reputation"),
        )
        self.runs = settle(runs.where(F.col("length") > 0), "runs")
        self.authors = roster.count()

    def _with_status(self) -> DataFrame:
        """Runs with the array of statuses over the run's periods."""
        earned = self.runs.where(F.col("reputation") > 0)
        shifts = earned.select("reputation", F.col("first").alias("at"), F.lit(1).alias("d")).unionByName(
            earned.select("reputation", (F.col("first") + F.col("length")).alias("at"), F.lit(-1).alias("d"))
        )
        shifts = shifts.groupBy("reputation", "at").agg(F.sum("d").alias("d"))
        by_value = Window.partitionBy("reputation").orderBy("at")
        held = shifts.select(
            "reputation",
            "at",
            F.sum("d").over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("n"),
            F.coalesce(F.lead("at").over(by_value), F.lit(len(self.periods) + 1)).alias("until"),
        ).where((F.col("n") > 0) & (F.col("at") < F.col("until")))
        held = held.select("reputation", "n", F.explode(F.sequence("at", F.col("until") - 1)).alias("at"))
        in_period = Window.partitionBy("at")
        below = in_period.orderBy("reputation").rowsBetween(Window.unboundedPreceding, -1)
        unreferenced = F.lit(self.authors) - F.sum("n").over(in_period)
        ranks = held.select(
            "reputation", "at", (unreferenced + F.coalesce(F.sum("n").over(below), F.lit(0))).alias("status")
        )
        # At most one entry per period in each list. Gaps are filled, so that a run is a slice of its list.
        lists = ranks.groupBy("reputation").agg(F.array_sort(F.collect_list(F.struct("at", "status"))).alias("entries"))
        last = F.size("entries") - 1
        gap = lambda e, i: F.when(i < last, F.get("entries", F.least(i + 1, last))["at"] - e["at"] - 1).otherwise(0)
        filled = F.transform(
            "entries", lambda e, i: F.concat(F.array(e["status"]), F.array_repeat(F.lit(None).cast("bigint"), gap(e, i)))
        )
        lists = lists.select("reputation", F.get("entries", F.lit(0))["at"].alias("from"), F.flatten(filled).alias("by_period"))
        ranked = earned.join(lists, "reputation").select(
            "author_id",
            "first",
            "length",
            "reputation",
            F.slice("by_period", F.col("first") - F.col("from") + 1, F.col("length")).alias("statuses"),
        )
        # Nobody ranks below an author without references.
        blank = self.runs.where(F.col("reputation") == 0).withColumn(
            "statuses", F.array_repeat(F.lit(0).cast("bigint"), F.col("length"))
        )
        return ranked.unionByName(blank.select(ranked.columns))

    def reputation(self) -> DataFrame:
        """Running references received per author and period, without gaps."""
        return self.runs.select(
            "author_id",
            F.explode(F.slice(self.calendar, F.col("first"), F.col("length"))).alias("period"),
            "reputation",
        )

    def status(self) -> DataFrame:
        """Number of authors with a lower reputation, per author and period."""
        spread = self._with_status().select("author_id", "first", F.posexplode("statuses").alias("step", "status"))
        return spread.select(
            "author_id", F.element_at(self.calendar, F.col("first") + F.col("step")).alias("period"), "status"
        )

    def means(self) -> DataFrame:
        """Legitimacy and mean reputation and status over the periods, computed on runs.

        The last reputation of an author is all they received, their legitimacy.
        """
        total = F.aggregate("statuses", F.lit(0).cast("bigint"), lambda acc, s: acc + s)
        return (
            self._with_status()
            .groupBy("author_id")
            .agg(
                F.max("reputation").alias("legitimacy"),
                (F.sum(F.col("reputation") * F.col("length")) / len(self.periods)).alias("average_reputation"),
                (F.sum(total) / len(self.periods)).alias("average_status"),
            )
        )


def reputation(posts: DataFrame, unit: str = "day", size: int = 1) -> DataFrame:
    return Runs(posts, unit, size).reputation()


def status(posts: DataFrame, unit: str = "day", size: int = 1) -> DataFrame:
    return Runs(posts, unit, size).status()


def standing_means(posts: DataFrame, unit: str = "day", size: int = 1) -> DataFrame:
    """Legitimacy with the mean reputation and mean status of every posting author."""
    return Runs(posts, unit, size).means()


def add_levels(values: DataFrame, metrics=METRICS, suffix: str = "_level") -> DataFrame:
    """Low / Medium / High thirds of each column, and Null for zero or missing values.

    A value on a third's edge that falls on an observation goes to the upper
    third. With repeated edges there are only two levels, or one.
    """
    long = values.unpivot([], list(metrics), "metric", "value").select(
        "metric", F.when(F.col("value") != 0, F.col("value").cast("double")).alias("value")
    )
    cuts = {"e0": 0.0, "e1": 1 / 3 - 1e-12, "e2": 2 / 3 - 2e-12, "e3": 1.0}
    edges = {r["metric"]: r for r in quantiles(long, ["metric"], "value", cuts).collect()}  # a row per metric
    out = values
    for metric in metrics:
        value = F.when(F.col(metric) != 0, F.col(metric).cast("double"))
        if metric not in edges:
            level = F.lit("Null")
        else:
            bounds = sorted({edges[metric][e] for e in cuts})
            names = {4: ("Low", "Medium", "High"), 3: ("Low", "High")}.get(len(bounds), ("Low",))
            level = F.when(value.isNull(), "Null")
            for bound, name in zip(bounds[1:-1], names):
                level = level.when(value <= bound, name)
            level = level.otherwise(names[-1])
        out = out.withColumn(metric.replace("average_", "") + suffix, level)
    return out


def standing(posts: DataFrame, unit: str = "day", size: int = 1) -> DataFrame:
    """Scores and levels of every posting author."""
    return add_levels(settle(standing_means(posts, unit, size), "standing"))


def standing_view(posts: DataFrame, unit: str = "day", size: int = 1) -> DataFrame:
    """Reputation and status per author as maps from period to value."""
    runs = Runs(posts, unit, size)
    spread = runs._with_status()
    dates = F.transform(
        F.slice(runs.calendar, F.col("first"), F.col("length")), lambda p: F.date_format(p, "yyyy-MM-dd HH:mm:ss")
    )
    pairs = spread.select("author_id", F.arrays_zip(dates.alias("d"), F.col("statuses")).alias("z"), "reputation")
    # Each author has one entry per period.
    return pairs.groupBy("author_id").agg(
        F.map_from_entries(
            F.flatten(F.collect_list(F.transform("z", lambda e: F.struct(e["d"], e["statuses"]))))
        ).alias("status"),
        F.map_from_entries(
            F.flatten(
                F.collect_list(F.transform("z", lambda e: F.struct(e["d"], F.col("reputation").cast("double"))))
            )
        ).alias("reputation"),
    )


def actor_metadata(posts: DataFrame, scores: DataFrame) -> DataFrame:
    """Name, flags and class of every author with the scores and levels they have."""
    rows = flat(posts).where(F.col("author_id").isNotNull())
    people = rows.groupBy("author_id").agg(
        F.min("username").alias("username"),
        F.coalesce(F.bool_or("is_usual_suspect"), F.lit(False)).alias("is_usual_suspect"),
        F.min("party").alias("party"),
    )
    return people.join(scores, "author_id", "left").withColumn(
        "user_type", actor_class(F.col("is_usual_suspect"), F.col("party"))
    )


def metadata_for(chosen: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata of listed authors; those without any are 'Normal' if the list names them, else 'Unknown'."""
    joined = chosen.select("author_id", F.col("username").alias("given_name")).join(metadata, "author_id", "left")
    patched = F.when(F.col("given_name").isNotNull(), "Normal").otherwise("Unknown")
    return joined.withColumn("user_type", F.coalesce("user_type", patched)).withColumn(
        "username", F.coalesce("username", "given_name")
    ).drop("given_name")


def legitimacy_by_class(metadata: DataFrame, below: float | None = None) -> DataFrame:
    """Legitimacy and class of every author, optionally only below a cut-off."""
    rows = metadata.select("author_id", "user_type", "legitimacy")
    return rows if below is None else rows.where(F.col("legitimacy") < below)


def standing_crosstab(metadata: DataFrame, without_normal: bool = False) -> DataFrame:
    """Authors per class and combination of levels."""
    rows = metadata.where(F.col("user_type") != CLASSES[0]) if without_normal else metadata
    return rows.groupBy("user_type", "legitimacy_level", "reputation_level", "status_level").agg(
        F.count(F.lit(1)).alias("authors")
    )


def legitimacy_of(scores: DataFrame, author_id: str):
    return one(scores, "author_id", author_id, "standing of author")["legitimacy"]


def reputation_of(over_time: DataFrame, author_id: str) -> DataFrame:
    """Reputation series of one author; an error when the author has none."""
    one(over_time, "author_id", author_id, "reputation of author")
    return over_time.where(F.col("author_id") == author_id).orderBy("period")


def status_of(over_time: DataFrame, author_id: str) -> DataFrame:
    one(over_time, "author_id", author_id, "status of author")
    return over_time.where(F.col("author_id") == author_id).orderBy("period")
