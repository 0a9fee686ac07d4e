"""Tables across datasets: top posts, top authors, network sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadlab.functions.columns import actor_class
from spreadlab.operators.network import Network, mean_closeness, network_size
from spreadlab.operators.posts import flat, originals
from spreadlab.operators.prefix import quantiles
from spreadlab.session import settle


def across(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Union of per-dataset tables with a dataset column."""
    parts = [df.select(F.lit(name).alias("dataset"), "*") for name, df in datasets.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _classed_originals(datasets: Mapping[str, DataFrame]) -> DataFrame:
    rows = across({name: flat(originals(posts)) for name, posts in datasets.items()})
    label = actor_class(F.col("is_usual_suspect"), F.col("party"), strict=True)
    return rows.withColumn("user_type", label).where(F.col("user_type").isNotNull())


def top_posts_by_class(datasets: Mapping[str, DataFrame], n: int = 10) -> DataFrame:
    """The most retweeted originals of each actor class and dataset.

    The rank filter is applied inside each task before rows are exchanged.
    """
    ranked = Window.partitionBy("dataset", "user_type").orderBy(F.desc("retweet_count"), "id")
    rows = _classed_originals(datasets).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)
    return rows.select("dataset", "user_type", "id", "retweet_count", "rank")


def top_authors_by_class(datasets: Mapping[str, DataFrame], above: int = 100, n: int = 10) -> DataFrame:
    """Authors with the most retweets on originals above a number of retweets, per class and dataset."""
    strong = _classed_originals(datasets).where(F.col("retweet_count") > above)
    totals = strong.groupBy("dataset", "user_type", "author_id").agg(F.sum("retweet_count").alias("retweet_count"))
    ranked = Window.partitionBy("dataset", "user_type").orderBy(F.desc("retweet_count"), "author_id")
    return totals.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)


def network_table(networks: Mapping[str, Network]) -> DataFrame:
    """Authors, edges and mean closeness per dataset."""
    return across(
        {
            name: network_size(net).withColumn("closeness", mean_closeness(net).scalar())
            for name, net in networks.items()
        }
    )


def sampled_cascades(top: DataFrame, per_class: int = 10) -> DataFrame:
    """A fixed number of cascades per class: those with the smallest MD5 of dataset and id.

    Every task passes on its smallest of each class only, so what meets for a class is that number of rows a task.
    """
    digest = F.md5(F.concat_ws("\x1f", "dataset", "id").cast("binary"))
    ranked = Window.partitionBy("user_type").orderBy(digest, "dataset", "id")
    return top.withColumn("_at", F.row_number().over(ranked)).where(F.col("_at") <= per_class).drop("_at")


def distribution_summary(
    rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), error: float = 0.001
) -> DataFrame:
    """(keys, share, n, exact, sketched, rank_error): quantiles of each group, exact ones beside those of a sketch.

    The sketch merges across tasks and keeps its ranks within ``error`` of the group's rows; ``rank_error``
    is how far off, as a share of them, its value really is. The exact ones are interpolated. Groups with a
    null key and null values take no part.
    """
    keys = list(keys)
    named = [F.col(k).isNotNull() for k in keys]
    known = rows.where(F.col(value).isNotNull())
    for some in named:
        known = known.where(some)
    counts = settle(known.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")), "values")
    cuts = {f"q{i}": share for i, share in enumerate(shares)}
    at = F.array(*[F.lit(float(s)) for s in shares])

    def listed(column):
        return F.posexplode(column).alias("i", "x")

    exact = quantiles(known, keys, value, cuts)
    exact = exact.select(*keys, listed(F.array(*[F.col(q).cast("double") for q in cuts]))).withColumnRenamed("x", "exact")
    sketch = known.groupBy(*keys).agg(F.percentile_approx(value, list(map(float, shares)), round(1 / error)).alias("s"))
    sketch = sketch.select(*keys, listed("s")).withColumnRenamed("x", "sketched")
    ranks = counts.join(sketch, keys).groupBy(*keys, "i").agg(
        F.first("sketched").alias("sketched"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("v") < F.col("sketched"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("v") <= F.col("sketched"), F.col("n")).otherwise(0)).alias("upto"),
    )
    share = F.get(at, F.col("i"))
    wanted = F.greatest(F.ceil(share * F.col("n")), F.lit(1))
    off = F.greatest(F.lit(0), F.col("below") + 1 - wanted, wanted - F.col("upto")) / F.col("n")
    return ranks.join(exact, [*keys, "i"]).select(*keys, share.alias("share"), "n", "exact", "sketched", off.alias("rank_error"))
