"""Time the headline queries and print one JSON line.

The posts table is built once and reported as ``build_posts``; every query then
starts from that stored table with nothing else computed, and all its rows are
produced. One pass over the smallest tables comes first, so that compiling the
JVM's code belongs to no query.
"""

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from spreadlab.operators import activity, cascades, network, profiles, standing  # noqa: E402
from spreadlab.plans import catalogue, demo  # noqa: E402
from spreadlab.plans.dataset import SocialDataset  # noqa: E402
from spreadlab.session import local_session  # noqa: E402

HEADLINES = {
    "post_histogram": lambda d: activity.post_histogram(d.posts),
    "author_histogram": lambda d: activity.author_histogram(d.posts),
    "hashtag_counts": lambda d: activity.hashtag_counts(d.posts),
    "cascade_count_over_time": lambda d: activity.cascade_count_over_time(d.posts),
    "network": lambda d: d.network.edges,
    "backbone": lambda d: network.backbone_edges(network.network(d.posts).edges),
    "components": lambda d: network.components(d.network),
    "standing": lambda d: d.standing,
    "reputation": lambda d: standing.reputation(d.posts),
    "status": lambda d: standing.status(d.posts),
    "size_ccdf": lambda d: cascades.size_ccdf(d.posts),
    "cascade_closure": lambda d: d.references,
    "cascade_tree": lambda d: d.tree.edges,
    "cascade_curves": lambda d: d.curves,
    "board": lambda d: d.board,
    "behaviour_features": lambda d: profiles.behaviour_features(d.posts),
}
TABLE_QUERIES = ("text_hashtags", "lexicon_scores")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def measure(spark, sf_dir: str) -> dict[str, float]:
    began = time.time()
    shared = demo.dataset(spark, sf_dir)
    for table in (shared.posts, shared.text_scores, shared.profiles, shared.fact_checks):
        table.count()
    seconds = {"build_posts": round(time.time() - began, 3)}
    for name, make in HEADLINES.items():
        d = SocialDataset(shared.posts, shared.text_scores, shared.profiles, shared.fact_checks)
        began = time.time()
        run(make(d))
        seconds[name] = round(time.time() - began, 3)
    for name in TABLE_QUERIES:
        began = time.time()
        run(catalogue.queries()[name](spark, sf_dir))
        seconds[name] = round(time.time() - began, 3)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, partitions=int(cores), memory="12g")
    small = pathlib.Path(sf_dir).parent / "sf0.001"
    if small.is_dir():
        measure(spark, str(small))
    seconds = measure(spark, sf_dir)
    total = round(sum(seconds.values()), 3)
    scale = pathlib.Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
