"""The registered queries: one callable (spark, directory) -> DataFrame per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlab import schemas
from spreadlab.functions.columns import hashtag_tokens, hashtags_in_text
from spreadlab.functions.columns import actor_class
from spreadlab.operators import (
    activity,
    actors,
    board,
    cascades,
    classifier,
    emotions,
    encoding,
    evidence,
    growth,
    network,
    pairs,
    profiles,
    reports,
    standing,
)
from spreadlab.operators import posts as post_ops
from spreadlab.plans import demo
from spreadlab.plans.dataset import SocialDataset
from spreadlab.session import prepare, settle
from spreadlab.sources import posts as files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
# An author that exists at every scale, for single-author queries.
AUTHOR = "7"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so engines that add in another order agree."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), 6) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")).alias(f.name)
            for f in df.schema.fields
        ]
    )


def query(make: Callable[[SocialDataset], DataFrame]) -> Callable[[SocialDataset], DataFrame]:
    """Register a query over the demo dataset."""
    _QUERIES[make.__name__] = lambda spark, sf_dir: rounded(make(demo.dataset(spark, sf_dir)))
    return make


def table_query(make: Query) -> Query:
    """Register a query that reads the given tables itself."""
    _QUERIES[make.__name__] = lambda spark, sf_dir: rounded(make(prepare(spark), sf_dir))
    return make


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# -------------------------------------------------------------------- activity


@query
def post_histogram(d):
    return activity.post_histogram(d.posts)


@query
def post_histogram_filtered(d):
    return activity.post_histogram(d.posts, hashtags=["t3", "eclick"], start="2024-01-05", end="2024-01-20")


@query
def author_histogram(d):
    return activity.author_histogram(d.posts)


@query
def histogram_weekly_sunday(d):
    return activity.post_histogram(d.posts, unit="week")


@query
def histogram_three_days(d):
    return activity.post_histogram(d.posts, unit="day", size=3)


@query
def hashtag_counts(d):
    return activity.hashtag_counts(d.posts)


@query
def hashtag_counts_author(d):
    return activity.hashtag_counts(d.posts, author_id=AUTHOR, start="2024-01-03", end="2024-01-27")


@query
def hashtag_weights(d):
    return activity.hashtag_weights(activity.hashtag_counts(d.posts))


@query
def top_hashtags(d):
    return activity.top_hashtags(d.posts)


@query
def top_profiles(d):
    return activity.top_profiles(d.posts, start="2024-01-02", end="2024-01-29")


@table_query
def text_hashtags(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        "doc_id",
        F.array_join(hashtags_in_text(F.col("text")), ",").alias("words"),
        F.array_join(hashtag_tokens(F.col("text")), ",").alias("tokens"),
    )


@query
def dataset_date_range(d):
    return post_ops.date_range(d.posts)


@query
def actor_class_counts(d):
    return post_ops.class_counts(d.posts)


@table_query
def annotate_actors(spark, sf_dir):
    d = demo.dataset(spark, sf_dir)
    marked = actors.annotate_actors(d.posts, demo.suspects(spark, sf_dir), demo.parties(spark, sf_dir))
    return post_ops.flat(marked).groupBy("author_id", "is_usual_suspect", "party").agg(F.count(F.lit(1)).alias("posts"))


@query
def cascade_count_over_time(d):
    return activity.cascade_count_over_time(d.posts)


@query
def cascade_count_weekly(d):
    return activity.cascade_count_over_time(d.posts, "week")


# ----------------------------------------------------------------------- board


@query
def board_(d):
    return d.board.withColumn("hashtags", F.array_join("hashtags", ","))


_QUERIES["board"] = _QUERIES.pop("board_")


@query
def board_page(d):
    order = [{"column_id": "Retweets", "direction": "desc"}, {"column_id": "Legitimacy", "direction": "asc"}]
    return board.select_board(d.board, sort_by=order, skip=20, amount=10)


@query
def board_filtered(d):
    text = "{Retweets} ge 2 && {Text} contains VIEW && {created_at} datestartswith 2024-01-1 && {Profiling} contains yes && {User} != 'u7'"
    return board.select_board(d.board, start="2024-01-02", end="2024-01-18", hashtags=["t3"], query=text)


@query
def board_size(d):
    return board.board_size(d.board, start="2024-01-05", end="2024-01-20")


@query
def board_rendered(d):
    return board.rendered(d.board).select("ID", "User", "Multimodal", "Profiling", "Suspicious content")


@query
def average_emotion(d):
    return emotions.average_emotion(d.text_scores)


@query
def emotion_by_hour(d):
    return emotions.emotion_by_hour(d.text_scores, start="2024-01-01", end="2024-01-29")


# --------------------------------------------------------------------- network


@query
def interactions(d):
    return network.interactions(d.posts)


@query
def interactions_windowed(d):
    return network.interactions(
        d.posts, types=("retweeted", "quoted"), start="2024-01-04", end="2024-01-22", hashtags=["t1", "t2"]
    )


@query
def authors(d):
    return network.authors(d.posts)


@query
def network_edges(d):
    return d.network.edges


@query
def network_vertices(d):
    return d.network.vertices


@query
def network_windowed(d):
    return network.network(d.posts, start="2024-01-10", end="2024-01-11").edges.drop("weight_inv")


@query
def degrees(d):
    return network.degrees(d.network.edges)


@query
def neighbours(d):
    return network.neighbours(d.network, AUTHOR)


@query
def ego_depth1(d):
    return network.ego(d.network, AUTHOR, 1).edges.select("source", "target", "weight")


@query
def ego_depth2(d):
    return network.ego(d.network, AUTHOR, 2).edges.select("source", "target", "weight")


@query
def ego_capped(d):
    return network.ego_for_display(d.network, AUTHOR, 2, max_edges=40).edges.select("source", "target", "weight")


@query
def backbone(d):
    return network.backbone_edges(d.network.edges).select("source", "target", "weight", "alpha")


@query
def backbone_capped(d):
    return network.backbone_edges(d.network.edges, max_edges=100).select("source", "target", "weight", "alpha")


@query
def components(d):
    return network.components(d.network)


@query
def network_size(d):
    return network.network_size(d.network)


@query
def mean_closeness(d):
    return network.mean_closeness(d.network)


@query
def edge_positions(d):
    number = F.col("author_id").cast("bigint")
    layout = d.network.vertices.select(
        "author_id", number.cast("double").alias("x"), (number % 7).alias("y"), (number % 11).alias("z")
    )
    return network.edge_positions(d.network.edges, layout)


# -------------------------------------------------------------------- standing


@query
def legitimacy(d):
    return standing.legitimacy(d.posts)


@query
def legitimacy_over_time(d):
    return standing.legitimacy_over_time(d.posts)


@query
def reputation(d):
    return d.runs.reputation()


@query
def status(d):
    return d.runs.status()


@query
def standing_means(d):
    return d.standing.select("author_id", "legitimacy", "average_reputation", "average_status")


@query
def standing_levels(d):
    return d.standing.select("author_id", "legitimacy_level", "reputation_level", "status_level")


@query
def actor_metadata(d):
    return d.metadata


@query
def standing_crosstab(d):
    return standing.standing_crosstab(d.metadata)


@query
def standing_crosstab_marked(d):
    return standing.standing_crosstab(d.metadata, without_normal=True)


@query
def legitimacy_by_class(d):
    return standing.legitimacy_by_class(d.metadata)


@query
def legitimacy_trimmed(d):
    return standing.legitimacy_by_class(d.metadata, below=1000)


@query
def legitimacy_distribution(d):
    rows = reports.across({"demo": standing.legitimacy_by_class(d.metadata)})
    found = reports.distribution_summary(rows, ["dataset", "user_type"], "legitimacy")
    return found.select("dataset", "user_type", "share", "n", "exact", (F.col("rank_error") <= 0.001).alias("within"))


# -------------------------------------------------------------------- cascades


@query
def cascade_roots(d):
    return d.roots.select("cascade_id", "created_at", "author_id")


@query
def cascade_sizes(d):
    return cascades.cascade_sizes(d.posts)


@query
def size_ccdf(d):
    return cascades.size_ccdf(d.posts)


@query
def size_ccdf_filled(d):
    return cascades.fill_ccdf(d.posts)


@query
def cascade_references(d):
    return d.references


@query
def cascade_nodes(d):
    return d.nodes


@query
def cascade_edges(d):
    return d.tree.edges


@query
def cascade_depths(d):
    return d.positions.select("cascade_id", "post_id", "depth")


@query
def cascade_curves(d):
    return d.curves


def tangled_query(make: Callable[[SocialDataset], DataFrame]) -> Callable[[SocialDataset], DataFrame]:
    """Register a query over the demo dataset in which replies may hang on two posts."""
    _QUERIES[make.__name__] = lambda spark, sf_dir: rounded(make(demo.dataset(spark, sf_dir, second=True)))
    return make


@tangled_query
def tangled_nodes(d):
    return d.nodes.select("cascade_id", "post_id", "author_id", "type")


@tangled_query
def tangled_edges(d):
    return d.tree.edges


@tangled_query
def tangled_depths(d):
    return d.positions.select("cascade_id", "post_id", "depth")


@tangled_query
def tangled_curves(d):
    return d.curves


@query
def cascade_node_count(d):
    return cascades.node_counts(d.nodes)


@query
def cascade_lookup(d):
    return d.curves.where(F.col("cascade_id") == "100")


@query
def top_cascades(d):
    return cascades.top_cascades(d.posts, 20)


@query
def top_posts_by_class(d):
    return reports.top_posts_by_class({"demo": d.posts})


@query
def top_authors_by_class(d):
    return reports.top_authors_by_class({"demo": d.posts}, above=2)


def conversation_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a post that replies to the turn before."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")

    def name(turn):
        return F.concat(F.col("conv_id"), F.lit("-"), turn)

    def moment(turn):
        return F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + turn * 60_000_000)

    before = F.col("turn") - 1
    reply = F.struct(
        name(before).alias("id"),
        F.lit("replied_to").alias("type"),
        F.lit(None).cast("string").alias("text"),
        moment(before).alias("created_at"),
        F.struct(name(before).alias("id"), name(before).alias("username")).alias("author"),
    )
    rows = turns.select(
        name(F.col("turn")).alias("id"),
        "text",
        moment(F.col("turn")).alias("created_at"),
        F.struct(
            name(F.col("turn")).alias("id"),
            name(F.col("turn")).alias("username"),
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("string").alias("description"),
            F.lit(None).cast(schemas.ACTOR_FLAGS).alias("actor"),
        ).alias("author"),
        F.when(F.col("turn") > 0, F.array(reply)).alias("referenced_tweets"),
    )
    return files.as_posts(rows)


@table_query
def conversation_curves(spark, sf_dir):
    return SocialDataset(conversation_posts(spark, sf_dir)).curves


# -------------------------------------------------------------------- profiles


def _grouped(d: SocialDataset) -> DataFrame:
    group = (
        F.when(F.col("gender_demo") == "female", "fake_spreaders")
        .when(F.col("gender_demo") == "organization", "fact_checkers")
        .otherwise("control")
    )
    return d.profiles.withColumn("group", group)


@query
def profile_cards(d):
    return profiles.profile_cards(d.profiles)


@query
def group_medians(d):
    return profiles.group_medians(_grouped(d), "group", demo.PROFILE_FEATURES)


@query
def profile_comparison(d):
    catalogue = d.posts.sparkSession.createDataFrame(
        [
            ("interacciones", "followers_count", "followers", 0),
            ("interacciones", "friends_count", "followed", 1),
            ("interacciones", "listed_count", "lists", 2),
            ("interacciones", "favorites_count", "favourites", 3),
        ],
        "category string, feature_name string, display_name string, rank int",
    )
    medians = profiles.group_medians(_grouped(d), "group", demo.PROFILE_FEATURES)
    return profiles.profile_comparison(d.profiles, catalogue, medians, "interacciones")


@query
def group_share(d):
    return profiles.group_share(_grouped(d), "age_demo", "group")


@query
def behaviour_features(d):
    name = "median_time_betweet_tweets_behav"
    return profiles.behaviour_features(d.posts).withColumn(name, F.round(name, 3))


@query
def social_features(d):
    return profiles.social_features(d.posts)


@table_query
def lexicon_scores(spark, sf_dir):
    rules = [
        ("the", False, "article"),
        ("un", True, "article"),
        ("la", False, "article"),
        ("th", True, "th"),
        ("the", True, "th"),
        ("and", False, "link"),
        ("und", False, "link"),
        ("qu", True, "link"),
        ("nicht", False, "negation"),
    ]
    lexicon = spark.createDataFrame(rules, "word string, is_prefix boolean, category string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("user_id"), "text")
    return profiles.lexicon_scores(docs, lexicon)


# -------------------------------------------------------------------- evidence


@query
def fact_check_view(d):
    return evidence.fact_check_view(d.fact_checks)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(f"images/{n}.png") for n in demo.IMAGE_NAMES])
    return _turns(spark, sf_dir).select(
        F.col("conv_id").alias("id_in_json"),
        F.slice(names, F.lit(1), (F.col("conv_id") % 6 + 1).cast("int")).alias("image_paths"),
        F.struct((F.col("conv_id") + 1000).alias("tweet_id"), F.lit("REAL").alias("predicted_label")).alias("results"),
    )


@table_query
def fact_check_ingest(spark, sf_dir):
    accepted, _ = evidence.ingest_fact_checks(_claims(spark, sf_dir), demo.images(spark, sf_dir))
    return accepted.select("id_in_json", "dataset", "tweet_id")


@table_query
def fact_check_rejected(spark, sf_dir):
    _, rejected = evidence.ingest_fact_checks(_claims(spark, sf_dir), demo.images(spark, sf_dir))
    return rejected.select(
        "id_in_json",
        F.array_join(F.array_sort("missing"), ",").alias("missing"),
        F.array_join(F.array_sort("unexpected"), ",").alias("unexpected"),
    )


@table_query
def fact_check_missing_images(spark, sf_dir):
    checks = _turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("tweet_id"))
    return evidence.missing_images(checks, demo.images(spark, sf_dir))


@table_query
def fact_check_validation(spark, sf_dir):
    even, third = F.col("n") % 2 == 0, F.col("n") % 3 == 0
    blank = F.lit("")
    full = [f for f in evidence.EXPECTED_RESULTS if f != "explanations"]
    results = F.when(third, F.to_json(F.struct(*[blank.alias(f) for f in full]))).otherwise(
        F.to_json(F.struct(*[blank.alias(f) for f in evidence.EXPECTED_RESULTS]))
    )
    common = [f for f in evidence.EXPECTED_FIELDS if f not in ("results", "evidence_text")]
    head = F.when(even, F.to_json(F.struct(*[blank.alias(f) for f in [*common, "evidence_text"]]))).otherwise(
        F.to_json(F.struct(*[blank.alias(f) for f in [*common, "extra"]]))
    )
    json = F.concat(F.rtrim(head, F.lit("}")), F.lit(', "results": '), results, F.lit("}"))
    records = _turns(spark, sf_dir).select(
        F.lit("openarms").alias("dataset"), F.col("conv_id").cast("string").alias("id"), json.alias("json")
    )
    report = evidence.validate_fact_checks(records, demo.images(spark, sf_dir))
    return report.select(
        "id", "part", F.array_join("unexpected", ",").alias("unexpected"), F.array_join("missing", ",").alias("missing")
    )


# ---------------------------------------------------------------- classification


def _eligible(d: SocialDataset) -> DataFrame:
    return pairs.eligible_cascades(d.posts, d.profiles, d.text_scores)


def _positives(d: SocialDataset) -> DataFrame:
    return pairs.positive_pairs(_eligible(d), d.nodes, d.tree.edges)


def _users(d: SocialDataset) -> DataFrame:
    return pairs.user_features(d.posts, d.profiles, d.standing)


def _labelled(d: SocialDataset, with_keys: bool = False) -> DataFrame:
    positives = settle(_positives(d), "positives")
    negatives = pairs.negative_pairs(positives, d.network.edges)
    return pairs.propagation_dataset(
        positives, negatives, pairs.post_features(d.posts, d.text_scores), _users(d), with_keys
    )


@query
def eligible_cascades(d):
    return _eligible(d)


@query
def positive_pairs(d):
    return _positives(d)


@query
def negative_pairs(d):
    return pairs.negative_pairs(settle(_positives(d), "positives"), d.network.edges)


@query
def pair_features(d):
    rows = pairs.pair_features(_positives(d), pairs.post_features(d.posts, d.text_scores), _users(d))
    users = [c for c in rows.columns if c.endswith(tuple(pairs.ROLES.values()))]
    return rows.select("source", "target", "cascade_id", "original_author", "num_retweets", "Miedo", *users)


@query
def propagation_dataset(d):
    return _labelled(d)


@query
def train_test_split(d):
    keys = ["source", "target", "cascade_id", "original_author"]
    parts = classifier.hash_split(_labelled(d, with_keys=True), keys=keys)
    named = [part.select(*keys, F.lit(name).alias("part")) for part, name in zip(parts, ("train", "test"))]
    return named[0].unionByName(named[1])


@query
def sampled_cascades(d):
    heads = post_ops.flat(post_ops.originals(d.posts))
    kind = actor_class(F.col("is_usual_suspect"), F.col("party"))
    return reports.sampled_cascades(heads.select(F.lit("demo").alias("dataset"), kind.alias("user_type"), "id", "created_at"))


def _by_rule(d: SocialDataset) -> DataFrame:
    """Labelled rows with the prediction of a rule, so that the scores can be checked by SQL."""
    return _labelled(d).withColumn("prediction", (F.coalesce("num_retweets", F.lit(0)) % 2).cast("int"))


@query
def rule_confusion_matrix(d):
    return classifier.confusion_matrix(_by_rule(d))


@query
def rule_metrics(d):
    return classifier.classification_metrics(_by_rule(d))


@query
def feature_modes(d):
    rows = _labelled(d).select("num_retweets", "propagated", "Miedo")
    best = classifier.modes(rows, rows.columns)
    return d.posts.sparkSession.createDataFrame([(k, float(v)) for k, v in best.items()], "feature string, value double")


PAIR_KEYS = ["source", "target", "cascade_id", "original_author"]


def _training(d: SocialDataset) -> DataFrame:
    """Labelled rows as the registered queries show them, to six decimals."""
    return settle(rounded(_labelled(d, with_keys=True)), "labelled")


def _features(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (*PAIR_KEYS, "propagated")]


def _fitted(rows: DataFrame) -> classifier.PropagationModel:
    return classifier.PropagationModel().fit(rows, _features(rows))


@query
def encoded_features(d):
    rows = _training(d)
    names = _features(rows)
    coded = encoding.Encoder().fit(rows, names).fit_scales(rows).encoded(rows, PAIR_KEYS)
    texts = F.filter("features", lambda e: e["feature"].rlike("[=#]"))
    return coded.select(
        *PAIR_KEYS,
        F.array_join(F.transform(texts, lambda e: e["feature"]), ",").alias("categories"),
        F.size("features").cast("long").alias("n_features"),
        F.aggregate("features", F.lit(0.0), lambda total, e: total + e["value"]).alias("total"),
    )


@query
def propagation_model_metrics(d):
    _, report = classifier.performance(_training(d), keys=PAIR_KEYS)
    return report


@query
def confusion_matrix(d):
    rows = _training(d)
    return classifier.confusion_matrix(_fitted(rows).predict(rows))


@query
def feature_importances(d):
    best = _fitted(_training(d)).importances(20)
    return d.posts.sparkSession.createDataFrame(best, "feature string, importance double")


def _largest_eligible(d: SocialDataset) -> DataFrame:
    """The eligible cascade with the most posts, of equals the first."""
    sizes = d.nodes.groupBy("cascade_id").count()
    return _eligible(d).distinct().join(sizes, "cascade_id").orderBy(F.desc("count"), "cascade_id").limit(1).select("cascade_id", "original_author")


@query
def grow_cascade(d):
    cascade = settle(_largest_eligible(d), "cascade")
    model = _fitted(_training(d))
    by_post = pairs.post_features(d.posts, d.text_scores)
    return growth.grow_cascades(cascade, d.nodes, d.network.edges, model, by_post, _users(d))


@query
def grow_cascade_by_rule(d):
    follows = F.coalesce("friends_count_prev", F.lit(0)) <= F.coalesce("friends_count_curr", F.lit(0))
    by_post = pairs.post_features(d.posts, d.text_scores)
    grown = growth.grow_cascades(settle(_largest_eligible(d), "cascade"), d.nodes, d.network.edges, follows, by_post, _users(d))
    return grown.select("cascade_id", "author_id", "ground_truth")


# ---------------------------------------------------------------------- sources


@query
def cast_times(d):
    back = files.cast_times(files.encode_times(d.posts))
    each = back.select("id", "created_at", F.explode_outer("referenced_tweets").alias("ref"))
    return each.select("id", "created_at", F.col("ref.created_at").alias("ref_created_at"))


@query
def flatten_pages(d):
    user = F.struct("author.id", "author.username", "author.name")
    ref = F.try_element_at("referenced_tweets", F.lit(1))
    pages = d.posts.select(
        F.array(
            F.struct(
                "id",
                "text",
                "created_at",
                F.col("author.id").alias("author_id"),
                F.transform("referenced_tweets", lambda r: F.struct(r["id"].alias("id"), r["type"].alias("type"))).alias(
                    "referenced_tweets"
                ),
            )
        ).alias("data"),
        F.struct(
            F.array(
                user, F.struct(ref["author"]["id"].alias("id"), ref["author"]["username"].alias("username"), F.lit(None).cast("string").alias("name"))
            ).alias("users"),
            F.transform(
                "referenced_tweets",
                lambda r: F.struct(
                    r["id"].alias("id"),
                    r["text"].alias("text"),
                    r["created_at"].alias("created_at"),
                    r["author"]["id"].alias("author_id"),
                ),
            ).alias("tweets"),
        ).alias("includes"),
    )
    flat = files.flatten_pages(pages)
    each = flat.select("id", F.col("author.username").alias("username"), F.explode_outer("referenced_tweets").alias("ref"))
    return each.select(
        "id",
        "username",
        F.col("ref.id").alias("ref_id"),
        F.col("ref.author.username").alias("ref_username"),
        F.col("ref.created_at").alias("ref_created_at"),
    )


@query
def ingest_outputs(d):
    digit = F.element_at("entities.hashtags", 1)["tag"]
    media = F.struct(F.array(F.struct(F.concat(F.lit("m"), "id").alias("media_key"))).alias("media"))
    number = F.substring(digit, 2, 1).cast("int")
    withmedia = d.posts.withColumn("attachments", F.when(number % 2 == 0, media))
    parts = [rows.select(F.lit(name).alias("output"), "id") for name, rows in files.ingest_outputs(withmedia).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def sample_per_period(d):
    return activity.sample_per_period(d.posts, "day", 10).select("period", "id")


@query
def board_by_retweets(d):
    ranked = board.by_retweets(d.board)
    return ranked.select("ID", "Retweets", "Legitimacy").limit(50)
