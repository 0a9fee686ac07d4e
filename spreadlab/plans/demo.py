"""A dataset of posts derived from the generic ``events`` and companion tables.

Every event is a post; clicks, purchases and sign-ups refer back to the event
``k + 1`` places earlier. ``sql_views`` states the same mapping for a plain SQL
engine, so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab import schemas
from spreadlab.plans.dataset import SocialDataset
from spreadlab.session import prepare

_DATASETS: dict[tuple[str, str, bool], SocialDataset] = {}

# Image names a fact check needs, also used to name the demo images.
IMAGE_NAMES = (
    "claim_image",
    "evidence_image",
    "graph_claim",
    "graph_evidence_text",
    "graph_evidence_vis",
    "evidence_image1",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """The posts; with ``second``, a third of the replies refer to another post as well."""
    events = _table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    kind = (
        F.when(F.col("event_type") == "click", "retweeted")
        .when(F.col("event_type") == "purchase", "quoted")
        .when(F.col("event_type") == "signup", "replied_to")
    )
    rows = events.withColumn("kind", kind).withColumn(
        "parent", F.when(F.col("kind").isNotNull(), F.col("event_id") - 1 - F.col("k"))
    )
    user = F.col("user_id").cast("string")
    parents = events.select(
        F.col("event_id").alias("parent"),
        F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.lit(None).cast("string").alias("type"),
            _text().alias("text"),
            F.col("ts").alias("created_at"),
            F.struct(user.alias("id"), F.concat(F.lit("u"), user).alias("username")).alias("author"),
        ).alias("ref"),
    )
    received = rows.groupBy(F.col("parent").alias("event_id")).agg(
        F.count_if(F.col("kind") == "retweeted").alias("retweets"),
        F.count_if(F.col("kind") == "quoted").alias("quotes"),
        F.count_if(F.col("kind") == "replied_to").alias("replies"),
        F.count(F.lit(1)).alias("n"),
    )
    joined = rows.join(parents, "parent", "left").join(received, "event_id", "left")
    found = F.array(F.col("ref").withField("type", F.col("kind")))
    if second:
        other = F.when((F.col("kind") == "replied_to") & (F.col("k") % 3 == 0), F.col("event_id") - 1 - (F.col("k") * 7 + 11) % 100)
        joined = joined.withColumn("other", F.when(other != F.col("parent"), other))
        joined = joined.join(parents.withColumnsRenamed({"parent": "other", "ref": "other_ref"}), "other", "left")
        quoted = F.array(F.col("other_ref").withField("type", F.lit("quoted")))
        found = F.when(F.col("other_ref").isNull(), found).otherwise(F.concat(found, quoted))
    refs = F.when(F.col("ref").isNotNull(), found).when(
        F.col("kind").isNotNull(), F.array().cast(schemas.POST["referenced_tweets"].dataType)
    )
    tags = F.array(
        F.struct(F.concat(F.lit("t"), F.col("k") % 10).alias("tag")),
        F.struct(F.concat(F.lit("e"), F.col("event_type")).alias("tag")),
    )
    counters = [F.coalesce(c, F.lit(0)) for c in ("n", "replies")]
    out = joined.select(
        F.col("event_id").cast("string").alias("id"),
        _text().alias("text"),
        F.col("ts").alias("created_at"),
        F.struct(
            user.alias("id"),
            F.concat(F.lit("u"), user).alias("username"),
            F.concat(F.lit("User "), user).alias("name"),
            F.concat(F.lit("about "), user).alias("description"),
            F.struct(
                (F.col("user_id") % 5 == 0).alias("is_usual_suspect"),
                F.when(F.col("user_id") % 7 == 0, "A").when(F.col("user_id") % 7 == 1, "B").alias("party"),
            ).alias("actor"),
        ).alias("author"),
        F.struct(
            counters[0].alias("retweet_count"),
            counters[1].alias("reply_count"),
            F.floor("value").alias("like_count"),
            F.coalesce("quotes", F.lit(0)).alias("quote_count"),
        ).alias("public_metrics"),
        F.struct(tags.alias("hashtags")).alias("entities"),
        refs.alias("referenced_tweets"),
    )
    return out.select([F.col(f.name).cast(f.dataType) for f in schemas.POST.fields])


def _text():
    return F.concat(
        F.lit("post "), F.col("event_id"), F.lit(" #t"), F.col("k") % 10, F.lit(" about #"), F.col("event_type")
    )


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the posts that share their number with a document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    events = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    k, n = F.col("k").cast("double"), (F.col("n_chars") % 1000).cast("double")
    # Prime divisors keep averages away from rounding ties.
    return docs.join(events, "doc_id").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").cast("string").alias("id_str"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.col("lang").alias("language"),
        (k / 101).alias("Miedo"),
        (n / 1009).alias("Disgusto"),
        (k / 211 + 0.1).alias("Sorpresa"),
        (n / 2003 + 0.05).alias("Odio"),
        (1 - k / 101).alias("Diversion"),
        (n / 4001 + k / 401).alias("Agresividad"),
        (k * n / 100003).alias("Dirigido"),
        (n / 1511).alias("Enfado"),
        (k / 151).alias("Tristeza"),
        F.col("toxic").cast("double").alias("Toxico"),
        (F.lit(1.0) - n / 1009).alias("Ironia"),
        (1 - F.col("quality")).cast("double").alias("fakeness"),
        (1 - F.col("quality")).cast("double").alias("fakeness_probabilities"),
    )


# Profile columns the demo fills, a subset of the full profile.
PROFILE_FEATURES = (
    "followers_count",
    "friends_count",
    "listed_count",
    "favorites_count",
    "stealing_empath",
    "politics_empath",
    "week_days_count_ratio_behav",
    "weekend_days_count_ratio_behav",
)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the users that share their number with a customer."""
    customer = _table(spark, sf_dir, "customer")
    balance, key, nation = F.col("c_acctbal"), F.col("c_custkey"), F.col("c_nationkey")
    age = (
        F.when(nation < 6, "<=18").when(nation < 12, "19-29").when(nation < 18, "30-39").otherwise(">=40")
    )
    gender = (
        F.when(F.col("c_mktsegment") == "BUILDING", "male")
        .when(F.col("c_mktsegment") == "MACHINERY", "organization")
        .otherwise("female")
    )
    return customer.select(
        key.cast("string").alias("user_id"),
        key.cast("string").alias("twitter_id"),
        F.concat(F.lit("anon "), key).alias("anonymizedName"),
        F.concat_ws(
            " ", F.lit("I am"), "c_name", F.lit("from the segment"), "c_mktsegment", F.lit("and nation number"), nation
        ).alias("user_summary"),
        F.when(nation % 2 == 0, "en").otherwise("es").alias("lang"),
        (balance > 5000).alias("is_verified"),
        F.floor(F.abs(balance)).cast("double").alias("followers_count"),
        (nation * 10).cast("double").alias("friends_count"),
        (key % 17).cast("double").alias("listed_count"),
        F.floor(F.abs(balance) / 3).cast("double").alias("favorites_count"),
        ((key % 13) / 13.0).alias("stealing_empath"),
        ((nation % 5) / 5.0).alias("politics_empath"),
        ((key % 11) / 11.0).alias("week_days_count_ratio_behav"),
        (1 - (key % 11) / 11.0).alias("weekend_days_count_ratio_behav"),
        gender.alias("gender_demo"),
        age.alias("age_demo"),
    )


def fact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows: benchmark passages as claims, page addresses as domains."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("n"), F.col("text").alias("claim_text"))
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), "url")
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), "value")
    domain = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return items.join(events, "n").join(pages, "n", "left").select(
        F.col("n").alias("id_in_json"),
        F.col("n").cast("string").alias("tweet_id"),
        "claim_text",
        domain.alias("visual_evidence_domain"),
        F.concat(F.lit("seen at "), "url").alias("visual_evidence_text"),
        (F.col("value") / 130).cast("string").alias("text_evidence_similarity_score"),
        (F.col("value") / 170).cast("string").alias("visual_evidence_similarity_score"),
        (F.col("value") / 230).cast("string").alias("visual_evidence_graph_similarity_score"),
        F.lit("['caption', 'place']").alias("visual_evidence_matched_categories"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image inventory: the turns of a conversation name the images of a fact check."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    names = F.array(*map(F.lit, IMAGE_NAMES))
    return turns.select(
        F.lit("openarms").alias("dataset"),
        F.col("conv_id").cast("string").alias("id"),
        F.element_at(names, (F.col("turn") % len(IMAGE_NAMES) + 1).cast("int")).alias("stem"),
    ).distinct()


def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actor list with profile links, from suppliers."""
    supplier = _table(spark, sf_dir, "supplier")
    return supplier.select(
        F.concat(F.lit("https://social.example/u"), "s_suppkey", F.lit("?lang=es")).alias("link"),
        F.when(F.col("s_nationkey") % 2 == 0, "Twitter").otherwise("Other").alias("network"),
    )


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Politician list with profile links and parties, from customers."""
    customer = _table(spark, sf_dir, "customer")
    return customer.select(
        F.when(F.col("c_acctbal") < 0, "No en té")
        .otherwise(F.concat(F.lit("https://social.example/u"), "c_custkey"))
        .alias("link"),
        # Some listed politicians have no party.
        F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("party"),
    )


def dataset(spark: SparkSession, sf_dir: str, fresh: bool = False, second: bool = False) -> SocialDataset:
    """The demo dataset; its tables are built once per session and directory."""
    key = (spark.sparkContext.applicationId, str(sf_dir), second)
    if fresh or key not in _DATASETS:
        prepare(spark)
        _DATASETS[key] = SocialDataset(
            posts(spark, sf_dir, second),
            text_scores=text_scores(spark, sf_dir),
            profiles=profiles(spark, sf_dir),
            fact_checks=fact_checks(spark, sf_dir),
            stored=False,  # the mapping is computed from the given tables
        )
    return _DATASETS[key]
