"""Fact-check evidence: views, ingest against the image inventory, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlab.functions.columns import rounded

# Images every fact check needs, expected fields, dataset names.
REQUIRED_IMAGES = (
    "claim_image",
    "evidence_image",
    "graph_claim",
    "graph_evidence_text",
    "graph_evidence_vis",
    "evidence_image1",
)
EXPECTED_IMAGES = (
    "claim_image",
    "evidence_image",
    "graph_claim",
    "graph_evidence_text",
    "graph_evidence_vis",
    "visual_evidences",
)
EXPECTED_FIELDS = (
    "claim_text",
    "id",
    "tweet_id",
    "text_evidences",
    "evidence_text",
    "evidence_image_alt_text",
    "results",
)
EXPECTED_RESULTS = (
    "predicted_label",
    "actual_label",
    "num_claim_edges",
    "frac_verified",
    "explanations",
    "visual_similarity_score",
)
DATASET_NAMES = {
    "bcn19": "Barcelona_2019",
    "mena_aggr": "MENA_Agressions",
    "mena_ajud": "MENA_Ajudes",
    "openarms": "Openarms",
    "gen19": "Generales_2019",
    "gen21": "Generalitat_2021",
}


def fact_check_view(fact_checks: DataFrame) -> DataFrame:
    """Claim and evidence texts, domain, and the three scores to three decimals."""
    scores = (
        "text_evidence_similarity_score",
        "visual_evidence_similarity_score",
        "visual_evidence_graph_similarity_score",
    )
    return fact_checks.select(
        "tweet_id",
        "claim_text",
        "visual_evidence_text",
        *[rounded(F.col(s), 3).alias(s) for s in scores],
        "visual_evidence_domain",
    )


def stem_of(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def _inventory(images: DataFrame) -> DataFrame:
    # A fact check has a handful of image names; the set is per (dataset, id).
    return images.groupBy("dataset", F.col("id").alias("image_id")).agg(
        F.array_sort(F.collect_set("stem")).alias("found")
    )


def match_images(metadata: DataFrame, images: DataFrame) -> DataFrame:
    """Metadata rows with the dataset and image names found for their id, and what was expected."""
    expected = F.array_sort(F.array_distinct(F.transform("image_paths", stem_of)))
    rows = metadata.withColumn("image_id", F.col("id_in_json").cast("string")).withColumn("expected", expected)
    joined = rows.join(_inventory(images), "image_id", "left").drop("image_id")
    fits = F.col("dataset").isNotNull() & F.coalesce(F.col("found") == F.col("expected"), F.lit(False))
    return joined.withColumn("complete", fits)


def ingest_fact_checks(metadata: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted fact checks in stored form, and the rejected rows with missing and unexpected images."""
    matched = match_images(metadata, images)
    names = F.create_map(*[F.lit(x) for pair in DATASET_NAMES.items() for x in pair])
    accepted = matched.where("complete").drop("complete", "found", "expected", "image_paths")
    accepted = (
        accepted.withColumn("dataset", F.coalesce(names[F.col("dataset")], F.col("dataset")))
        .withColumn("tweet_id", F.col("results.tweet_id").cast("string"))
        .withColumn("results", F.col("results").dropFields("tweet_id"))
    )
    rejected = matched.where(~F.col("complete")).select(
        "id_in_json",
        "dataset",
        F.array_except("expected", F.coalesce("found", F.array().cast("array<string>"))).alias("missing"),
        F.array_except(F.coalesce("found", F.array().cast("array<string>")), "expected").alias("unexpected"),
    )
    return accepted, rejected


def missing_images(fact_checks: DataFrame, images: DataFrame, required: Sequence[str] = REQUIRED_IMAGES) -> DataFrame:
    """(tweet_id, stem) of required images that the inventory lacks."""
    wanted = fact_checks.select("tweet_id").distinct().select(
        "tweet_id", F.explode(F.array(*map(F.lit, required))).alias("stem")
    )
    found = images.select(F.col("id").alias("tweet_id"), "stem")
    return wanted.join(found, ["tweet_id", "stem"], "left_anti")


def _difference(kind: str, found: Column, expected: Sequence[str]) -> Column:
    wanted = F.array(*map(F.lit, expected)) if expected else F.array().cast("array<string>")
    have = F.coalesce(found, F.array().cast("array<string>"))
    return F.struct(
        F.lit(kind).alias("part"),
        F.array_sort(F.array_except(have, wanted)).alias("unexpected"),
        F.array_sort(F.array_except(wanted, have)).alias("missing"),
    )


def validate_fact_checks(
    records: DataFrame, images: DataFrame, fields=EXPECTED_FIELDS, results=EXPECTED_RESULTS, stems=EXPECTED_IMAGES
) -> DataFrame:
    """Differences between fact-check records (dataset, id, json) and what is expected of them.

    Compares field names, result field names and image names; one row per
    record and part that differs.
    """
    joined = records.join(_inventory(images).withColumnRenamed("image_id", "id"), ["dataset", "id"], "left")
    parts = F.array(
        _difference("fields", F.json_object_keys("json"), fields),
        _difference("results", F.json_object_keys(F.get_json_object("json", "$.results")), results),
        _difference("images", F.col("found"), stems),
    )
    rows = joined.select("dataset", "id", F.explode(parts).alias("d")).select("dataset", "id", "d.*")
    return rows.where((F.size("unexpected") > 0) | (F.size("missing") > 0))
