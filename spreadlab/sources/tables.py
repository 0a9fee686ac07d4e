"""Readers of small companion files and result exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Reference groups and their median files per language. Catalan
# shares the checkers and controls of Spanish.
GROUPS = ("fake_spreaders", "fact_checkers", "control")
MEDIAN_FILES = {
    "en": ("results_1_fake_spreaders_en", "results_2_fact_checkers_eng", "results_3_random_en"),
    "es": ("results_4_fake_spreaders_esp", "results_5_fact_checkers_esp", "results_6_random_es"),
    "ca": ("results_7_fake_spreaders_cat", "results_5_fact_checkers_esp", "results_6_random_es"),
}
RELEVANT_FILES = {
    "en": "results_selected_features_names1_fake_spreaders_en3_random_en",
    "es": "results_selected_features_names4_fake_spreaders_esp6_random_es",
    "ca": "results_selected_features_names6_random_es7_fake_spreaders_cat",
}
CATALOGUE_FILES = {
    "ca": "features_seleccion_catalan.csv",
    "es": "features_seleccion_castellano.csv",
    "en": "features_seleccion_ingles.csv",
}


def read_medians(spark: SparkSession, path: str, relevant: DataFrame | None = None) -> DataFrame:
    """Feature medians of one group; with ``relevant(section, feature)`` only those, per section."""
    medians = spark.read.csv(path, sep="\t", schema="feature string, median string").select(
        "feature", F.expr("try_cast(median AS double)").alias("median")
    )
    return medians if relevant is None else relevant.join(medians, "feature").select("section", "feature", "median")


def read_group_medians(spark: SparkSession, folder: str, lang: str) -> DataFrame:
    """(group, feature, median) of the three reference groups of a language."""
    parts = [
        read_medians(spark, f"{folder}/{name}").select(F.lit(group).alias("group"), "feature", "median")
        for group, name in zip(GROUPS, MEDIAN_FILES.get(lang, MEDIAN_FILES["ca"]))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_relevant_features(spark: SparkSession, path: str) -> DataFrame:
    """(section, feature) of a list in which lines with a colon open a section."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    header = F.when(F.contains("line", F.lit(":")), F.col("line"))
    # One short file: its lines fit one task.
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        lines.withColumn("section", F.last(header, ignorenulls=True).over(upto))
        .where(~F.contains("line", F.lit(":")) & (F.trim("line") != ""))
        .select("section", F.col("line").alias("feature"))
    )


def read_feature_catalogue(spark: SparkSession, folder: str, lang: str) -> DataFrame:
    """(category, feature_name, display_name, rank) of a language; a byte order mark is tolerated."""
    if lang not in CATALOGUE_FILES:
        raise KeyError(f"no feature catalogue for language {lang!r}")
    lines = spark.read.text(f"{folder}/{CATALOGUE_FILES[lang]}", wholetext=True)
    rows = lines.select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n")).alias("at", "line"))
    cells = F.split("line", ";")
    rows = rows.where((F.col("at") > 0) & (F.trim("line") != "")).select(
        F.trim(cells[0]).alias("category"), F.trim(cells[1]).alias("feature_name"), F.trim(cells[2]).alias("display_name"), "at"
    )
    in_category = Window.partitionBy("category").orderBy("at")
    return rows.select(
        "category", "feature_name", "display_name", (F.row_number().over(in_category) - 1).alias("rank")
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, is_prefix, category) of a dictionary with ``%`` around its category list.

    A trailing star marks a prefix.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    lines = lines.select("at", F.trim("line").alias("line")).where(F.col("line") != "")
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("part", F.sum(F.when(F.col("line").startswith("%"), 1).otherwise(0)).over(upto))
    lines = lines.where(~F.col("line").startswith("%"))
    cells = F.split("line", r"\s+")
    names = lines.where(F.col("part") == 1).select(cells[0].alias("code"), cells[1].alias("category"))
    words = lines.where(F.col("part") >= 2).select(
        F.lower(cells[0]).alias("entry"), F.explode(F.slice(cells, F.lit(2), F.size(cells))).alias("code")
    )
    return words.join(names, "code").select(
        F.rtrim("entry", F.lit("*")).alias("word"), F.col("entry").endswith("*").alias("is_prefix"), "category"
    ).distinct()


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, id, stem, path) of jpg and png files under ``folder/<dataset>/<id>/``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    pattern = r"([^/]+)/([^/]+)/([^/]+)\.(?:jpg|png)$"
    return files.where(F.col("path").rlike(pattern)).select(
        *[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(("dataset", "id", "stem"))], "path"
    )


def export_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Write a result as CSV with a header; small results as one file."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True)


def to_markdown(df: DataFrame, path: str) -> None:
    """Write a whole result as a Markdown table: text files whose lines are the rows, the first with the heading."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\n|\|", " "), F.lit(""))
    lines = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("value"))
    heading = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    top = df.sparkSession.createDataFrame([("\n".join(heading),)], "value string").coalesce(1)
    top.unionByName(lines).write.mode("overwrite").text(path)
