"""Reading, flattening, time casting and writing of post files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlab import schemas

# Fields that hold times, at any depth.
TIME_FIELDS = ("created_at", "editable_until", "retrieved_at")
CORRUPT = "_corrupt_record"


def read_posts(spark: SparkSession, path, actor_field: str = "actor") -> DataFrame:
    """Posts from newline-delimited JSON, plain or gz; unreadable lines go to ``_corrupt_record``."""
    schema = T.StructType(schemas.raw_post(actor_field).fields + [T.StructField(CORRUPT, T.StringType())])
    posts = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    if actor_field != "actor":
        posts = posts.withColumn(
            "author", F.col("author").withField("actor", F.col(f"author.{actor_field}")).dropFields(actor_field)
        )
    return posts


def actor_field_of(schema: T.StructType) -> str | None:
    """Name of the author's sub-structure that carries the suspect flag."""
    for field in schema["author"].dataType.fields:
        if isinstance(field.dataType, T.StructType) and "is_usual_suspect" in field.dataType.names:
            return field.name
    return None


# ----------------------------------------------------------------- time fields


def _parsed(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        if "$date" not in kind.names:
            raise ValueError(f"time given as a structure without $date: {kind.simpleString()}")
        value = value.getField("$date")
        kind = kind["$date"].dataType
    if isinstance(kind, T.TimestampType):
        return value
    inner = F.get_json_object(value, "$['$date']")
    text = F.when(~value.startswith("{"), value).when(inner.isNotNull(), inner).when(
        value.isNotNull(), F.raise_error(F.concat(F.lit("time given as a structure without $date: "), value)).cast("string")
    )
    return F.to_timestamp(F.regexp_replace(text, " ", "T"))


def _encoded(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return value
    if isinstance(kind, T.TimestampType):
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    else:
        inner = F.get_json_object(value, "$['$date']")
        text = F.regexp_replace(F.coalesce(inner, value), " ", "T")
    return F.when(value.isNotNull(), F.struct(text.alias("$date")))


def _touches(kind: T.DataType, names) -> bool:
    if isinstance(kind, T.ArrayType):
        return _touches(kind.elementType, names)
    if isinstance(kind, T.StructType):
        return any(f.name in names or _touches(f.dataType, names) for f in kind.fields)
    return False


def _rebuilt(value: Column, kind: T.DataType, change, names) -> Column:
    """Apply ``change`` to the named fields inside structures and arrays."""
    if isinstance(kind, T.ArrayType) and _touches(kind, names):
        return F.transform(value, lambda item: _rebuilt(item, kind.elementType, change, names))
    if isinstance(kind, T.StructType) and _touches(kind, names):
        fields = [
            (
                change(value.getField(f.name), f.dataType)
                if f.name in names
                else _rebuilt(value.getField(f.name), f.dataType, change, names)
            ).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _changed(df: DataFrame, change, names) -> DataFrame:
    return df.select(
        *[
            (
                change(F.col(f.name), f.dataType)
                if f.name in names
                else _rebuilt(F.col(f.name), f.dataType, change, names)
            ).alias(f.name)
            for f in df.schema.fields
        ]
    )


def cast_times(df: DataFrame) -> DataFrame:
    """Turn time fields at any depth, text or ``{"$date": text}``, into timestamps."""
    return _changed(df, _parsed, TIME_FIELDS)


def cast_reference_times(df: DataFrame) -> DataFrame:
    """Only the times of referenced posts; already cast tables pass unchanged."""
    kind = df.schema["referenced_tweets"].dataType
    return df.withColumn("referenced_tweets", _rebuilt(F.col("referenced_tweets"), kind, _parsed, ("created_at",)))


def encode_times(df: DataFrame) -> DataFrame:
    """Time fields as ``{"$date": text}`` structures, the form import files use."""
    return _changed(df, _encoded, TIME_FIELDS)


def as_posts(df: DataFrame) -> DataFrame:
    """Cast times and keep the columns of the posts table, missing ones as null."""
    df = cast_times(df)
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.POST.fields
        ]
    )


# -------------------------------------------------------------------- API pages


def _lookup(items: Column, key: str, value: Column) -> Column:
    return F.try_element_at(F.filter(items, lambda x: x[key] == value), F.lit(1))


def flatten_pages(pages: DataFrame) -> DataFrame:
    """One row per post of API pages ``{data[], includes{users[], tweets[], media[]}}``.

    Authors, referenced posts and media come from the page's own includes, so no
    join is needed. A table without ``data`` is already flat.
    """
    if "data" not in pages.columns:
        return pages
    users, tweets, media = F.col("includes.users"), F.col("includes.tweets"), F.col("includes.media")

    def referenced(ref: Column) -> Column:
        tweet = _lookup(tweets, "id", ref["id"])
        author = _lookup(users, "id", tweet["author_id"])
        return F.struct(
            ref["id"].alias("id"),
            ref["type"].alias("type"),
            tweet["text"].alias("text"),
            tweet["created_at"].alias("created_at"),
            F.when(author.isNotNull(), F.struct(author["id"].alias("id"), author["username"].alias("username"))).alias(
                "author"
            ),
        )

    posts = pages.select(F.explode("data").alias("d"), "includes")
    kind = pages.schema["data"].dataType.elementType
    kept = [n for n in kind.names if n not in ("author_id", "referenced_tweets", "attachments")]
    has_media = "attachments" in kind.names and "media" in pages.schema["includes"].dataType.names
    columns = [F.col(f"d.{n}") for n in kept]
    columns.append(_lookup(users, "id", F.col("d.author_id")).alias("author"))
    columns.append(F.transform("d.referenced_tweets", referenced).alias("referenced_tweets"))
    if has_media:
        keys = F.col("d.attachments.media_keys")
        columns.append(
            F.when(
                keys.isNotNull(),
                F.struct(F.transform(keys, lambda k: _lookup(media, "media_key", k)).alias("media")),
            ).alias("attachments")
        )
    return posts.select(*columns)


# ----------------------------------------------------------------------- output


def ingest_outputs(posts: DataFrame) -> dict[str, DataFrame]:
    """The four results of ingest: all posts, posts with media, import form, posts by listed actors."""
    actor = F.col("author.actor")
    outputs = {
        "preprocessed": posts,
        "mongoimport": encode_times(posts),
        "usual_suspects_and_politicians": posts.where(
            actor["is_usual_suspect"] | (F.coalesce(actor["party"], F.lit("")) != "")
        ),
    }
    if "attachments" in posts.columns:
        outputs["media"] = posts.where(F.col("attachments.media").isNotNull()).select(
            "id", "text", "author", F.col("attachments.media").alias("media")
        )
    return outputs


def write_ingest_outputs(posts: DataFrame, folder: str) -> None:
    for name, rows in ingest_outputs(posts).items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")
