"""Explicit schemas of the input tables."""

from pyspark.sql import types as T

ACTOR_FLAGS = T.StructType(
    [
        T.StructField("is_usual_suspect", T.BooleanType()),
        T.StructField("party", T.StringType()),
    ]
)

AUTHOR = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("actor", ACTOR_FLAGS),
    ]
)

REFERENCED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField(
            "author",
            T.StructType([T.StructField("id", T.StringType()), T.StructField("username", T.StringType())]),
        ),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("retweet_count", T.LongType()),
        T.StructField("reply_count", T.LongType()),
        T.StructField("like_count", T.LongType()),
        T.StructField("quote_count", T.LongType()),
    ]
)

POST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("author", AUTHOR),
        T.StructField("public_metrics", METRICS),
        T.StructField(
            "entities",
            T.StructType(
                [
                    T.StructField(
                        "hashtags",
                        T.ArrayType(T.StructType([T.StructField("tag", T.StringType())])),
                    )
                ]
            ),
        ),
        T.StructField("referenced_tweets", T.ArrayType(REFERENCED)),
    ]
)


def raw_post(actor_field: str = "actor") -> T.StructType:
    """Schema of post files: times still text, media kept, actor flags under ``actor_field``."""
    author = T.StructType(
        [f if f.name != "actor" else T.StructField(actor_field, ACTOR_FLAGS) for f in AUTHOR.fields]
    )
    referenced = T.StructType(
        [f if f.name != "created_at" else T.StructField("created_at", T.StringType()) for f in REFERENCED.fields]
    )
    media = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("media_key", "type", "url", "preview_image_url", "alt_text")]
    )
    return T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("created_at", T.StringType()),
            T.StructField("editable_until", T.StringType()),
            T.StructField("retrieved_at", T.StringType()),
            T.StructField("conversation_id", T.StringType()),
            T.StructField("author", author),
            POST["public_metrics"],
            POST["entities"],
            T.StructField("attachments", T.StructType([T.StructField("media", T.ArrayType(media))])),
            T.StructField("referenced_tweets", T.ArrayType(referenced)),
        ]
    )
