"""Schemas of the tables and documents the jobs read and write."""

from pyspark.sql import types as T

OWNER_RESPONSE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("originalText", T.StringType()),
        T.StructField("originalLanguage", T.StringType()),
        T.StructField("publishTime", T.StringType()),
    ]
)

REVIEW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("authorUrl", T.StringType()),
        T.StructField("publishTime", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("originalText", T.StringType()),
        T.StructField("originalLanguage", T.StringType()),
        T.StructField("photos", T.IntegerType()),
        T.StructField("ownerResponse", OWNER_RESPONSE),
    ]
)

BUSINESS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("placeId", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("totalReviews", T.LongType()),
        T.StructField("headerTotalReviews", T.LongType()),
        T.StructField("scrapeDate", T.StringType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("provider", T.StringType()),
        T.StructField("scrapeDurationMs", T.DoubleType()),
        T.StructField("reviewsCollected", T.LongType()),
        T.StructField("sortOrder", T.StringType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("business", BUSINESS),
        T.StructField("reviews", T.ArrayType(REVIEW)),
        T.StructField("metadata", METADATA),
    ]
)

# One stored page of one polling round. `pass_no` is 1 for the second look the
# collection loop takes in the same round after a loading indicator went away.
CAPTURE = T.StructType(
    [
        T.StructField("place_key", T.StringType(), False),
        T.StructField("round", T.IntegerType(), False),
        T.StructField("pass_no", T.IntegerType()),
        T.StructField("resolved_url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("captured_ms", T.LongType()),
    ]
)

RAW_REVIEW = T.StructType(
    [
        T.StructField("place_key", T.StringType(), False),
        T.StructField("round", T.IntegerType(), False),
        T.StructField("pos", T.LongType(), False),
        T.StructField("review_id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("author_url", T.StringType()),
        T.StructField("publish_time", T.StringType()),
        T.StructField("rating", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("original_text", T.StringType()),
        T.StructField("photos", T.LongType()),
        T.StructField("owner_response_text", T.StringType()),
        T.StructField("owner_response_time", T.StringType()),
    ]
)

RUN_STATE = T.StructType(
    [
        T.StructField("input", T.StringType()),
        T.StructField("file_stem", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("run_no", T.LongType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
