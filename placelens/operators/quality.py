"""Monitors that tell when page selectors went stale, and shareable texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens import fixed_values as V
from placelens.functions.text import masked


def zero_rating_counts(cards: DataFrame, *keys: str) -> DataFrame:
    """Per capture: cards, and cards whose stars could not be read."""
    return cards.groupBy(*keys).agg(
        F.count("*").alias("card_count"),
        F.count_if(F.col("rating") == 0).alias("zero_rating_count"),
    )


def stale_selector_alerts(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages with plenty of text but not one card. Needs no join: cards sit in the page row."""
    return pages.filter(
        (F.size("cards") == 0) & (F.col("body_chars") > V.STALE_SELECTOR_BODY_CHARS)
    ).select(*keys, "body_chars")


def header_quality(headers: DataFrame) -> DataFrame:
    """Per count source (null: no text parsed): pages and their unread fields."""
    present = F.coalesce(F.length("rating_text"), F.lit(0)) > 0
    return headers.groupBy("count_source").agg(
        F.count("*").alias("pages"),
        F.count_if(present & F.col("header_rating").isNull()).alias("unparsed_ratings"),
        F.count_if(F.col("header_total_reviews").isNull()).alias("unparsed_counts"),
        F.count_if(F.col("name") == V.UNKNOWN_NAME).alias("unknown_names"),
    )


def share_safe_table(texts: DataFrame, *columns: str) -> DataFrame:
    """Masks text columns; each is then cut to a length fit for a report."""
    return texts.withColumns(
        {c: F.left(masked(F.col(c)), F.lit(V.SHARED_SNIPPET_CHARS)) for c in columns}
    )
