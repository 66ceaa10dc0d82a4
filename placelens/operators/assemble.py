"""Result documents: one per location, with reconciled counts.

The flat review table is the primary product. A document is either one row, with its
reviews as an array, or the rows of its text, which have no bound in number.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens import fixed_values as V
from placelens.functions.export import csv_line, flat_review, indented
from placelens.operators.collect import number_reviews, seen_order

PLACE = ["place_key"]


def _review_struct():
    names = {
        "id": "review_id",
        "author": "author",
        "authorUrl": "author_url",
        "publishTime": "publish_time",
        "rating": "rating",
        "text": "text",
        "originalText": "original_text",
        "originalLanguage": "original_language",
        "photos": "photos",
        "ownerResponse": "owner_response",
    }
    return F.struct(*[F.col(c).alias(n) for n, c in names.items()])


def collect_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews as one array in collection order, one row per location.

    An array is a value of one row, so a location has to fit one (2 GB). What has to
    hold for any size goes through ``document_lines``.
    """
    entry = F.struct(*seen_order(reviews), _review_struct().alias("review"))
    entries = reviews.groupBy(*PLACE).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    return entries.select(*PLACE, F.transform("_entries", lambda e: e["review"]).alias("reviews"))


def reconcile_counts(headers: DataFrame, reviews: DataFrame) -> DataFrame:
    """Headers with ``total_reviews``, the number of reviews collected.

    What the page claimed stays in ``header_total_reviews``.
    """
    collected = reviews.groupBy(*PLACE).agg(F.count("*").alias("total_reviews"))
    return headers.join(collected, PLACE, "left").withColumn(
        "total_reviews", F.coalesce("total_reviews", F.lit(0).cast("bigint"))
    )


def coverage_gap(reconciled: DataFrame) -> DataFrame:
    """Claimed minus collected reviews; null when the page claimed nothing."""
    return reconciled.select(
        *PLACE,
        "header_total_reviews",
        "total_reviews",
        (F.col("header_total_reviews") - F.col("total_reviews")).alias("coverage_gap"),
    )


def _business():
    c = F.col
    return F.struct(
        c("name").alias("name"),
        c("place_id").alias("placeId"),
        c("url").alias("url"),
        c("address").alias("address"),
        c("header_rating").alias("rating"),
        c("total_reviews").alias("totalReviews"),
        c("header_total_reviews").alias("headerTotalReviews"),
        c("scrape_date").alias("scrapeDate"),
    )


def _metadata(sort_order: str):
    if sort_order not in V.SORT_ORDERS:
        raise ValueError(f"sort order must be one of {V.SORT_ORDERS}")
    return F.struct(
        F.lit(V.PROVIDERS[0]).alias("provider"),
        F.col("scrape_duration_ms").cast("double").alias("scrapeDurationMs"),
        F.col("total_reviews").alias("reviewsCollected"),
        F.lit(sort_order).alias("sortOrder"),
    )


def assemble_documents(headers: DataFrame, reviews: DataFrame, sort_order: str) -> DataFrame:
    """``place_key, business, reviews, metadata``: one document per location, as one row.

    A location without reviews gets a document with an empty array. The narrow headers
    join the arrays where the aggregation left them.
    """
    metadata = _metadata(sort_order)
    arrays = collect_reviews(reviews)
    none = F.array().cast(arrays.schema["reviews"].dataType)
    return (
        headers.join(arrays, PLACE, "left")
        .withColumn("reviews", F.coalesce("reviews", none))
        .withColumn("total_reviews", F.size("reviews").cast("bigint"))
        .select(*PLACE, _business().alias("business"), "reviews", metadata.alias("metadata"))
    )


def document_lines(headers: DataFrame, reviews: DataFrame, sort_order: str, fmt: str) -> DataFrame:
    """The text of every document as rows of lines: ``place_key, section, ordinal, value``.

    Sections are 0, the opening (for CSV its header line), 1, one row for each review, and
    2, the closing. Rows in (section, ordinal) order, a newline after each, are the file
    that one location gets, however many reviews it has: no row holds more than one
    review. JSON is indented by two blanks. ``reviews`` is read twice, once for keys
    and places alone: hand in a stored table.
    """
    if fmt not in V.OUTPUT_FORMATS:
        raise ValueError(f"format must be one of {V.OUTPUT_FORMATS}")
    metadata = _metadata(sort_order)
    numbered = number_reviews(reviews.drop("ordinal"), total="_of")
    totals = reviews.groupBy(*PLACE).agg(F.count("*").alias("total_reviews"))
    heads = headers.join(totals, PLACE, "left").withColumn("total_reviews", F.coalesce("total_reviews", F.lit(0).cast("bigint")))
    zero = F.lit(0).cast("bigint").alias("ordinal")
    if fmt == "csv":
        opening = heads.select(*PLACE, F.lit(0).alias("section"), zero, F.lit(",".join(V.CSV_COLUMNS)).alias("value"))
        named = numbered.join(headers.select(*PLACE, F.col("name").alias("_business")), PLACE)
        line = csv_line(flat_review(F.col("_business"), _review_struct()))
        return opening.unionByName(named.select(*PLACE, F.lit(1).alias("section"), "ordinal", line.alias("value")))
    empty = F.col("total_reviews") == 0
    first = F.concat(F.lit('{\n  "business": '), indented(_business(), heads, 2), F.lit(',\n  "reviews": ['), F.when(empty, "],").otherwise(""))
    last = F.concat(F.when(empty, "").otherwise("  ],\n"), F.lit('  "metadata": '), indented(metadata, heads, 2), F.lit("\n}"))
    ends = F.array(F.struct(F.lit(0).alias("section"), first.alias("value")), F.struct(F.lit(2).alias("section"), last.alias("value")))
    outside = heads.select(*PLACE, F.explode(ends).alias("_end")).select(*PLACE, "_end.section", zero, "_end.value")
    review = F.concat(F.lit("    "), indented(_review_struct(), numbered, 4), F.when(F.col("ordinal") < F.col("_of"), ",").otherwise(""))
    return outside.unionByName(numbered.select(*PLACE, F.lit(1).alias("section"), "ordinal", review.alias("value")))
