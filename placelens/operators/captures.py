"""Stored pages to page rows and review-card rows.

The HTML is read once, in one map-only Arrow pass without a shuffle. Everything
after it is narrow: wide HTML never crosses the network. Scalar parsing of the
texts happens in column expressions on the result.
"""

from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from placelens import fixed_values as V
from placelens.functions import headers
from placelens.functions.reviews import card_rating, trimmed_or, trimmed_or_null
from placelens.operators import markup

# Workers need no copy of this package for the page pass.
cloudpickle.register_pickle_by_value(markup)

CARD = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("author_url", T.StringType()),
        T.StructField("stars_label", T.StringType()),
        T.StructField("publish_time", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("photos", T.LongType()),
        T.StructField("owner_response_text", T.StringType()),
        T.StructField("owner_response_time", T.StringType()),
    ]
)

PAGE_FIELDS = [
    T.StructField("name", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("rating_text", T.StringType()),
    T.StructField("tab_text", T.StringType()),
    T.StructField("badge_text", T.StringType()),
    T.StructField("body_snippet", T.StringType()),
    T.StructField("body_text", T.StringType()),
    T.StructField("body_chars", T.LongType()),
    T.StructField("sort_text", T.StringType()),
    T.StructField("loading", T.BooleanType()),
    T.StructField("asks_sign_in", T.BooleanType()),
    T.StructField("cards", T.ArrayType(CARD)),
]

ROWS_PER_OUTPUT_BATCH = 64


def read_pages(
    captures: DataFrame,
    keys: Sequence[str] = ("place_key", "round", "pass_no"),
    selectors: dict[str, str] | None = None,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """One row per captured page: ``keys`` and page fields (default: all).

    ``selectors`` overrides entries of the default set. The optimizer moves
    neither filters nor column pruning below a Python stage: filter captures
    before this call and name the ``fields`` you need.
    """
    config = {**V.DEFAULT_SELECTORS, **(selectors or {})}
    names = {k: v for k, v in config.items() if k.endswith("_attr")}
    compiled = {k: markup.compile_selector(v) for k, v in config.items() if k not in names}
    keys_asked = markup.lookup_keys(compiled.values())
    settings = (compiled, names, keys_asked, V.BODY_SNIPPET_CHARS, V.SIGN_IN_TEXT)
    wanted = [f for f in PAGE_FIELDS if fields is None or f.name in fields]
    wanted_names = [f.name for f in wanted]
    source = captures.select(*keys, "html")
    schema = T.StructType([*source.drop("html").schema.fields, *wanted])
    arrow_schema = to_arrow_schema(schema)
    page_class, step = markup.Page, ROWS_PER_OUTPUT_BATCH

    def read(html):
        page = page_class(html, *settings)
        return {name: getattr(page, name)() for name in wanted_names}

    def extract(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                column = {f.name: part.column(i) for i, f in enumerate(part.schema)}
                rows = [read(html.as_py()) for html in column["html"]]
                columns = [
                    pa.array([r[f.name] for r in rows], type=f.type)
                    if f.name in wanted_names
                    else column[f.name].cast(f.type)
                    for f in arrow_schema
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    return source.mapInArrow(extract, schema)


def page_state(pages: DataFrame) -> DataFrame:
    """Adds ``page_state``: limited_view, consent, sign_in_required or ok."""
    return pages.withColumn(
        "page_state",
        F.when(F.col("body_text").contains(V.LIMITED_VIEW_TEXT), "limited_view")
        .when(F.col("resolved_url").contains(V.CONSENT_HOST), "consent")
        .when(F.col("asks_sign_in"), "sign_in_required")
        .otherwise("ok"),
    )


def sort_verified(pages: DataFrame, order: str) -> DataFrame:
    """Adds whether the page announced the wanted order; `relevant` is not checked."""
    if order not in V.SORT_ORDERS:
        raise ValueError(f"sort order must be one of {V.SORT_ORDERS}")
    announced = F.lower(trimmed_or(F.col("sort_text"), "")).contains(order)
    return pages.withColumn("sort_verified", F.lit(order == "relevant") | announced)


def card_rows(pages: DataFrame, keys: Sequence[str] = ("place_key", "round", "pass_no")) -> DataFrame:
    """One raw review row per card that carries an id, in page order."""
    card = F.col("card")
    return (
        pages.select(*keys, F.posexplode("cards").alias("pos", "card"))
        .filter(F.length(card["review_id"]) > 0)
        .select(
            *keys,
            F.col("pos").cast("bigint").alias("pos"),
            card["review_id"].alias("review_id"),
            trimmed_or(card["author"], V.ANONYMOUS_AUTHOR).alias("author"),
            card["author_url"].alias("author_url"),
            trimmed_or(card["publish_time"], "").alias("publish_time"),
            card_rating(card["stars_label"]).alias("rating"),
            trimmed_or_null(card["text"]).alias("text"),
            F.lit(None).cast("string").alias("original_text"),
            card["photos"].alias("photos"),
            trimmed_or_null(card["owner_response_text"]).alias("owner_response_text"),
            trimmed_or_null(card["owner_response_time"]).alias("owner_response_time"),
        )
    )


def header_rows(pages: DataFrame) -> DataFrame:
    """Replaces the header texts by values; ``count_source`` says which text won.

    A page without a name element is "Unknown"; an empty one stays empty.
    """
    texts = dict(zip(V.COUNT_SOURCES, ("tab_text", "badge_text", "body_snippet")))
    parsed = {
        source: headers.review_count(
            F.left(c, F.lit(V.BODY_SNIPPET_CHARS)) if c == "body_snippet" else F.col(c)
        )
        for source, c in texts.items()
    }
    first = headers.first_count({source: F.col(f"_{source}") for source in texts})
    return (
        pages.drop("cards")
        .withColumns(
            {
                "name": F.coalesce("name", F.lit(V.UNKNOWN_NAME)),
                "header_rating": headers.header_rating(F.col("rating_text")),
                **{f"_{source}": count for source, count in parsed.items()},
            }
        )
        .withColumn("_count", first)
        .withColumns(
            {
                "header_total_reviews": F.col("_count.value"),
                "count_source": F.col("_count.source"),
            }
        )
        .drop("_count", *[f"_{source}" for source in texts])
    )
