"""Location inputs: classify, reject, resume, and verify what was loaded."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens import fixed_values as V
from placelens.functions import urls
from placelens.functions.text import trimmed


def classify_locations(inputs: DataFrame, column: str = "input") -> DataFrame:
    """Adds ``kind``, ``url``, ``place_id`` and ``is_short_url``.

    ``kind`` and the other three are null for inputs of no known form.
    """
    text = F.col("_text")
    kind = F.col("kind")
    return (
        inputs.withColumn("_text", trimmed(F.col(column)))
        .withColumn("kind", urls.location_kind(text))
        .withColumns(
            {
                "url": F.when(
                    kind == "place_id", F.concat(F.lit(V.PLACE_ID_QUERY_URL), text)
                ).when(kind.isNotNull(), text),
                "place_id": F.when(kind == "place_id", text).when(
                    kind.isin("long", "cid", "ftid"), urls.place_id_in_url(text)
                ),
                "is_short_url": F.when(kind.isNotNull(), kind == "short"),
            }
        )
        .drop("_text")
    )


def valid_locations(inputs: DataFrame, column: str = "input") -> DataFrame:
    return classify_locations(inputs, column).filter(F.col("kind").isNotNull())


def rejected_locations(inputs: DataFrame, column: str = "input") -> DataFrame:
    """Non-blank inputs of no known form."""
    text = trimmed(F.col(column))
    return inputs.filter((text != "") & urls.location_kind(text).isNull())


def navigation_urls(locations: DataFrame) -> DataFrame:
    """Adds the URL to load for each location, and whether ``url`` lacks the locale."""
    return urls.canonical_urls(locations, "url", "target_url").withColumn(
        "needs_locale_fix", urls.needs_locale_fix(F.col("url"))
    )


def pending_locations(inputs: DataFrame, state: DataFrame) -> DataFrame:
    """Inputs not completed in an earlier run, matched on the exact raw text.

    Duplicates within a run stay. The join strategy is left to the optimizer:
    it broadcasts the state only when its size is known to be small.
    """
    return inputs.join(state.select("input"), "input", "left_anti")


def verify_identity(
    captures: DataFrame, requests: DataFrame, key: str = "place_key"
) -> DataFrame:
    """Joins loaded pages with what was requested and checks they agree.

    ``captures`` needs ``key`` and ``resolved_url``; ``requests`` needs ``key``
    and ``place_id``, one row per key. Adds ``resolved_place_id``, ``verified``
    and the identity to publish: final id and final URL. Only ids of the
    ``0x..`` form can be compared with what a URL carries; others pass.
    """
    requested = requests.select(key, F.col("place_id").alias("requested_place_id"))
    expected, resolved = F.col("requested_place_id"), F.col("resolved_place_id")
    return (
        captures.join(requested, key)
        .withColumn("resolved_place_id", urls.place_id_in_url(F.col("resolved_url")))
        .withColumns(
            {
                "verified": ~urls.is_verifiable_place_id(expected)
                | urls.place_ids_match(expected, resolved),
                "final_place_id": F.coalesce(expected, resolved),
                "final_url": F.col("resolved_url"),
            }
        )
        .withColumn(
            "error_kind", F.when(~F.col("verified"), F.lit(V.NAVIGATION_ERROR_KIND))
        )
    )
