"""Raw review rows to valid review rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.functions import reviews as R


def _shaped(raw: DataFrame) -> DataFrame:
    c = F.col
    return raw.withColumns(
        {
            "review_id": R.review_id(
                c("review_id"), c("author"), c("publish_time"), c("rating"), c("text")
            ),
            "original_text": R.resolved_original(c("text"), c("original_text")),
            "original_language": R.original_hint(c("text"), c("original_text")),
            "owner_response": R.owner_response(c("owner_response_text"), c("owner_response_time")),
        }
    ).drop("owner_response_text", "owner_response_time")


def _issues():
    return R.review_issues(
        *[F.col(n) for n in ("review_id", "author", "publish_time", "rating", "photos")]
    )


def _valid(raw: DataFrame) -> Column:
    """The rules of ``review_issues`` as plain comparisons, which scans can push down.

    The id needs no test: shaping never leaves it null.
    """

    def whole(name, low, high=None):
        c = F.col(name)
        test = (c >= low) if high is None else c.between(low, high)
        fractional = isinstance(raw.schema[name].dataType, T.FractionalType)
        return test & (c == F.floor(c)) if fractional else test

    present = F.col("author").isNotNull() & F.col("publish_time").isNotNull()
    return present & whole("rating", 0, 5) & whole("photos", 0)


def normalise_reviews(raw: DataFrame) -> DataFrame:
    """Ids, original text, script hints and owner responses; invalid rows dropped.

    A rating of 0 (unreadable stars) is valid and stays. Columns of ``raw`` that
    are no part of a review (place, round, position, ..) pass through.
    """
    return _shaped(raw.filter(_valid(raw))).withColumns(
        {"rating": F.col("rating").cast("int"), "photos": F.col("photos").cast("int")}
    )


def rejected_reviews(raw: DataFrame) -> DataFrame:
    """The rows ``normalise_reviews`` drops, with their ``issues``."""
    return _shaped(raw).withColumn("issues", _issues()).filter(F.size("issues") > 0)


def review_issue_rows(raw: DataFrame, *keys: str) -> DataFrame:
    """One row per broken rule of a typed review row: keys, path and code."""
    issues = raw.select(*keys, F.explode_outer(_issues()).alias("issue"))
    return issues.filter(F.col("issue").isNotNull()).select(*keys, "issue.*")
