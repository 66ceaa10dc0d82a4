"""Schema rules on raw result documents, in one pass without a shuffle.

A typed read turns a text "5" into a null or a number; rules on raw types need
the JSON as it is, so documents are parsed to VARIANT and every field is looked
at once. Issue codes: ``unreadable``, ``json``, ``required``, ``type``,
``not_integer``, ``too_small``, ``too_big``, ``enum``.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens import fixed_values as V
from placelens.functions.text import strict_json
from placelens.session import last_of_repeated_keys


class Rule(NamedTuple):
    name: str
    kind: str  # string, number, integer
    nullable: bool = False
    optional: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


BUSINESS_RULES = (
    Rule("name", "string"),
    Rule("placeId", "string", nullable=True),
    Rule("url", "string"),
    Rule("address", "string", nullable=True),
    Rule("rating", "number", nullable=True),
    Rule("totalReviews", "integer", nullable=True, low=0),
    Rule("headerTotalReviews", "integer", nullable=True, optional=True, low=0),
    Rule("scrapeDate", "string"),
)
METADATA_RULES = (
    Rule("provider", "string", choices=V.PROVIDERS),
    Rule("scrapeDurationMs", "number"),
    Rule("reviewsCollected", "integer"),
    Rule("sortOrder", "string", choices=V.SORT_ORDERS),
)
REVIEW_RULES = (
    Rule("id", "string"),
    Rule("author", "string"),
    Rule("authorUrl", "string", nullable=True),
    Rule("publishTime", "string"),
    Rule("rating", "integer", low=0, high=5),
    Rule("text", "string", nullable=True),
    Rule("originalText", "string", nullable=True),
    Rule("originalLanguage", "string", nullable=True),
    Rule("photos", "integer", low=0),
)
RESPONSE = "ownerResponse"
RESPONSE_RULES = (
    Rule("text", "string", nullable=True),
    Rule("originalText", "string", nullable=True),
    Rule("originalLanguage", "string", nullable=True),
    Rule("publishTime", "string", nullable=True),
)
ISSUE_TYPE = "array<struct<path:string,code:string>>"


def _get(parent: Column, name: str, as_type: str) -> Column:
    return F.try_variant_get(parent, f"$.{name}", as_type)


def _type_of(parent: Column, name: str) -> Column:
    """JSON type of a member: null when missing, VOID for a JSON null."""
    return F.schema_of_variant(_get(parent, name, "variant"))


def _facts(parent: Column, rules) -> list[Column]:
    """What the rules need to know of each member, looked up once."""
    out = []
    for r in rules:
        out.append(_type_of(parent, r.name).alias(f"{r.name}_type"))
        if r.kind == "integer":
            out.append(_get(parent, r.name, "double").alias(f"{r.name}_value"))
        elif r.choices:
            out.append(_get(parent, r.name, "string").alias(f"{r.name}_value"))
    return out


def _code(facts: Column, r: Rule) -> Column:
    kind = facts[f"{r.name}_type"]
    right_type = (
        kind == "STRING" if r.kind == "string" else kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    )
    code = F.when(kind.isNull(), F.lit(None if r.optional else "required"))
    code = code.when(kind == "VOID", F.lit(None if r.nullable else "type"))
    code = code.when(~right_type, "type")
    if r.kind == "integer":
        value = facts[f"{r.name}_value"]
        code = code.when(value != F.floor(value), "not_integer")
        if r.low is not None:
            code = code.when(value < r.low, "too_small")
        if r.high is not None:
            code = code.when(value > r.high, "too_big")
    if r.choices:
        code = code.when(~facts[f"{r.name}_value"].isin(*r.choices), "enum")
    return code


def _issues(facts: Column, rules, prefix: Column) -> Column:
    checked = [
        F.struct(F.concat(prefix, F.lit(r.name)).alias("path"), _code(facts, r).alias("code"))
        for r in rules
    ]
    return F.filter(F.array(*checked), lambda x: x["code"].isNotNull())


def _one(path: Column, code: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(code).alias("code"))).cast(ISSUE_TYPE)


def _object_issues(kind: Column, path: Column, members: Column, nullable: bool = False) -> Column:
    """A missing or wrong parent is one issue, without issues of its members."""
    none = F.array().cast(ISSUE_TYPE)
    return (
        F.when(kind.isNull(), _one(path, "required"))
        .when(kind == "VOID", none if nullable else _one(path, "type"))
        .when(~kind.startswith("OBJECT"), _one(path, "type"))
        .otherwise(members.cast(ISSUE_TYPE))
    )


def _review_facts(review: Column) -> Column:
    response = _get(review, RESPONSE, "variant")
    return F.struct(
        F.schema_of_variant(review).alias("kind"),
        F.struct(*_facts(review, REVIEW_RULES)).alias("own"),
        _type_of(review, RESPONSE).alias("response_kind"),
        F.struct(*_facts(response, RESPONSE_RULES)).alias("response"),
    )


def _review_issues(facts: Column, index: Column) -> Column:
    path = F.concat(F.lit("reviews."), index.cast("string"))
    prefix = F.concat(path, F.lit("."))
    response_path = F.concat(prefix, F.lit(RESPONSE))
    response = _object_issues(
        facts["response_kind"],
        response_path,
        _issues(facts["response"], RESPONSE_RULES, F.concat(response_path, F.lit("."))),
        nullable=True,
    )
    own = _issues(facts["own"], REVIEW_RULES, prefix).cast(ISSUE_TYPE)
    return _object_issues(facts["kind"], path, F.concat(own, response))


def check_documents(documents: DataFrame, text: str = "value") -> DataFrame:
    """Adds ``name``, ``review_count`` and ``issues`` to raw JSON documents."""
    raw, doc = F.col(text), F.col("_doc")
    business, metadata = _get(doc, "business", "variant"), _get(doc, "metadata", "variant")
    with last_of_repeated_keys(documents.sparkSession):
        parsed = documents.withColumn("_doc", strict_json(raw))
    looked_up = parsed.withColumns(
        {
            "_is_object": F.substring(F.ltrim(F.regexp_replace(raw, r"\A\s+", "")), 1, 1) == "{",
            "_business_kind": _type_of(doc, "business"),
            "_business": F.struct(*_facts(business, BUSINESS_RULES)),
            "_metadata_kind": _type_of(doc, "metadata"),
            "_metadata": F.struct(*_facts(metadata, METADATA_RULES)),
            "_reviews_present": _get(doc, "reviews", "variant").isNotNull(),
            "_reviews": F.transform(_get(doc, "reviews", "array<variant>"), _review_facts),
            "name": F.try_variant_get(doc, "$.business.name", "string"),
        }
    )
    reviews = (
        F.when(~F.col("_reviews_present"), _one(F.lit("reviews"), "required"))
        .when(F.col("_reviews").isNull(), _one(F.lit("reviews"), "type"))
        .otherwise(F.flatten(F.transform("_reviews", _review_issues)))
    )
    members = F.concat(
        _object_issues(
            F.col("_business_kind"),
            F.lit("business"),
            _issues(F.col("_business"), BUSINESS_RULES, F.lit("business.")),
        ),
        reviews,
        _object_issues(
            F.col("_metadata_kind"),
            F.lit("metadata"),
            _issues(F.col("_metadata"), METADATA_RULES, F.lit("metadata.")),
        ),
    )
    issues = (
        F.when(raw.isNull(), _one(F.lit(""), "unreadable"))
        .when(doc.isNull(), _one(F.lit(""), "json"))
        .when(~F.col("_is_object"), _one(F.lit(""), "type"))
        .otherwise(members)
    )
    count = F.coalesce(F.size("_reviews"), F.lit(0)).cast("bigint")
    return looked_up.withColumns({"review_count": count, "issues": issues}).select(
        *documents.columns, "name", "review_count", "issues"
    )


def validate_documents(documents: DataFrame, *keys: str, text: str = "value") -> DataFrame:
    """One row per broken rule: keys, dotted path and code.

    The outer explode keeps the optimizer from adding a filter on the array
    below it, which would work out all rules once more per condition.
    """
    return (
        check_documents(documents, text)
        .select(*keys, F.explode_outer("issues").alias("issue"))
        .filter(F.col("issue").isNotNull())
        .select(*keys, "issue.*")
    )


def document_summary(documents: DataFrame, *keys: str, text: str = "value") -> DataFrame:
    """Per document: valid or not, name, number of reviews and of issues."""
    issue_count = F.size("issues").cast("bigint")
    return check_documents(documents, text).select(
        *keys, "name", "review_count", issue_count.alias("issue_count"),
        (issue_count == 0).alias("valid"),
    )
