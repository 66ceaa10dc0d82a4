"""Columns of one review row. Built-in expressions only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelens import fixed_values as V
from placelens.functions.text import script_hint, trimmed, utf16_prefix

_MAX_LONG = 9223372036854775807


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def card_rating(label: Column) -> Column:
    """First digit run of the stars label; 0 says the stars were unreadable.

    A run too long for a BIGINT stays out of range rather than becoming 0.
    """
    digits = F.regexp_extract(F.coalesce(label, F.lit("")), "([0-9]+)", 1)
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(
        F.coalesce(digits.try_cast("bigint"), F.lit(_MAX_LONG))
    )


def trimmed_or(c: Column, default: str) -> Column:
    return F.coalesce(trimmed(c), F.lit(default))


def trimmed_or_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def review_id(given: Column, author: Column, time: Column, rating: Column, text: Column) -> Column:
    """The given id, or a hash of author, time, rating and the start of the text.

    The time text is relative ("a week ago"), so hash ids are not stable over
    time. Missing parts are written as ``null``; such rows are invalid anyway.
    """
    prefix = F.coalesce(utf16_prefix(text, V.ID_TEXT_PREFIX_UNITS), F.lit(""))
    parts = [F.coalesce(c, F.lit("null")) for c in (author, time, rating.cast("string"))]
    source = F.concat_ws("|", *parts, prefix)
    hashed = F.substring(F.sha2(source, 256), 1, V.ID_HEX_CHARS)
    return F.when(blank(given), hashed).otherwise(given)


def resolved_original(text: Column, original: Column) -> Column:
    return F.when(blank(original) & ~blank(text), text).otherwise(original)


def original_hint(text: Column, original: Column) -> Column:
    """Script hint of the resolved original; none when there is no text."""
    return F.when(~blank(text), script_hint(resolved_original(text, original)))


def owner_response(text: Column, time: Column) -> Column:
    return F.when(
        ~blank(text),
        F.struct(
            text.alias("text"),
            text.alias("originalText"),
            script_hint(text).alias("originalLanguage"),
            F.nullif(time, F.lit("")).alias("publishTime"),
        ),
    )


def review_issues(id_: Column, author: Column, time: Column, rating: Column, photos: Column) -> Column:
    """``ARRAY<STRUCT<path, code>>`` of the broken rules of a typed row."""

    def issue(path, code, broken):
        return F.when(broken, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code")))

    def required(path, c):
        return issue(path, "required", c.isNull())

    def whole(path, c):
        return issue(path, "not_integer", c.cast("double") != F.floor(c.cast("double")))

    return F.array_compact(
        F.array(
            required("id", id_),
            required("author", author),
            required("publishTime", time),
            required("rating", rating),
            whole("rating", rating),
            issue("rating", "too_small", rating < 0),
            issue("rating", "too_big", rating > 5),
            required("photos", photos),
            whole("photos", photos),
            issue("photos", "too_small", photos < 0),
        )
    )
