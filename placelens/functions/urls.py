"""Location-input and page-URL columns. Built-in expressions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens import fixed_values as V
from placelens.functions.text import first_group

REPLACEMENT = "\ufffd"


def location_kind(trimmed_input: Column) -> Column:
    """Kind of a trimmed location input, null when it is none of the five.

    The top-level-domain class of the patterns also admits hosts such as
    ``google.example.com``; kept as is, since results depend on it.
    """
    return (
        F.when(trimmed_input.rlike(V.PLACE_ID_PATTERN), "place_id")
        .when(trimmed_input.rlike(V.SHORT_URL_PATTERN), "short")
        .when(trimmed_input.rlike(V.LONG_URL_PATTERN), "long")
        .when(trimmed_input.rlike(V.CID_URL_PATTERN), "cid")
        .when(trimmed_input.rlike(V.FTID_URL_PATTERN), "ftid")
    )


def percent_decoded(url: Column) -> Column:
    """Decoded text, or the text itself when it is not valid percent-encoding.

    Java decodes bytes that are not UTF-8 to U+FFFD where a strict decoder
    fails, so a replacement character that the input did not ask for counts as
    a failure.
    """
    decoded = F.try_url_decode(url)
    invented = decoded.contains(REPLACEMENT) & ~(
        url.contains(REPLACEMENT) | F.lower(url).contains("%ef%bf%bd")
    )
    return F.when(decoded.isNull() | invented, url).otherwise(decoded)


def place_id_in_url(url: Column) -> Column:
    text = percent_decoded(url)
    return F.coalesce(
        first_group(text, V.FTID_VALUE_PATTERN), first_group(text, V.DATA_TOKEN_PATTERN)
    )


def needs_locale_fix(url: Column) -> Column:
    return ~url.contains(f"{V.LOCALE_PARAM}={V.LOCALE_VALUE}")


def is_verifiable_place_id(place_id: Column) -> Column:
    return F.coalesce(place_id.startswith("0x"), F.lit(False))


def place_ids_match(expected: Column, actual: Column) -> Column:
    """No expectation matches anything; an expectation needs an equal id."""
    return (
        F.when(F.coalesce(expected, F.lit("")) == "", True)
        .when(F.coalesce(actual, F.lit("")) == "", False)
        .otherwise(F.lower(expected) == F.lower(actual))
    )


def _form_decoded(c: Column) -> Column:
    # Stray percent signs are literal in form data: escape them, then decode.
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _escaped(c: Column, unsafe: str) -> Column:
    """Percent-encodes only the characters matching ``unsafe``."""
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    one = lambda ch: F.when(ch == " ", "%20").when(ch.rlike(unsafe), F.url_encode(ch)).otherwise(ch)
    return F.when(c.rlike(unsafe), F.array_join(F.transform(chars, one), "")).otherwise(c)


_URL = r"(?s)\A([A-Za-z]+)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(#.*)?\z"


def canonical_urls(df: DataFrame, url: str, out: str) -> DataFrame:
    """Adds ``out``: the URL in the English locale, without tracking parameters.

    The query is rewritten as form data: order kept, first locale parameter
    replaced, further ones removed, appended last when absent. Short links and
    texts that are not http(s) URLs pass unchanged. Scheme and host are
    lower-cased and default ports dropped; dot segments are left alone.

    Works in steps on the table, so that each part is taken out of the URL once.
    """
    text, c = F.trim(F.col(url)), F.col
    part = lambda g: F.regexp_extract(text, _URL, g)
    parts = df.withColumns(
        {
            "_scheme": F.lower(part(1)),
            "_host": F.regexp_replace(F.lower(part(2)), r":\z", ""),
            "_path": part(3),
            "_pairs": F.filter(F.split(part(4), "&"), lambda p: p != ""),
            "_fragment": part(5),
        }
    )
    decoded = parts.withColumns(
        {
            "_names": F.transform(
                "_pairs", lambda p: _form_decoded(F.split_part(p, F.lit("="), F.lit(1)))
            ),
            "_values": F.transform(
                "_pairs", lambda p: _form_decoded(F.regexp_replace(p, r"(?s)\A[^=]*=?", ""))
            ),
        }
    )
    locale_pair = f"{V.LOCALE_PARAM}={V.LOCALE_VALUE}"
    at = c("_locale_at")

    def written(name, i):
        pair = F.concat(F.url_encode(name), F.lit("="), F.url_encode(F.get("_values", i)))
        return (
            F.when(name.isin(*V.TRACKING_PARAMS), None)
            .when(name != V.LOCALE_PARAM, pair)
            .when(i == at - 1, locale_pair)
        )

    located = decoded.withColumn("_locale_at", F.array_position("_names", V.LOCALE_PARAM)).withColumn(
        "_query", F.array_join(F.array_compact(F.transform("_names", written)), "&")
    )
    port = F.when(c("_scheme") == "https", r":443\z").otherwise(r":80\z")
    joint = F.when(c("_query") == "", "").otherwise("&")
    query = F.when(at == 0, F.concat(c("_query"), joint, F.lit(locale_pair))).otherwise(c("_query"))
    path = F.when(c("_path") == "", "/").otherwise(_escaped(c("_path"), r"[^!-~]|[\"<>`{}]"))
    rewritten = F.concat(
        c("_scheme"), F.lit("://"), F.regexp_replace(c("_host"), port, F.lit("")), path,
        F.lit("?"), query, _escaped(c("_fragment"), r"[^!-~]|[\"<>`]"),
    )
    kept = c(url).contains(V.SHORT_URL_HOST) | ~text.rlike(r"(?i)\Ahttps?://[^/?#\s:]+")
    return located.withColumn(out, F.when(kept, c(url)).otherwise(rewritten)).drop(
        "_scheme", "_host", "_path", "_pairs", "_fragment", "_names", "_values", "_locale_at", "_query"
    )
