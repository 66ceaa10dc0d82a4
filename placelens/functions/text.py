"""Text columns shared by several jobs. Built-in expressions only."""

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelens import fixed_values as V

# White space as the source of the data understands it: wider than ASCII `\s`,
# and much wider than what `F.trim` strips.
SPACE_CHARS = (
    r"\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
SPACE = f"[{SPACE_CHARS}]"
SPACE_LIST = "\t\n\v\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    map(chr, range(0x2000, 0x200B))
)
ASTRAL = r"[\x{10000}-\x{10ffff}]"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_LIST))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, or null where the pattern does not match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _kept_chars(c: Column, dropped: str) -> Column:
    return F.length(F.regexp_replace(c, dropped, ""))


def script_hint(c: Column) -> Column:
    """``arabic``, ``english``, ``mixed``, ``unknown``, or null for no text.

    A script hint by letter counts, not language identification: a tie is the
    only way to ``mixed``, and accented letters do not count. Each count scans
    the text once; only the sign of their difference is needed.
    """
    arabic = _kept_chars(c, r"[^\x{0600}-\x{06ff}]+")
    latin = _kept_chars(c, "[^a-zA-Z]+")
    tie = F.when(c.rlike("[a-zA-Z]"), "mixed").otherwise("unknown")
    side = F.signum(latin - arabic).cast("int") + 2
    return F.when(c != "", F.elt(side, F.lit("arabic"), tie, F.lit("english")))


def csv_cell(c: Column) -> Column:
    """A cell no spreadsheet will run as a formula, quoted where needed."""
    safe = F.when(c.rlike(r"\A[=+\-@]"), F.concat(F.lit("\t"), c)).otherwise(c)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(safe.rlike('[,"\n\t]'), quoted).otherwise(safe), F.lit(""))


def file_slug(name: Column) -> Column:
    """File-name stem; names without ASCII letters or digits get a hash stem."""
    slug = F.regexp_replace(F.lower(name), "'", "")
    slug = F.regexp_replace(slug, "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, r"\A-+|-+\z", "")
    hashed = F.substring(F.sha2(name, 256), 1, V.SLUG_HASH_HEX_CHARS)
    return F.coalesce(F.nullif(slug, F.lit("")), hashed)


_MASKED_ASCII = "".join(
    chr(i) for i in range(128) if chr(i) not in string.digits + ",.\t\n\v\f\r kmbreviwsKMBREVIWS"
)
_MASKED_WIDE = (
    r"[\x{80}-\x{9f}\x{a1}-\x{b6}\x{b8}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}"
    r"\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{fefe}\x{ff00}-\x{ffff}]"
)


def masked(c: Column) -> Column:
    """Text safe to share: what a count parser looks at stays, the rest is dots.

    Characters beyond the basic plane become two dots, one per UTF-16 unit.
    ASCII goes through a lookup; the slower pattern runs only on other text.
    """
    wide = F.regexp_replace(F.regexp_replace(c, ASTRAL, "··"), _MASKED_WIDE, "·")
    text = F.when(c.rlike(r"[^\x00-\x7f]"), wide).otherwise(c)
    return F.when(c != "", F.translate(text, _MASKED_ASCII, "·" * len(_MASKED_ASCII)))


def utf16_prefix(c: Column, units: int) -> Column:
    """First ``units`` UTF-16 units; half a surrogate pair becomes U+FFFD."""
    short = F.left(c, F.lit(units))
    cut = F.substring(F.encode(short, "UTF-16BE"), 1, 2 * units)
    last_unit = F.substring(F.hex(cut), 4 * units - 3, 2)
    whole = F.decode(F.substring(cut, 1, 2 * units - 2), "UTF-16BE")
    exact = F.when(
        last_unit.between("D8", "DB"), F.concat(whole, F.lit("\ufffd"))
    ).otherwise(F.decode(cut, "UTF-16BE"))
    return F.when(short.rlike(ASTRAL), exact).otherwise(short)


def strict_json(text: Column) -> Column:
    """The text as VARIANT; null unless all of it is one JSON value.

    The parser stops after the first value. Read once as an array's item and once
    as an object's member, a value must be followed by both closing marks, which
    only the added ones can be.
    """
    item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(item.isNotNull(), F.try_variant_get(member, "$.v", "variant"))
