"""Review rows: normalise, first copies, caps, orders, documents, exports, validation."""

from pyspark.sql import functions as F

from checks import bindings as B
from checks.registry import query
from placelens import fixed_values as V
from placelens.functions import headers, text
from placelens.functions import reviews as R
from placelens.operators import assemble, collect, quality, validation
from placelens.operators.reviews import normalise_reviews, rejected_reviews, review_issue_rows
from placelens.session import scratch_path, staged
from placelens.sinks import writers
from placelens.sources import readers

FLAT = ["place_key", "round", "pos", "review_id", "author", "author_url", "publish_time", "rating",
        "text", "original_text", "original_language", "photos"]
RESPONSE = {"response_text": "text", "response_language": "originalLanguage", "response_time": "publishTime"}


def _raw(t):
    return t.sql(B.RAW_REVIEWS).drop("conv_id", "turn")


def _flat(df, *names):
    response = {n: F.col(f"owner_response.{f}").alias(n) for n, f in RESPONSE.items()}
    return df.select(*[response.get(n, n) for n in names])


def _cast(columns):
    return ", ".join(
        f"CAST({c} AS INTEGER) AS {c}" if c in ("rating", "photos") else c for c in columns
    )


# --- columns of a review row -------------------------------------------------
@query("review_ids", B.with_views("SELECT place_key, round, pos, review_id FROM shaped", **B.REVIEW_VIEWS))
def review_ids(t):
    c = F.col
    id_ = R.review_id(c("review_id"), c("author"), c("publish_time"), c("rating"), c("text"))
    return _raw(t).select("place_key", "round", "pos", id_.alias("review_id"))


@query(
    "script_hint",
    B.with_views(f"SELECT doc_id, {B.hint('mixed')} AS hint FROM texts", texts=B.TEXTS),
)
def script_hint(t):
    return t.sql(B.TEXTS).select("doc_id", text.script_hint(F.col("mixed")).alias("hint"))


@query(
    "resolve_original_text",
    B.with_views(
        "SELECT place_key, round, pos, original_text, original_language FROM shaped", **B.REVIEW_VIEWS
    ),
)
def resolve_original_text(t):
    body, original = F.col("text"), F.col("original_text")
    return _raw(t).select(
        "place_key", "round", "pos",
        R.resolved_original(body, original).alias("original_text"),
        R.original_hint(body, original).alias("original_language"),
    )


@query(
    "owner_response_struct",
    B.with_views(
        "SELECT place_key, round, pos, response_text, response_language, response_time FROM shaped",
        **B.REVIEW_VIEWS,
    ),
)
def owner_response_struct(t):
    response = R.owner_response(F.col("owner_response_text"), F.col("owner_response_time"))
    shaped = _raw(t).withColumn("owner_response", response)
    return _flat(shaped, "place_key", "round", "pos", *RESPONSE)


@query(
    "normalise_reviews",
    B.with_views(f"SELECT {_cast(FLAT)}, response_text, response_language, response_time FROM valid", **B.REVIEW_VIEWS),
)
def normalise(t):
    return _flat(normalise_reviews(_raw(t)), *FLAT, *RESPONSE)


INVALID = "author IS NULL OR rating NOT BETWEEN 0 AND 5 OR photos < 0"


@query(
    "drop_invalid_reviews",
    B.with_views(
        f"""SELECT place_key, round, pos, review_id, CAST((author IS NULL)::INT + (rating < 0)::INT
        + (rating > 5)::INT + (photos < 0)::INT AS INTEGER) AS issue_count FROM shaped WHERE {INVALID}""",
        **B.REVIEW_VIEWS,
    ),
)
def drop_invalid_reviews(t):
    return rejected_reviews(_raw(t)).select(
        "place_key", "round", "pos", "review_id", F.size("issues").alias("issue_count")
    )


@query(
    "validate_reviews",
    B.with_views(
        """SELECT place_key, round, pos, 'author' AS path, 'required' AS code FROM raw_reviews WHERE author IS NULL
        UNION ALL SELECT place_key, round, pos, 'rating', 'too_small' FROM raw_reviews WHERE rating < 0
        UNION ALL SELECT place_key, round, pos, 'rating', 'too_big' FROM raw_reviews WHERE rating > 5
        UNION ALL SELECT place_key, round, pos, 'photos', 'too_small' FROM raw_reviews WHERE photos < 0""",
        **B.REVIEW_VIEWS,
    ),
)
def validate_reviews(t):
    return review_issue_rows(_raw(t), "place_key", "round", "pos")


# --- first copies, caps, orders ----------------------------------------------
@query(
    "dedup_first_seen",
    B.with_views(f"SELECT {_cast(FLAT)}, response_text FROM first_seen", **B.REVIEW_VIEWS),
)
def dedup_first_seen(t):
    kept = collect.dedup_first_seen(normalise_reviews(_raw(t)))
    return _flat(kept, *FLAT, "response_text")


SCAN_VIEWS = {
    "scan_rows": B.SCAN_ROWS,
    "seen": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY place_key, review_id
      ORDER BY round, pos, rating) AS rn FROM scan_rows) WHERE rn = 1""",
}
SCAN_ORDER = "round, pos, review_id"


def _ranked(order, n=None, columns="place_key, review_id, ordinal"):
    top = "" if n is None else f" WHERE ordinal <= {n}"
    return B.with_views(
        f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY place_key ORDER BY {order})
        AS ordinal FROM seen){top}""",
        **SCAN_VIEWS,
    )


def _seen(t, stored=False):
    seen = collect.dedup_first_seen(t.sql(B.SCAN_ROWS))
    return staged(seen, "seen") if stored else seen


@query(
    "dedup_scan_rows",
    B.with_views("SELECT place_key, review_id, round, pos, rating FROM seen", **SCAN_VIEWS),
)
def dedup_scan_rows(t):
    return _seen(t).select("place_key", "review_id", "round", "pos", "rating")


@query("cap_per_location", _ranked(SCAN_ORDER, 10))
def cap_per_location(t):
    return collect.cap_per_location(_seen(t), 10).select("place_key", "review_id", "ordinal")


@query("cap_per_location_large", _ranked(SCAN_ORDER, 1500))
def cap_per_location_large(t):
    """A cap large enough for the blockwise rank to take over."""
    return collect.cap_per_location(_seen(t, stored=True), 1500).select("place_key", "review_id", "ordinal")


@query("order_reviews", _ranked(f"rating DESC, {SCAN_ORDER}"))
def order_reviews(t):
    return collect.order_reviews(_seen(t, stored=True), "highest").select("place_key", "review_id", "ordinal")


@query("order_reviews_newest", _ranked(SCAN_ORDER))
def order_reviews_newest(t):
    return collect.order_reviews(_seen(t, stored=True), "newest").select("place_key", "review_id", "ordinal")


@query("top_n_reviews", _ranked(f"rating, {SCAN_ORDER}", 5, "place_key, review_id, rating, ordinal"))
def top_n_reviews(t):
    return collect.top_n_reviews(_seen(t), "lowest", 5).select(
        "place_key", "review_id", "rating", "ordinal"
    )


@query(
    "extraction_progress",
    B.with_views(
        """SELECT place_key, round, new_reviews, CAST(sum(new_reviews) OVER (PARTITION BY place_key ORDER BY round) AS BIGINT) AS total_reviews
        FROM (SELECT place_key, round, count(*) AS new_reviews FROM seen GROUP BY ALL)""",
        **SCAN_VIEWS,
    ),
)
def extraction_progress(t):
    return collect.extraction_progress(_seen(t, stored=True)).select(
        "place_key", "round", "new_reviews", "total_reviews"
    )


@query(
    "zero_rating_counts",
    B.with_views(
        "SELECT place_key, round, count(*) AS card_count, CAST(count_if(rating = 0) AS BIGINT) AS zero_rating_count FROM scan_rows GROUP BY ALL",
        **SCAN_VIEWS,
    ),
)
def zero_rating_counts(t):
    return quality.zero_rating_counts(t.sql(B.SCAN_ROWS), "place_key", "round")


# --- documents ---------------------------------------------------------------
HEADERS = """
SELECT DISTINCT CAST(conv_id AS STRING) AS place_key, 'Place ' || (conv_id % 17) AS name,
 '0x' || conv_id || ':0x1' AS place_id, 'https://example.org/p/' || conv_id AS url,
 CASE WHEN conv_id % 2 = 0 THEN conv_id || ' Road' END AS address,
 CASE WHEN conv_id % 3 > 0 THEN (conv_id % 50) / 10.0e0 END AS header_rating,
 CASE WHEN conv_id % 5 > 0 THEN conv_id % 40 END AS header_total_reviews,
 '2025-01-01T00:00:00.000Z' AS scrape_date, conv_id + 0.5e0 AS scrape_duration_ms
FROM conversations
"""
DOC_VIEWS = {
    **B.REVIEW_VIEWS,
    "headers": HEADERS,
    "numbered": "SELECT *, row_number() OVER (PARTITION BY place_key ORDER BY round, pos, review_id) AS ordinal FROM first_seen",
    "counts": "SELECT place_key, count(*) AS n FROM first_seen GROUP BY ALL",
}


def _headers(t):
    return t.sql(HEADERS)


def _first_seen(t):
    return staged(collect.dedup_first_seen(normalise_reviews(_raw(t))), "first-seen")


def _documents(t):
    return assemble.assemble_documents(_headers(t), _first_seen(t), "newest")


@query(
    "collect_reviews",
    B.with_views(
        """SELECT place_key, count(*) AS review_count, string_agg(review_id, ',' ORDER BY ordinal) AS review_ids
        FROM numbered GROUP BY ALL""",
        **DOC_VIEWS,
    ),
)
def collect_reviews(t):
    ids = F.transform("reviews", lambda r: r["id"])
    return assemble.collect_reviews(_first_seen(t)).select(
        "place_key", F.size("reviews").cast("bigint").alias("review_count"), F.array_join(ids, ",").alias("review_ids")
    )


RECONCILED = "SELECT h.*, coalesce(n, 0) AS total_reviews FROM headers h LEFT JOIN counts USING (place_key)"


@query(
    "reconcile_counts",
    B.with_views(f"SELECT place_key, header_total_reviews, total_reviews FROM ({RECONCILED})", **DOC_VIEWS),
)
def reconcile_counts(t):
    reviews = collect.dedup_first_seen(normalise_reviews(_raw(t)))
    return assemble.reconcile_counts(_headers(t), reviews).select(
        "place_key", "header_total_reviews", "total_reviews"
    )


@query(
    "coverage_gap",
    B.with_views(
        f"""SELECT place_key, header_total_reviews, total_reviews,
        header_total_reviews - total_reviews AS coverage_gap FROM ({RECONCILED})""",
        **DOC_VIEWS,
    ),
)
def coverage_gap(t):
    reviews = collect.dedup_first_seen(normalise_reviews(_raw(t)))
    return assemble.coverage_gap(assemble.reconcile_counts(_headers(t), reviews))


ASSEMBLED = f"""SELECT h.place_key, name, place_id, url, address, CAST(header_rating AS DOUBLE) AS rating, total_reviews,
 header_total_reviews, CAST(scrape_duration_ms AS DOUBLE) AS scrape_duration_ms, 'newest' AS sort_order, coalesce(review_ids, '') AS review_ids,
 coalesce(response_count, 0) AS response_count
FROM ({RECONCILED}) h LEFT JOIN (SELECT place_key, string_agg(review_id, ',' ORDER BY ordinal) AS review_ids,
 count(response_text) AS response_count FROM numbered GROUP BY ALL) r USING (place_key)"""


def _document_rows(docs):
    ids = F.transform("reviews", lambda r: r["id"])
    responses = F.filter("reviews", lambda r: r["ownerResponse"].isNotNull())
    return docs.select(
        "place_key", "business.name", F.col("business.placeId").alias("place_id"), "business.url",
        "business.address", "business.rating", F.col("business.totalReviews").alias("total_reviews"),
        F.col("business.headerTotalReviews").alias("header_total_reviews"),
        F.col("metadata.scrapeDurationMs").alias("scrape_duration_ms"),
        F.col("metadata.sortOrder").alias("sort_order"),
        F.array_join(ids, ",").alias("review_ids"),
        F.size(responses).cast("bigint").alias("response_count"),
    )


@query("assemble_documents", B.with_views(ASSEMBLED, **DOC_VIEWS))
def assemble_documents(t):
    return _document_rows(_documents(t))


# --- exports -----------------------------------------------------------------
def _cell(c):
    safe = f"(CASE WHEN regexp_matches({c}, '^[=+\\-@]') THEN chr(9) || {c} ELSE {c} END)"
    return (
        f"coalesce(CASE WHEN regexp_matches({safe}, '[,\"\\n\\t]') THEN '\"' || replace({safe}, '\"', '\"\"') || '\"' "
        f"ELSE {safe} END, '')"
    )


EXPORT = f"""SELECT n.place_key, h.name AS business_name, review_id, author, author_url, CAST(rating AS INTEGER) AS rating, publish_time, text,
 original_text, original_language, CAST(photos AS INTEGER) AS photos, response_text AS owner_response_text,
 response_time AS owner_response_time, ordinal FROM numbered n JOIN headers h USING (place_key)"""
LINE = " || ',' || ".join(c if c in ("rating", "photos") else _cell(c) for c in V.CSV_COLUMNS)
HEADER_LINE = ",".join(V.CSV_COLUMNS)


@query("csv_safe", B.with_views(f"SELECT doc_id, {_cell('cell')} AS cell FROM texts", texts=B.TEXTS))
def csv_safe(t):
    return t.sql(B.TEXTS).select("doc_id", text.csv_cell(F.col("cell")).alias("cell"))


@query(
    "flatten_reviews",
    B.with_views(f"SELECT place_key, {', '.join(V.CSV_COLUMNS)} FROM ({EXPORT})", **DOC_VIEWS),
)
def flatten_reviews(t):
    return writers.flatten_reviews(_documents(t), "place_key")


@query("csv_lines", B.with_views(f"SELECT place_key, {LINE} AS line FROM ({EXPORT})", **DOC_VIEWS))
def csv_lines(t):
    return writers.csv_lines(writers.flatten_reviews(_documents(t), "place_key"), "place_key")


@query(
    "write_reviews_csv",
    B.with_views(
        "SELECT " + ", ".join(
            f"CAST({c} AS VARCHAR) AS {c}" if c in ("rating", "photos")
            else f"nullif(CASE WHEN regexp_matches({c}, '^[=+\\-@]') THEN chr(9) || {c} ELSE {c} END, '') AS {c}"
            for c in V.CSV_COLUMNS
        ) + f" FROM ({EXPORT})",
        **DOC_VIEWS,
    ),
)
def write_reviews_csv(t):
    """Writes the CSV table and reads it back."""
    path = scratch_path(t.spark, "csv")
    writers.write_reviews_csv(_documents(t), path)
    return (
        t.spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .schema(", ".join(f"{c} string" for c in V.CSV_COLUMNS)).csv(path)
    )


def _files(t, fmt, headers, reviews):
    """Folder with one file for each location."""
    path = scratch_path(t.spark, f"out-{fmt}")
    lines = assemble.document_lines(headers, reviews, "newest", fmt)
    writers.write_files(lines.withColumn("file_stem", F.concat(F.lit("p-"), F.col("place_key"))), path)
    return path


def _written(t, fmt):
    """One file for each location, read back whole."""
    return t.spark.read.text(_files(t, fmt, _headers(t), _first_seen(t)), wholetext=True)


# Locations of more than 5,000 reviews, already at the smallest scale.
LARGE_REVIEWS = """
SELECT 'all' AS place_key, CAST(l_orderkey % 50 AS INT) AS round, CAST(0 AS INT) AS pass_no, l_orderkey AS pos,
 'r' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS review_id, 'A "' || l_suppkey || '", B' AS author, CAST(NULL AS STRING) AS author_url,
 'a week ago' AS publish_time, CAST(l_quantity AS INT) % 6 AS rating, CASE l_linenumber % 3 WHEN 0 THEN '=' || l_returnflag WHEN 1 THEN '' ELSE 'left ' || l_orderkey END AS text,
 CAST(NULL AS STRING) AS original_text, l_linenumber % 4 AS photos, CASE WHEN l_linenumber % 2 = 0 THEN 'Thanks' END AS owner_response_text,
 'a day ago' AS owner_response_time FROM lineitem
UNION ALL SELECT 'n' || n_nationkey, 0, 0, 0, 'r' || n_nationkey, n_name, NULL, 'now', 5, n_name, NULL, 0, NULL, NULL FROM nation WHERE n_nationkey < 20
"""
LARGE_HEADERS = """
SELECT place_key, 'Place ' || place_key AS name, CAST(NULL AS STRING) AS place_id, 'u' AS url, CAST(NULL AS STRING) AS address, CAST(4.5 AS DOUBLE) AS header_rating,
 CAST(9 AS BIGINT) AS header_total_reviews, '2025-01-01T00:00:00.000Z' AS scrape_date, CAST(1500 AS BIGINT) AS scrape_duration_ms
FROM (SELECT 'all' AS place_key UNION ALL SELECT 'n' || n_nationkey FROM nation)
"""


def _json_text(c):
    return f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"


LARGE_VIEWS = {
    "raw_reviews": LARGE_REVIEWS.replace("STRING", "VARCHAR"), "headers": LARGE_HEADERS.replace("STRING", "VARCHAR"), "shaped": B.SHAPED, "numbered": """
 SELECT *, row_number() OVER (PARTITION BY place_key ORDER BY round, pos, review_id) AS ordinal, count(*) OVER (PARTITION BY place_key) AS n FROM shaped""",
    "totals": "SELECT h.*, coalesce(n, 0) AS total FROM headers h LEFT JOIN (SELECT DISTINCT place_key, n FROM numbered) USING (place_key)",
}
_FIELDS = {"id": "review_id", "author": "author", "authorUrl": "author_url", "publishTime": "publish_time", "rating": "rating", "text": "text",
           "originalText": "original_text", "originalLanguage": "original_language", "photos": "photos"}
_RESPONSE = {"text": "response_text", "originalText": "response_text", "originalLanguage": "response_language", "publishTime": "response_time"}


def _lines_of(fields, pad):
    return " || ',' || chr(10) || ".join(f"'{pad}\"{k}\": ' || {_json_text(c)}" for k, c in fields.items())


LARGE_JSON = f"""SELECT place_key, 0 AS section, 0 AS ordinal, concat('{{', chr(10), '  "business": {{', chr(10), {_lines_of({"name": "name", "placeId": "place_id", "url": "url", "address": "address", "rating": "header_rating", "totalReviews": "total", "headerTotalReviews": "header_total_reviews", "scrapeDate": "scrape_date"}, "    ")},
 chr(10), '  }},', chr(10), '  "reviews": [', CASE WHEN total = 0 THEN '],' ELSE '' END) AS line FROM totals
UNION ALL SELECT place_key, 1, ordinal, concat('    {{', chr(10), {_lines_of(_FIELDS, "      ")}, ',', chr(10), '      "ownerResponse": ',
 CASE WHEN response_text IS NULL THEN 'null' ELSE concat('{{', chr(10), {_lines_of(_RESPONSE, "        ")}, chr(10), '      }}') END, chr(10), '    }}', CASE WHEN ordinal < n THEN ',' ELSE '' END) FROM numbered
UNION ALL SELECT place_key, 2, 0, concat(CASE WHEN total = 0 THEN '' ELSE '  ],' || chr(10) END, '  "metadata": {{', chr(10), '    "provider": "playwright",', chr(10),
 '    "scrapeDurationMs": ', scrape_duration_ms, ',', chr(10), '    "reviewsCollected": ', total, ',', chr(10), '    "sortOrder": "newest"', chr(10), '  }}', chr(10), '}}') FROM totals"""
LARGE_CSV = f"""SELECT place_key, 0 AS section, 0 AS ordinal, '{HEADER_LINE}' AS line FROM headers UNION ALL
SELECT place_key, 1, ordinal, {LINE} FROM (SELECT n.*, h.name AS business_name, response_text AS owner_response_text, response_time AS owner_response_time FROM numbered n JOIN headers h USING (place_key))"""
LARGE_FILES = """SELECT 'p-' || place_key AS file_stem, CAST(1 AS BIGINT) AS files, CAST(sum(length(line) + 1) AS BIGINT) AS chars,
 sha256(string_agg(line || chr(10), '' ORDER BY section, ordinal)) AS content_sha256 FROM ({}) GROUP BY ALL"""


def _large(t, fmt):
    reviews = normalise_reviews(t.sql(LARGE_REVIEWS))
    files = readers.file_digests(t.spark, _files(t, fmt, t.sql(LARGE_HEADERS), reviews))
    stem = F.regexp_extract("source_file", "file_stem=([^/]+)/", 1).alias("file_stem")
    return files.groupBy(stem).agg(F.count("*").alias("files"), F.sum("chars").alias("chars"), F.max("content_sha256").alias("content_sha256"))


@query("write_large_location_json", B.with_views(LARGE_FILES.format(LARGE_JSON), **LARGE_VIEWS))
def write_large_location_json(t):
    """All line items as the reviews of one location: one file, byte by byte."""
    return _large(t, "json")


@query("write_large_location_csv", B.with_views(LARGE_FILES.format(LARGE_CSV), **LARGE_VIEWS))
def write_large_location_csv(t):
    return _large(t, "csv")


@query(
    "write_output_csv_per_location",
    B.with_views(
        f"""SELECT 'p-' || h.place_key AS file_stem, '{HEADER_LINE}' || chr(10) || coalesce(lines, '') AS content
        FROM headers h LEFT JOIN (SELECT place_key, string_agg(line || chr(10), '' ORDER BY ordinal) AS lines
        FROM (SELECT place_key, ordinal, {LINE} AS line FROM ({EXPORT})) GROUP BY ALL) USING (place_key)""",
        **DOC_VIEWS,
    ),
)
def write_output_csv_per_location(t):
    return _written(t, "csv").select("file_stem", F.col("value").alias("content"))


@query(
    "write_output_json_per_location",
    B.with_views(
        f"SELECT 'p-' || place_key AS file_stem, * EXCLUDE (place_key) FROM ({ASSEMBLED})", **DOC_VIEWS
    ),
)
def write_output_json_per_location(t):
    from placelens.schemas import DOCUMENT

    docs = _written(t, "json").select(
        F.col("file_stem").alias("place_key"), F.from_json("value", DOCUMENT).alias("d")
    )
    rows = _document_rows(docs.select("place_key", "d.*"))
    return rows.withColumnRenamed("place_key", "file_stem")


@query("write_documents_json", B.with_views(f"SELECT * EXCLUDE (place_key) FROM ({ASSEMBLED})", **DOC_VIEWS))
def write_documents_json(t):
    path = scratch_path(t.spark, "json")
    writers.write_documents_json(_documents(t), path)
    docs = readers.read_review_documents(t.spark, path, one_per_file=False)
    return _document_rows(docs.withColumn("place_key", F.lit(""))).drop("place_key")


@query(
    "share_safe_table",
    B.with_views(
        "SELECT doc_id, CASE WHEN cell <> '' THEN left(regexp_replace(cell, '[^0-9kKmMbB,."
        + text.SPACE_CHARS + "reviwsREVIWS]', '·', 'g'), 200) END AS cell FROM texts",
        texts=B.TEXTS,
    ),
)
def share_safe_table(t):
    return quality.share_safe_table(t.sql(B.TEXTS).select("doc_id", "cell"), "cell")


@query(
    "mask_for_sharing",
    B.with_views(
        "SELECT doc_id, md5(CASE WHEN text <> '' THEN regexp_replace(text, '[^0-9kKmMbB,."
        + text.SPACE_CHARS + "reviwsREVIWS]', '·', 'g') END) AS masked_md5 FROM documents"
    ),
)
def mask_for_sharing(t):
    return t.table("documents").select("doc_id", F.md5(text.masked(F.col("text"))).alias("masked_md5"))


@query(
    "cap_snippet",
    f"SELECT doc_id, md5(left({B.trim('text')}, {V.BODY_SNIPPET_CHARS})) AS snippet_md5 FROM documents",
)
def cap_snippet(t):
    snippet = F.left(text.trimmed(F.col("text")), F.lit(V.BODY_SNIPPET_CHARS))
    return t.table("documents").select("doc_id", F.md5(snippet).alias("snippet_md5"))


# --- header texts ------------------------------------------------------------
_N = r"[0-9][0-9,\s]*[0-9]|[0-9]"
_T = f"replace(replace(replace(count_text, '{B.NBSP}', ' '), '{B.NNBSP}', ' '), '{B.THIN}', ' ')"
_PRE = rf"regexp_extract({_T}, '(?i)({_N})[^A-Za-z0-9_]*reviews?(?:[^A-Za-z0-9_]|$)', 1)"
_POST = rf"regexp_extract({_T}, '(?i)reviews?[^A-Za-z0-9_]*\s+({_N})', 1)"
COUNT = rf"""CASE WHEN regexp_matches({_T}, '(?i)review') AND NOT regexp_matches({_T}, '[0-9]\s*[kKmMbB]([^A-Za-z0-9_]|$)')
 AND NOT regexp_matches({_T}, '[0-9]\.[0-9]') THEN TRY_CAST(regexp_replace(coalesce(nullif({_PRE}, ''), nullif({_POST}, '')), '[,\s]', '', 'g') AS BIGINT) END"""
_RT = "TRY_CAST(replace(regexp_extract(rating_text, '(?:^|[^-0-9])([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE)"
RATING = f"CASE WHEN {_RT} BETWEEN 0 AND 5 THEN {_RT} END"
PARSED = f"SELECT p_partkey, rating_text, {COUNT} AS value, {RATING} AS header_rating FROM header_texts"


def _header_texts(t):
    return t.sql(B.HEADER_TEXTS)


# Candidates of one page: the texts of three consecutive parts.
CANDIDATES = f"""
SELECT a.p_partkey, a.rating_text, a.count_text AS tab_text, b.count_text AS badge_text, c.count_text AS body_snippet,
 CASE WHEN a.p_partkey % 9 = 0 THEN '{V.UNKNOWN_NAME}' ELSE 'n' END AS name
FROM header_texts a LEFT JOIN header_texts b ON b.p_partkey = a.p_partkey + 1
LEFT JOIN header_texts c ON c.p_partkey = a.p_partkey + 2
"""
CHOSEN = f"""SELECT a.p_partkey, a.header_rating, h.rating_text, h.name, coalesce(a.value, b.value, c.value) AS header_total_reviews,
 CASE WHEN a.value IS NOT NULL THEN 'tabText' WHEN b.value IS NOT NULL THEN 'badgeText' WHEN c.value IS NOT NULL THEN 'bodySnippet' END AS count_source
FROM parsed a JOIN candidates h USING (p_partkey) LEFT JOIN parsed b ON b.p_partkey = a.p_partkey + 1
LEFT JOIN parsed c ON c.p_partkey = a.p_partkey + 2"""
HEADER_VIEWS = {"header_texts": B.HEADER_TEXTS, "parsed": PARSED, "candidates": CANDIDATES, "chosen": CHOSEN}


def _chosen(t):
    from placelens.operators.captures import header_rows

    texts = _header_texts(t)
    pages = t.sql(CANDIDATES, header_texts=texts).withColumn("cards", F.array())
    return header_rows(pages)


@query("parse_review_counts", B.with_views("SELECT p_partkey, value FROM parsed", **HEADER_VIEWS))
def parse_review_counts(t):
    return _header_texts(t).select(
        "p_partkey", headers.review_count(F.col("count_text")).alias("value")
    )


@query(
    "header_counts",
    B.with_views("SELECT p_partkey, header_total_reviews, count_source FROM chosen", **HEADER_VIEWS),
)
def header_counts(t):
    return _chosen(t).select("p_partkey", "header_total_reviews", "count_source")


@query("header_ratings", B.with_views("SELECT p_partkey, header_rating FROM parsed", **HEADER_VIEWS))
def header_ratings(t):
    return _header_texts(t).select(
        "p_partkey", headers.header_rating(F.col("rating_text")).alias("header_rating")
    )


@query(
    "header_quality",
    B.with_views(
        """SELECT count_source, count(*) AS pages,
        CAST(count_if(coalesce(length(rating_text), 0) > 0 AND header_rating IS NULL) AS BIGINT) AS unparsed_ratings,
        CAST(count_if(header_total_reviews IS NULL) AS BIGINT) AS unparsed_counts,
        CAST(count_if(name = 'Unknown') AS BIGINT) AS unknown_names FROM chosen GROUP BY count_source""",
        **HEADER_VIEWS,
    ),
)
def header_quality(t):
    return quality.header_quality(_chosen(t))


@query(
    "first_matching_candidate",
    B.with_views(
        """SELECT CAST(p_partkey // 10 AS BIGINT) AS page_no, arg_min(count_text, p_partkey) AS count_text, min(p_partkey) AS p_partkey
        FROM header_texts WHERE regexp_matches(count_text, '(?i)review') GROUP BY ALL""",
        **HEADER_VIEWS,
    ),
)
def first_matching_candidate(t):
    pages = _header_texts(t).withColumn("page_no", F.expr("p_partkey div 10"))
    return collect.first_matching(
        pages, ["page_no"], "count_text", "p_partkey", F.col("count_text").rlike("(?i)review")
    )


# --- raw documents, with faults ----------------------------------------------
_J = (
    "replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), "
    "chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
)
DOCS_JSON = f"""
SELECT conv_id, turn, CASE WHEN k = 1 THEN '{{not json' WHEN k = 2 THEN '[1, 2]' WHEN k = 3 THEN '{{"foo": "bar"}}'
 WHEN k = 4 THEN NULL ELSE
 '{{' || CASE WHEN k = 31 THEN '"business": 7, "reviews": "x", ' ELSE '' END || '"business": ' || CASE WHEN k = 5 THEN '"x"' ELSE '{{' ||
 CASE WHEN k = 32 THEN '"name": 5, ' ELSE '' END || '"name": ' || CASE WHEN k = 6 THEN 'null' ELSE '"Place ' || conv_id || '"' END ||
 ', "placeId": null, "url": "u", "address": ' || CASE WHEN k = 7 THEN '5' ELSE 'null' END || ', "rating": ' ||
 CASE WHEN k = 8 THEN '"4.5"' WHEN k = 9 THEN '7.25' ELSE '4' END || ', "totalReviews": ' ||
 CASE WHEN k = 10 THEN '-1' WHEN k = 11 THEN '2.5' ELSE '312' END ||
 CASE WHEN k = 12 THEN ', "headerTotalReviews": "1568"' WHEN k = 13 THEN ', "headerTotalReviews": 5.0'
  WHEN k = 14 THEN ', "headerTotalReviews": null' ELSE '' END || ', "scrapeDate": "2025-01-01T00:00:00Z"}}' END ||
 CASE WHEN k = 15 THEN '' WHEN k = 16 THEN ', "reviews": 5' WHEN k = 17 THEN ', "reviews": []' ELSE
 ', "reviews": [{{"id": "r' || turn || '", ' || CASE WHEN k = 18 THEN '' ELSE '"author": "A", ' END || '"authorUrl": null, "publishTime": "t", "rating": '
 || CASE (conv_id + turn) % 9 WHEN 0 THEN '-1' WHEN 1 THEN '6' WHEN 2 THEN '3.5' WHEN 3 THEN '"5"' WHEN 4 THEN 'null' WHEN 5 THEN '5.0' ELSE '0' END ||
 ', "text": "' || {_J.format("text")} || '", "originalText": null, "originalLanguage": ' || CASE WHEN k = 19 THEN '[]' ELSE 'null' END || ', "photos": '
 || CASE WHEN k = 20 THEN '-2' ELSE '3' END || ', "ownerResponse": ' || CASE WHEN k = 21 THEN '"no"' WHEN k = 22 THEN '{{"text": 5, "originalText": null, "originalLanguage": null}}'
 WHEN k = 23 THEN '{{"text": "a", "originalText": "b", "originalLanguage": null, "publishTime": null}}' ELSE 'null' END || '}}, '
 || CASE WHEN k = 24 THEN '7' WHEN k = 25 THEN 'null' ELSE '{{"id": "s", "author": "A", "authorUrl": "x", "publishTime": "t", "rating": 5, "text": null, "originalText": "o", "originalLanguage": "english", "photos": 0, "ownerResponse": null}}' END || ']' END ||
 CASE WHEN k = 26 THEN '' ELSE ', "metadata": {{"provider": "' || CASE WHEN k = 27 THEN 'other' ELSE 'playwright' END || '", "scrapeDurationMs": ' ||
 CASE WHEN k = 28 THEN '-2.5' ELSE '10' END || ', "reviewsCollected": ' || CASE WHEN k = 29 THEN '1.5' ELSE '-3' END || ', "sortOrder": "' ||
 CASE WHEN k = 30 THEN 'random' ELSE 'lowest' END || '"}}' END || '}}' END AS value
FROM (SELECT *, (conv_id * 7 + turn) % 34 AS k FROM conversations )
"""


def _type(path):
    return f"json_type(value, '{path}')"


def _duck_code(r, path):
    t, v = _type(path), f"CAST(json_extract_string(value, '{path}') AS DOUBLE)"
    ok = "('VARCHAR')" if r.kind == "string" else "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
    whens = [
        f"WHEN {t} IS NULL THEN {'NULL' if r.optional else chr(39) + 'required' + chr(39)}",
        f"WHEN {t} = 'NULL' THEN {'NULL' if r.nullable else chr(39) + 'type' + chr(39)}",
        f"WHEN {t} NOT IN {ok} THEN 'type'",
    ]
    if r.kind == "integer":
        whens.append(f"WHEN {v} <> floor({v}) THEN 'not_integer'")
        if r.low is not None:
            whens.append(f"WHEN {v} < {r.low} THEN 'too_small'")
        if r.high is not None:
            whens.append(f"WHEN {v} > {r.high} THEN 'too_big'")
    if r.choices:
        whens.append(f"WHEN json_extract_string(value, '{path}') NOT IN {r.choices + ('',)} THEN 'enum'")
    return f"CASE {' '.join(whens)} END"


def _members(rules, path, prefix, source, condition):
    return [
        f"SELECT conv_id, turn, {prefix} || '{r.name}' AS path, {_duck_code(r, path + '.' + r.name)} AS code FROM {source} WHERE {condition}"
        for r in rules
    ]


def _parent(path, label, source, nullable=False, kind="OBJECT"):
    t = _type(path)
    null_code = "NULL" if nullable else "'type'"
    return (
        f"SELECT conv_id, turn, {label} AS path, CASE WHEN {t} IS NULL THEN 'required' WHEN {t} = 'NULL' THEN {null_code} "
        f"WHEN {t} <> '{kind}' THEN 'type' END AS code FROM {source}"
    )


_OBJ = "{0} = 'OBJECT'"
ISSUES = "SELECT * FROM (" + " UNION ALL ".join(
    [
        "SELECT conv_id, turn, '' AS path, CASE WHEN value IS NULL THEN 'unreadable' WHEN NOT json_valid(value) THEN 'json' "
        "WHEN json_type(value) <> 'OBJECT' THEN 'type' END AS code FROM docs",
        _parent("$.business", "'business'", "objects"),
        *_members(validation.BUSINESS_RULES, "$.business", "'business.'", "objects", _OBJ.format(_type("$.business"))),
        _parent("$.metadata", "'metadata'", "objects"),
        *_members(validation.METADATA_RULES, "$.metadata", "'metadata.'", "objects", _OBJ.format(_type("$.metadata"))),
        _parent("$.reviews", "'reviews'", "objects", kind="ARRAY"),
        _parent("$", "'reviews.' || i", "items"),
        *_members(validation.REVIEW_RULES, "$", "'reviews.' || i || '.'", "items", _OBJ.format(_type("$"))),
        _parent("$.ownerResponse", "'reviews.' || i || '.ownerResponse'", f"(SELECT * FROM items WHERE {_OBJ.format(_type('$'))})", nullable=True),
        *_members(validation.RESPONSE_RULES, "$.ownerResponse", "'reviews.' || i || '.ownerResponse.'", "items", _OBJ.format(_type("$.ownerResponse"))),
    ]
) + ") WHERE code IS NOT NULL"
JSON_VIEWS = {
    # Of a repeated key the last value counts; the other engine takes the first, so it gets the texts without that.
    "docs": f"""SELECT conv_id, turn, replace(replace(value, '"business": 7, "reviews": "x", ', ''), '"name": 5, ', '') AS value
      FROM ({DOCS_JSON})""",
    "objects": "SELECT * FROM docs WHERE CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' ELSE false END",
    "items": """SELECT conv_id, turn, i - 1 AS i, json_extract(value, '$.reviews[' || (i - 1) || ']') AS value
      FROM (SELECT *, unnest(generate_series(1, CAST(json_array_length(value, '$.reviews') AS BIGINT))) AS i FROM objects
      WHERE json_type(value, '$.reviews') = 'ARRAY')""",
    "issues": ISSUES,
}


def _docs(t):
    return t.sql(DOCS_JSON)


@query(
    "validate_documents",
    B.with_views("SELECT conv_id, turn, path, code FROM issues", **JSON_VIEWS),
)
def validate_documents(t):
    return validation.validate_documents(_docs(t), "conv_id", "turn")


@query(
    "document_summary",
    B.with_views(
        """SELECT d.conv_id, d.turn, CASE WHEN json_valid(value) AND json_type(value) = 'OBJECT' AND json_type(value, '$.business') = 'OBJECT'
          AND json_type(value, '$.business.name') = 'VARCHAR' THEN json_extract_string(value, '$.business.name') END AS name,
        CASE WHEN json_valid(value) AND json_type(value, '$.reviews') = 'ARRAY' THEN CAST(json_array_length(value, '$.reviews') AS BIGINT) ELSE 0 END AS review_count,
        coalesce(n, 0) AS issue_count, n IS NULL AS valid
        FROM docs d LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM issues GROUP BY ALL) USING (conv_id, turn)""",
        **JSON_VIEWS,
    ),
)
def document_summary(t):
    return validation.document_summary(_docs(t), "conv_id", "turn")


@query(
    "read_review_documents",
    B.with_views(
        f"""SELECT name, place_id, header_total_reviews, total_reviews, review_ids FROM
        (SELECT *, 1 AS one FROM ({ASSEMBLED}))""",
        **DOC_VIEWS,
    ),
)
def read_review_documents(t):
    """Writes documents one per file, reads them back as columns."""
    path = scratch_path(t.spark, "docs")
    lines = assemble.document_lines(_headers(t), _first_seen(t), "newest", "json")
    writers.write_files(lines.withColumn("file_stem", F.concat(F.lit("p-"), F.col("place_key"))), path)
    docs = readers.read_review_documents(t.spark, path)
    ids = F.transform("reviews", lambda r: r["id"])
    return docs.select(
        "business.name", F.col("business.placeId").alias("place_id"),
        F.col("business.headerTotalReviews").alias("header_total_reviews"),
        F.col("business.totalReviews").alias("total_reviews"),
        F.array_join(ids, ",").alias("review_ids"),
    )


@query(
    "validate_path",
    B.with_views(
        "SELECT path, code, count(*) AS issue_count FROM issues WHERE code <> 'unreadable' GROUP BY ALL", **JSON_VIEWS
    ),
)
def validate_path(t):
    """Writes raw documents as JSON Lines, validates the folder."""
    from placelens.plans.jobs import validate_path as job

    path = scratch_path(t.spark, "raw")
    _docs(t).filter("value IS NOT NULL").select("value").write.text(path)
    issues, _ = job(t.spark, path, one_per_file=False)
    return issues.groupBy("path", "code").agg(F.count("*").alias("issue_count"))
