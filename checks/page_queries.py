"""Stored pages: cards, headers, states, and captured pages to documents."""

from pyspark.sql import functions as F

from checks import bindings as B
from checks.registry import query
from placelens.operators import captures as C
from placelens.operators import quality
from placelens.plans.jobs import batch_run, collect_places
from placelens.session import scratch_path, staged
from placelens.sources import readers

# The given pages hold links in a menu instead of review cards.
LINK_SELECTORS = {
    "review_card": "nav li", "review_id": "a", "review_id_attr": "href", "author_name": "a",
    "text": "a", "photo": "img",
}
UNESCAPE = (
    "replace(replace(replace(replace(replace(regexp_replace({0}, '&amp(;|$)', chr(1), 'g'), '&quot;', '\"'), "
    "'&copy;', '©'), '&middot;', '·'), '&lt;', '<'), chr(1), '&')"
)
SEEN_HTML = (
    "regexp_replace(regexp_replace(html, '(?s)<(head|script|style)\\b.*?</(head|script|style)>', '', 'g'), "
    "'(?s)<!--.*?-->', '', 'g')"
)
BODY = (
    "trim(regexp_replace(" + UNESCAPE.format("regexp_replace(" + SEEN_HTML + ", '<[^>]*>', '', 'g')")
    + ", '\\s+', ' ', 'g'))"
)


def _pages(t, *fields, selectors=None):
    return C.read_pages(t.table("pages"), ("page_id",), selectors, fields)


LINKS = f"""
SELECT page_id, i - 1 AS pos, hrefs[i] AS review_id, {UNESCAPE.format("texts[i]")} AS text FROM (
 SELECT page_id, hrefs, texts, unnest(generate_series(1, len(hrefs))) AS i FROM (
  SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
   regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS texts FROM pages))
WHERE hrefs[i] <> ''
"""


@query("extract_cards", LINKS)
def extract_cards(t):
    cards = C.card_rows(_pages(t, "cards", selectors=LINK_SELECTORS), ["page_id"])
    return cards.select("page_id", "pos", "review_id", "text")


@query(
    "extract_headers",
    f"SELECT page_id, {B.trim(UNESCAPE.format('regexp_extract(html, ' + chr(39) + '(?s)<h1>(.*?)</h1>' + chr(39) + ', 1)'))} AS name FROM pages",
)
def extract_headers(t):
    return _pages(t, "name").select("page_id", F.coalesce("name", F.lit("Unknown")).alias("name"))


@query("body_text", f"SELECT page_id, md5({BODY}) AS body_md5 FROM pages")
def body_text(t):
    return _pages(t, "body_text").select("page_id", F.md5("body_text").alias("body_md5"))


@query(
    "stale_selector_alerts",
    f"SELECT page_id, CAST(length({BODY}) AS BIGINT) AS body_chars FROM pages WHERE length({BODY}) > 1000",
)
def stale_selector_alerts(t):
    """With the default selectors none of the given pages has a card."""
    return quality.stale_selector_alerts(_pages(t, "body_chars", "cards"), "page_id")


# --- pages built from the conversations, with the default selectors ----------
def captures(t):
    cards = t.sql(B.CARD_SRC)
    html = t.sql(B.CARD_HTML, card_src=cards)
    return t.sql(B.CAPTURES, card_html=html)


KEYS = ("place_key", "round", "pass_no", "resolved_url", "captured_ms")
# Cards as pages show them: the one of the round before (edited), then the new one.
SHOWN = f"""
SELECT CAST(conv_id AS VARCHAR) AS place_key, conv_id, round, CAST(CASE WHEN has_before AND own THEN 1 ELSE 0 END AS BIGINT) AS pos,
 id AS review_id, CASE WHEN author_no = 4 THEN 'Anonymous' ELSE 'Author ' || author_no END AS author,
 'https://example.org/contrib/' || author_no AS author_url, time_text AS publish_time, CAST(stars AS BIGINT) AS rating,
 nullif({B.trim("text")}, '') AS text, CAST(photo_count AS BIGINT) AS photos,
 nullif({B.trim("response")}, '') AS response, CASE WHEN response IS NOT NULL THEN 'a week ago' END AS response_time
FROM (
 SELECT c.*, true AS own, b.conv_id IS NOT NULL AS has_before FROM card_src c
  LEFT JOIN card_src b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2
 UNION ALL BY NAME
 SELECT b.* REPLACE (c.round AS round, b.text || ' (edited)' AS text), false AS own, true AS has_before
 FROM card_src c JOIN card_src b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2)
WHERE id <> ''
"""
SHOWN_VIEWS = {"card_src": B.CARD_SRC, "shown": SHOWN}


@query("read_captures", B.with_views(
    "SELECT place_key, round, pass_no, resolved_url, captured_ms, md5(html) AS html_md5 FROM captures", **B.PAGE_VIEWS))
def read_captures(t):
    path = scratch_path(t.spark, "captures")
    captures(t).write.parquet(path)
    return readers.read_captures(t.spark, path).select(*KEYS, F.md5("html").alias("html_md5"))


CARD_COLUMNS = "place_key, round, pos, review_id, author, author_url, publish_time, rating, text, photos"


@query(
    "extract_review_cards",
    B.with_views(
        f"SELECT {CARD_COLUMNS}, response AS owner_response_text, response_time AS owner_response_time FROM shown",
        **SHOWN_VIEWS,
    ),
)
def extract_review_cards(t):
    cards = C.card_rows(C.read_pages(captures(t), KEYS, fields=["cards"]), KEYS)
    return cards.select(
        *CARD_COLUMNS.split(", "), "owner_response_text", "owner_response_time"
    )


@query("drop_cards_without_id", B.with_views(
    "SELECT place_key, round, count(*) AS card_count FROM shown GROUP BY ALL", **SHOWN_VIEWS))
def drop_cards_without_id(t):
    cards = C.card_rows(C.read_pages(captures(t), KEYS, fields=["cards"]), KEYS)
    return cards.groupBy("place_key", "round").agg(F.count("*").alias("card_count"))


@query("card_ratings", B.with_views("SELECT place_key, round, pos, rating FROM shown", **SHOWN_VIEWS))
def card_ratings(t):
    cards = C.card_rows(C.read_pages(captures(t), KEYS, fields=["cards"]), KEYS)
    return cards.select("place_key", "round", "pos", "rating")


@query("card_defaults", B.with_views(
    "SELECT place_key, round, pos, author, publish_time, text, response_time AS owner_response_time FROM shown", **SHOWN_VIEWS))
def card_defaults(t):
    cards = C.card_rows(C.read_pages(captures(t), KEYS, fields=["cards"]), KEYS)
    return cards.select("place_key", "round", "pos", "author", "publish_time", "text", "owner_response_time")


@query("photo_counts", B.with_views("SELECT place_key, round, pos, photos FROM shown", **SHOWN_VIEWS))
def photo_counts(t):
    cards = C.card_rows(C.read_pages(captures(t), KEYS, fields=["cards"]), KEYS)
    return cards.select("place_key", "round", "pos", "photos")


PAGE_INFO = """
SELECT CAST(conv_id AS VARCHAR) AS place_key, conv_id, round, 'Place ' || (conv_id % 17) AS name, conv_id || ' Road' AS address,
 (4 + (conv_id % 10) / 10.0) AS header_rating,
 CASE WHEN conv_id % 3 > 0 THEN 1000 + conv_id % 1000 WHEN conv_id % 6 = 0 THEN conv_id END AS header_total_reviews,
 CASE WHEN conv_id % 3 > 0 THEN 'tabText' WHEN conv_id % 6 = 0 THEN 'badgeText' END AS count_source,
 round % 2 = 1 AS loading,
 CASE WHEN conv_id % 10 = 9 THEN 'limited_view' WHEN conv_id % 23 = 7 THEN 'consent' WHEN conv_id % 10 = 8 THEN 'sign_in_required' ELSE 'ok' END AS page_state,
 conv_id % 2 = 0 AS sort_verified,
 conv_id % 4 IN (0, 1) AND (conv_id % 23 = 7 OR conv_id % 11 = 5) AS wrong_place
FROM card_src
"""


@query("header_table", B.with_views(
    "SELECT place_key, round, name, address, CAST(header_rating AS DOUBLE) AS header_rating, header_total_reviews, count_source FROM info",
    card_src=B.CARD_SRC, info=PAGE_INFO))
def header_table(t):
    """The body text of a page without a tab or badge count holds decimals, so no count."""
    fields = ("name", "address", "rating_text", "tab_text", "badge_text", "body_snippet")
    pages = C.read_pages(captures(t), KEYS, fields=fields).withColumn("cards", F.array())
    return C.header_rows(pages).select(
        "place_key", "round", "name", "address", "header_rating", "header_total_reviews", "count_source"
    )


@query("page_state", B.with_views("SELECT place_key, round, page_state FROM info", card_src=B.CARD_SRC, info=PAGE_INFO))
def page_state(t):
    pages = C.read_pages(captures(t), KEYS, fields=["body_text", "asks_sign_in"])
    return C.page_state(pages).select("place_key", "round", "page_state")


@query("sort_verified", B.with_views("SELECT place_key, round, sort_verified FROM info", card_src=B.CARD_SRC, info=PAGE_INFO))
def sort_verified(t):
    pages = C.read_pages(captures(t), KEYS, fields=["sort_text"])
    return C.sort_verified(pages, "newest").select("place_key", "round", "sort_verified")


@query("loading_flag", B.with_views("SELECT place_key, round, loading FROM info", card_src=B.CARD_SRC, info=PAGE_INFO))
def loading_flag(t):
    return C.read_pages(captures(t), KEYS, fields=["loading"]).select("place_key", "round", "loading")


def _kept(max_reviews, also=""):
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_key ORDER BY round, pos) AS ordinal FROM (
      SELECT s.*, row_number() OVER (PARTITION BY s.place_key, review_id ORDER BY s.round, pos) AS copy
      FROM shown s JOIN info i ON i.place_key = s.place_key AND i.round = s.round
      WHERE page_state = 'ok' AND NOT wrong_place AND rating <= 5 {also}) WHERE copy = 1) WHERE ordinal <= {max_reviews}"""


PLACES = """
SELECT place_key, name, 'https://www.google.com/maps/place/P/data=!1s' || CASE WHEN conv_id % 11 = 5 THEN '0x0:0x1' ELSE '0x' || conv_id || ':0x1' END AS url,
 CASE conv_id % 4 WHEN 3 THEN CASE WHEN conv_id % 11 = 5 THEN '0x0:0x1' ELSE '0x' || conv_id || ':0x1' END
  WHEN 2 THEN 'ChIJ' || conv_id ELSE '0x' || conv_id || ':0X1' END AS place_id,
 address, CAST(header_rating AS DOUBLE) AS rating, header_total_reviews, coalesce(n, 0) AS total_reviews, coalesce(review_ids, '') AS review_ids
FROM (SELECT DISTINCT * EXCLUDE (round, loading) FROM info WHERE page_state = 'ok' AND NOT wrong_place)
LEFT JOIN (SELECT place_key, count(*) AS n, string_agg(review_id, ',' ORDER BY ordinal) AS review_ids FROM kept GROUP BY ALL) USING (place_key)
"""


def _place_rows(docs):
    ids = F.transform("reviews", lambda r: r["id"])
    return docs.select(
        "place_key", "business.name", "business.url", F.col("business.placeId").alias("place_id"),
        "business.address", "business.rating", F.col("business.headerTotalReviews").alias("header_total_reviews"),
        F.col("business.totalReviews").alias("total_reviews"), F.array_join(ids, ",").alias("review_ids"),
    )


@query("collect_places", B.with_views(PLACES, **SHOWN_VIEWS, info=PAGE_INFO, kept=_kept(2)))
def collect_places_query(t):
    """Captured pages of each announced order to documents with at most two reviews each."""
    pages, requests = staged(captures(t), "captures"), t.sql(B.REQUESTS)
    rows = [_place_rows(collect_places(pages, requests, order, 2).documents(order)) for order in ("newest", "highest")]
    return rows[0].unionByName(rows[1])


@query("collect_places_uncapped", B.with_views(PLACES, **SHOWN_VIEWS, info=PAGE_INFO, kept=_kept(1000000)))
def collect_places_uncapped(t):
    found = collect_places(staged(captures(t), "captures"), t.sql(B.REQUESTS), "newest", check_sort=False)
    return _place_rows(found.documents("newest"))


# Inputs of a batch: one location text per conversation, one of four not valid.
BATCH_INPUT = """CASE conv_id % 4 WHEN 0 THEN 'https://www.google.com/maps?ftid=0x' || conv_id || ':0x1'
 WHEN 1 THEN 'https://maps.app.goo.gl/s' || conv_id WHEN 2 THEN 'ChIJ' || lpad(CAST(conv_id AS STRING), 22, '0')
 ELSE 'nowhere' || conv_id END"""
BATCH_LIST = f"SELECT DISTINCT conv_id, {BATCH_INPUT} AS input FROM conversations"


# What a batch makes of each input: why it failed, or nothing.
BATCH_OUTCOME = """
SELECT l.conv_id, input, any_value(i.name) AS name, CASE WHEN starts_with(input, 'nowhere') THEN 'INVALID_LOCATION'
 WHEN any_value(i.name) IS NULL THEN 'NO_CAPTURE' WHEN any_value(page_state) <> 'ok' THEN any_value(page_state)
 WHEN any_value(contains(input, 'ftid=') AND wrong_place) THEN 'NAV_VERIFY' WHEN NOT any_value(sort_verified) THEN 'SORT_VERIFY' END AS reason
FROM list l LEFT JOIN info i ON i.conv_id = l.conv_id GROUP BY l.conv_id, input
"""
BATCH_VIEWS = {
    **SHOWN_VIEWS, "info": PAGE_INFO, "list": BATCH_LIST.replace("STRING", "VARCHAR"), "outcome": BATCH_OUTCOME,
    "kept": _kept(1000000, "AND sort_verified"),
}
_BATCHES = {}


def _batches(t):
    """First run over a part of the list, as CSV; then the whole list as JSON, resumed. Done once for all queries of a session."""
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _BATCHES:
        out, lists = scratch_path(t.spark, "batch"), scratch_path(t.spark, "list")
        wanted = t.sql(BATCH_LIST)
        stored = staged(
            captures(t).withColumn("conv_id", F.col("place_key").cast("bigint"))
            .withColumn("place_key", F.expr(BATCH_INPUT)).drop("conv_id"), "captures",
        )
        wanted.filter(F.col("input").contains("ftid=")).select("input").write.text(f"{lists}-1")
        wanted.select("input").write.text(f"{lists}-2")
        batch_run(t.spark, f"{lists}-1", stored, out, "csv", resume=True, run_id="r1", batch_id=1)
        _BATCHES[key] = out, batch_run(t.spark, f"{lists}-2", stored, out, "json", resume=True, run_id="r2", batch_id=2)
    return _BATCHES[key]


@query(
    "run_batch",
    B.with_views(
        """SELECT 'r2' AS run_id, CAST(count_if(reason IS NULL) AS BIGINT) AS succeeded, CAST(count_if(reason IS NOT NULL) AS BIGINT) AS failed,
        count(*) AS total, CAST(1 AS BIGINT) AS exit_code FROM outcome WHERE reason IS DISTINCT FROM 'INVALID_LOCATION' AND NOT (reason IS NULL AND contains(input, 'ftid='))""",
        **BATCH_VIEWS,
    ),
)
def run_batch_query(t):
    return _batches(t)[1].summary.select("run_id", "succeeded", "failed", "total", "exit_code")


@query("run_batch_failures", B.with_views("SELECT input, reason FROM outcome WHERE reason IS NOT NULL", **BATCH_VIEWS))
def run_batch_failures(t):
    """Inputs without output after both runs, and why."""
    return _batches(t)[1].failures.select("input", "reason")


@query(
    "run_batch_state",
    B.with_views(
        """SELECT input, CASE WHEN contains(input, 'ftid=') THEN 1 ELSE 2 END AS batch_id,
        CASE WHEN contains(input, 'ftid=') THEN 'csv' ELSE 'json' END AS format, CAST(0 AS BIGINT) AS run_no, true AS named FROM outcome WHERE reason IS NULL""",
        **BATCH_VIEWS,
    ),
)
def run_batch_state(t):
    """What both runs committed; each row names the file of its input."""
    state = readers.read_run_state(t.spark, f"{_batches(t)[0]}/_state")
    return state.select("input", F.col("batch_id").cast("int").alias("batch_id"), "format", "run_no", F.col("file_stem").isNotNull().alias("named"))


@query(
    "run_batch_files",
    B.with_views(
        """SELECT name, count(*) AS files, count(*) AS stems, CAST(coalesce(sum(n), 0) AS BIGINT) AS reviews, true AS by_slug FROM outcome LEFT JOIN
        (SELECT CAST(place_key AS BIGINT) AS conv_id, count(*) AS n FROM kept GROUP BY ALL) USING (conv_id)
        WHERE reason IS NULL AND NOT contains(input, 'ftid=') GROUP BY ALL""",
        **BATCH_VIEWS,
    ),
)
def run_batch_files(t):
    """The second run's files, read back: one for each location, named by its slug and a number."""
    docs = readers.read_review_documents(t.spark, f"{_batches(t)[0]}/batch-2")
    slug = F.regexp_replace(F.lower("business.name"), " ", "-")
    return docs.groupBy("business.name").agg(
        F.count("*").alias("files"), F.count_distinct("file_stem").alias("stems"),
        F.sum(F.size("reviews")).cast("bigint").alias("reviews"),
        F.bool_and(F.rlike("file_stem", F.concat(F.lit("^"), slug, F.lit("(-[0-9]+)?$")))).alias("by_slug"),
    )
