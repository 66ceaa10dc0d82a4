"""Inputs derived from the given tables.

The texts run unchanged in Spark SQL and DuckDB, so both sides of a check start
from the same rows. Names of the views end in ``_src`` when they are inputs.
"""

from placelens.functions.text import SPACE

AR = "مكان"
NBSP, NNBSP, THIN = " ", " ", " "

LOC_INPUTS = f"""
SELECT c_custkey, c_nationkey, CASE c_custkey % 12
 WHEN 0 THEN '  https://maps.app.goo.gl/s' || c_custkey || '{NBSP} '
 WHEN 1 THEN 'https://www.google.com/maps?cid=' || c_custkey
 WHEN 2 THEN 'https://www.google.co.uk/maps?hl=de&ftid=0x' || c_custkey || ':0xA' || c_nationkey
 WHEN 3 THEN 'https://www.google.com/maps/place/N+' || c_custkey || '/@1,2,15z/data=!3m1!1s0x'
   || c_custkey || ':0x' || c_nationkey || '?entry=ttu&hl=fr&g_ep=x%3D%3D&a=b+c&hl=de&t=*~'
 WHEN 4 THEN 'ChIJ' || lpad(CAST(c_custkey AS STRING), 22, 'A')
 WHEN 5 THEN 'https://example.com/maps?ftid=0x' || c_custkey || ':0x' || c_nationkey
 WHEN 6 THEN '# comment ' || c_custkey
 WHEN 7 THEN '   '
 WHEN 8 THEN 'http://Google.de/maps/?x=1&ftid=0x' || c_custkey || '%3A0x' || c_nationkey || '#f'
 WHEN 9 THEN 'https://www.google.com/maps?noftid=0x' || c_custkey || ':0x' || c_nationkey
 WHEN 10 THEN 'http://google.fr/maps/place/Café ' || c_custkey || '/data=!1s0x' || c_custkey || '%3A0xF?ftid=0xB:0xC&b'
 ELSE 'https://google.com/maps?ftid=bad' || c_custkey END AS raw
FROM customer
"""

CAPTURED_LOCS = """
SELECT CAST(c_custkey AS STRING) AS place_key,
 CASE c_custkey % 4 WHEN 0 THEN '0x' || c_custkey || ':0xAB' WHEN 1 THEN '0X' || c_custkey || ':0xab'
   WHEN 2 THEN 'ChIJ' || c_custkey ELSE NULL END AS place_id,
 'https://www.google.com/maps/place/' || n_name || '/data=' ||
 CASE WHEN c_custkey % 13 = 0 THEN 'none'
   WHEN c_custkey % 11 = 0 THEN '!1s0x999:0xff'
   ELSE '!1s0x' || c_custkey || ':0xab' END AS resolved_url
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

DONE_INPUTS = """
SELECT DISTINCT 'https://maps.app.goo.gl/s' || o_custkey AS input FROM orders WHERE o_orderstatus = 'F'
"""

WANTED_INPUTS = """
SELECT o_orderkey, 'https://maps.app.goo.gl/s' || o_custkey AS input FROM orders
"""

_COPY = f"""
SELECT CAST(u.conv_id AS STRING) AS place_key, u.conv_id, u.turn,
 CAST(floor(u.turn / 2.0) AS INT) + {{copy}} AS round, u.turn * 2 - {{copy}} AS pos,
 CASE WHEN u.conv_id % 5 = 0 THEN '' ELSE md5(u.text) END AS review_id,
 CASE WHEN (u.conv_id + u.turn) % 13 = 0 THEN NULL ELSE 'Author ' || (u.conv_id % 11) END AS author,
 CASE WHEN u.conv_id % 3 = 0 THEN NULL ELSE 'https://example.org/contrib/' || u.conv_id END AS author_url,
 u.turn || ' weeks ago' AS publish_time,
 (u.conv_id + u.turn) % 8 - 1 AS rating,
 CASE WHEN u.conv_id % 7 = 2 THEN NULL ELSE u.text || '{{more}}' END AS text,
 CASE WHEN u.conv_id % 7 IN (2, 3) THEN '{AR} ' || left(u.text, 3) WHEN u.conv_id % 7 = 4 THEN '' ELSE NULL END AS original_text,
 u.turn % 4 - CASE WHEN u.conv_id % 19 = 5 THEN 1 ELSE 0 END AS photos,
 a.text AS owner_response_text,
 CASE WHEN u.turn % 4 = 0 THEN '' ELSE 'a week ago' END AS owner_response_time
FROM conversations u
LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user' AND u.turn >= {{first_turn}}
"""
# One raw review per user turn, and later, longer copies one round on.
RAW_REVIEWS = (
    _COPY.format(copy=0, more="", first_turn=0)
    + " UNION ALL "
    + _COPY.format(copy=1, more=" more", first_turn=2)
)

SCAN_ROWS = """
SELECT CAST(l_suppkey AS STRING) AS place_key, l_linenumber AS round, l_orderkey AS pos,
 CAST(l_partkey AS STRING) AS review_id, CAST(l_quantity AS INT) % 7 AS rating
FROM lineitem
"""

HEADER_TEXTS = f"""
SELECT p_partkey, CASE p_partkey % 16
 WHEN 0 THEN '1,' || lpad(CAST(p_size AS STRING), 3, '0') || ' reviews'
 WHEN 1 THEN 'Reviews ' || p_partkey
 WHEN 2 THEN '1.6K reviews'
 WHEN 3 THEN '4.5 stars · ' || p_size || ' reviews'
 WHEN 4 THEN p_size || '{NBSP}' || lpad(CAST(p_size AS STRING), 3, '0') || ' REVIEWS'
 WHEN 5 THEN '(' || p_partkey || ') reviews'
 WHEN 6 THEN p_size || ' photos · ' || p_partkey || ' review.'
 WHEN 7 THEN 'Reviews' || chr(10) || p_size
 WHEN 8 THEN p_size || 'k reviews'
 WHEN 9 THEN p_partkey || ' ratings'
 WHEN 10 THEN '   '
 WHEN 11 THEN NULL
 WHEN 12 THEN p_size || '{THIN}' || '001 reviews Reviews 9'
 WHEN 13 THEN p_size || ' reviewsy'
 WHEN 14 THEN p_size || ' mb reviews'
 ELSE '2 reviewsé' END AS count_text,
 CASE p_partkey % 11
 WHEN 0 THEN 'Rated ' || (p_size % 7) || '.5 out of 5 stars'
 WHEN 1 THEN (p_size % 6) || ',' || (p_size % 10)
 WHEN 2 THEN '-' || p_size
 WHEN 3 THEN '-1.' || (p_size % 9)
 WHEN 4 THEN p_size || ' stars'
 WHEN 5 THEN '4.5.6'
 WHEN 6 THEN 'no number'
 WHEN 7 THEN ''
 WHEN 8 THEN NULL
 WHEN 9 THEN '5.0'
 ELSE CAST(p_size AS STRING) END AS rating_text
FROM part
"""

TEXTS = f"""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '=' || text WHEN 1 THEN '@' || text
  WHEN 2 THEN text || ', "q"' WHEN 3 THEN '-' || chr(9) || text WHEN 4 THEN '' ELSE text END AS cell,
 CASE doc_id % 7 WHEN 0 THEN repeat('{AR}', CAST(length(text) AS INT)) || text WHEN 1 THEN 'ab {AR[:2]}'
  WHEN 2 THEN '素晴 123' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE text END AS mixed
FROM documents
"""

NAMES = """
SELECT s_suppkey AS arrival, CASE s_suppkey % 8 WHEN 0 THEN 'Café & Gym!' WHEN 1 THEN n_name || '''s Place'
  WHEN 2 THEN '--' || n_name || '--' WHEN 3 THEN 'مكان ' WHEN 4 THEN 'A'
  WHEN 5 THEN s_name WHEN 6 THEN '素晴' || n_name ELSE '---' END AS name
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

EXISTING_FILES = """
SELECT CASE n_nationkey % 3 WHEN 0 THEN 'a-' || (n_nationkey + 2) || '.json'
  WHEN 1 THEN 'nation-' || n_nationkey || '.json' ELSE 'caf-gym.json' END AS filename
FROM nation
"""

# Cards as they will stand in stored pages, and the pages around them.
CARD_SRC = """
SELECT u.conv_id, u.turn, CAST(floor(u.turn / 2.0) AS INT) AS round,
 CASE WHEN u.conv_id % 29 = 3 THEN '' ELSE md5(u.text) END AS id,
 u.conv_id % 11 AS author_no, (u.conv_id + u.turn) % 7 AS stars, u.turn % 3 AS photo_count,
 u.turn || ' weeks ago' AS time_text, u.text AS text, a.text AS response
FROM conversations u
LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
"""


def _escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


CARD_HTML = f"""
SELECT conv_id, turn, round, id, text,
 '<div class="x jftiEf"><button data-review-id="' || id || '" data-href="https://example.org/contrib/'
 || author_no || '"></button>' ||
 CASE WHEN author_no = 4 THEN '' ELSE '<div class="d4r55">  Author <b>' || author_no || '</b>{NBSP}</div>' END ||
 CASE WHEN stars = 0 THEN '' ELSE '<span class="kvMYJc" role="img" aria-label="' || stars || ' stars"></span>' END ||
 '<span class="rsqaWe">outside</span><div class="DU9Pgb"><span class="rsqaWe"> ' || time_text || '</span></div>'
 || '<div class="MyEned"><span class="wiI7pd">' AS head,
 '</span></div>' || repeat('<button class="Tya61d"></button>', CAST(photo_count AS INT)) ||
 CASE WHEN response IS NULL THEN '' ELSE '<div class="CDe7pd"><span class="DZSIDd">a week ago</span><div class="wiI7pd">'
 || {_escaped("response")} || '</div></div>' END || '</div>' AS tail
FROM card_src
"""

# Each page shows the card of the round before it again (edited), then its own.
CAPTURES = f"""
SELECT CAST(p.conv_id AS STRING) AS place_key, p.round AS round, CAST(0 AS INT) AS pass_no,
 CASE WHEN p.conv_id % 23 = 7 THEN 'https://consent.google.com/m?x=' || p.conv_id
  WHEN p.conv_id % 11 = 5 THEN 'https://www.google.com/maps/place/P/data=!1s0x0:0x1'
  ELSE 'https://www.google.com/maps/place/P/data=!1s0x' || p.conv_id || ':0x1' END AS resolved_url,
 '<!DOCTYPE html><html><head><title>limited view?</title><style>a b</style></head><body><h1> Place '
 || (p.conv_id % 17) || '</h1><p>Unclosed<br>' ||
 CASE WHEN p.conv_id % 10 = 9 THEN 'You see a limited view now' ELSE '' END ||
 CASE WHEN p.conv_id % 10 = 8 THEN '<a href="/s"><span>Sign</span> in</a>' ELSE '' END ||
 '<button role="tab">Overview</button><button role="tab"> Reviews ' ||
 CASE WHEN p.conv_id % 3 = 0 THEN '' ELSE '1,' || lpad(CAST(p.conv_id % 1000 AS STRING), 3, '0') END || '</button>'
 || '<div role="main"><button data-item-id="address"><div class="fontBodyMedium">' || p.conv_id || ' Road</div></button>'
 || CASE WHEN p.conv_id % 6 = 0 THEN '<i aria-label="' || p.conv_id || ' REVIEWS"></i>' ELSE '' END ||
 '<em role="img" aria-label="4.' || (p.conv_id % 10) || ' stars"></em>' ||
 '<div aria-live="polite" aria-atomic="true">Sorted: ' || CASE WHEN p.conv_id % 2 = 0 THEN 'Newest' ELSE 'highest' END || ' first</div>'
 || coalesce(q.head || {_escaped("q.text || ' (edited)'")} || q.tail, '')
 || p.head || {_escaped("p.text")} || p.tail
 || CASE WHEN p.round % 2 = 1 THEN '<div class="lXJj5c"></div>' ELSE '' END || '</div></body></html>' AS html,
 CAST(1700000000000 + p.conv_id * 1000 + p.round * 10 AS BIGINT) AS captured_ms
FROM card_html p LEFT JOIN card_html q ON q.conv_id = p.conv_id AND q.turn = p.turn - 2
"""

REQUESTS = """
SELECT DISTINCT CAST(conv_id AS STRING) AS place_key,
 CASE conv_id % 4 WHEN 3 THEN NULL WHEN 2 THEN 'ChIJ' || conv_id ELSE '0x' || conv_id || ':0X1' END AS place_id
FROM conversations
"""


def trim(c: str) -> str:
    return f"regexp_replace({c}, '\\A{SPACE}+|{SPACE}+\\z', '', 'g')"


def with_views(body: str, **views: str) -> str:
    """DuckDB statement: the given views as common table expressions, then ``body``."""
    heads = ", ".join(f"{n} AS ({t})" for n, t in views.items())
    return f"WITH {heads} {body}" if views else body


def hint(c: str) -> str:
    a = f"length(regexp_replace({c}, '[^\\x{{0600}}-\\x{{06ff}}]', '', 'g'))"
    z = f"length(regexp_replace({c}, '[^a-zA-Z]', '', 'g'))"
    return (
        f"CASE WHEN coalesce({c}, '') = '' THEN NULL WHEN {a} + {z} = 0 THEN 'unknown' "
        f"WHEN {a} > ({a} + {z}) * 0.5 THEN 'arabic' WHEN {z} > ({a} + {z}) * 0.5 THEN 'english' "
        f"ELSE 'mixed' END"
    )


# Raw reviews made into review rows, before invalid ones are dropped.
SHAPED = f"""
SELECT place_key, round, pos,
 CASE WHEN review_id <> '' THEN review_id ELSE left(sha256(concat(coalesce(author, 'null'), '|', publish_time, '|', rating, '|', coalesce(left(text, 50), ''))), 16) END AS review_id,
 author, author_url, publish_time, rating, text,
 CASE WHEN coalesce(original_text, '') = '' AND coalesce(text, '') <> '' THEN text ELSE original_text END AS original_text,
 CASE WHEN coalesce(text, '') <> '' THEN {hint("(CASE WHEN coalesce(original_text, '') = '' THEN text ELSE original_text END)")} END AS original_language,
 photos,
 CASE WHEN coalesce(owner_response_text, '') <> '' THEN owner_response_text END AS response_text,
 CASE WHEN coalesce(owner_response_text, '') <> '' THEN {hint("owner_response_text")} END AS response_language,
 CASE WHEN coalesce(owner_response_text, '') <> '' THEN nullif(owner_response_time, '') END AS response_time
FROM raw_reviews
"""
VALID = "SELECT * FROM shaped WHERE author IS NOT NULL AND rating BETWEEN 0 AND 5 AND photos >= 0"
FIRST_SEEN = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY place_key, review_id
 ORDER BY round, pos) AS rn FROM valid) WHERE rn = 1
"""
REVIEW_VIEWS = {"raw_reviews": RAW_REVIEWS, "shaped": SHAPED, "valid": VALID, "first_seen": FIRST_SEEN}
PAGE_VIEWS = {"card_src": CARD_SRC, "card_html": CARD_HTML, "captures": CAPTURES}
