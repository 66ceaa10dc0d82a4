"""Location inputs: lists, classification, identity, resume, file names."""

from pyspark.sql import functions as F

from checks import bindings as B
from checks.registry import query
from placelens import fixed_values as V
from placelens.functions import urls
from placelens.functions.text import file_slug
from placelens.operators import locations as L
from placelens.operators import naming
from placelens.session import scratch_path
from placelens.sinks.writers import commit_run_state
from placelens.sources import readers

TRIMMED = B.trim("raw")
KIND = f"""CASE WHEN regexp_matches(t, '{V.PLACE_ID_PATTERN}') THEN 'place_id'
 WHEN regexp_matches(t, '{V.SHORT_URL_PATTERN}') THEN 'short'
 WHEN regexp_matches(t, '{V.LONG_URL_PATTERN}') THEN 'long'
 WHEN regexp_matches(t, '{V.CID_URL_PATTERN}') THEN 'cid'
 WHEN regexp_matches(t, '{V.FTID_URL_PATTERN}') THEN 'ftid' END"""


def place_id(c: str) -> str:
    u = f"url_decode({c})"
    return (
        f"coalesce(nullif(regexp_extract({u}, '{V.FTID_VALUE_PATTERN}', 1), ''), "
        f"nullif(regexp_extract({u}, '{V.DATA_TOKEN_PATTERN}', 1), ''))"
    )


CLASSIFIED = f"""SELECT *, CASE WHEN kind = 'place_id' THEN '{V.PLACE_ID_QUERY_URL}' || t
  WHEN kind IS NOT NULL THEN t END AS url,
 CASE WHEN kind = 'place_id' THEN t WHEN kind IN ('long', 'cid', 'ftid') THEN {place_id("t")} END AS place_id,
 CASE WHEN kind IS NOT NULL THEN kind = 'short' END AS is_short_url
FROM (SELECT *, {KIND} AS kind FROM (SELECT *, {TRIMMED} AS t FROM loc_inputs))"""
LOC_VIEWS = {"loc_inputs": B.LOC_INPUTS, "classified": CLASSIFIED}


def _inputs(t):
    return t.sql(B.LOC_INPUTS).withColumnRenamed("raw", "input")


@query(
    "classify_locations",
    B.with_views("SELECT c_custkey, kind, url, place_id, is_short_url FROM classified", **LOC_VIEWS),
)
def classify_locations(t):
    return L.classify_locations(_inputs(t)).select(
        "c_custkey", "kind", "url", "place_id", "is_short_url"
    )


@query(
    "filter_valid_locations",
    B.with_views(
        "SELECT c_custkey, kind, url FROM classified WHERE kind IS NOT NULL", **LOC_VIEWS
    ),
)
def filter_valid_locations(t):
    return L.valid_locations(_inputs(t)).select("c_custkey", "kind", "url")


@query(
    "rejected_locations",
    B.with_views(
        "SELECT c_custkey, raw AS input FROM classified WHERE kind IS NULL AND t <> ''", **LOC_VIEWS
    ),
)
def rejected_locations(t):
    return L.rejected_locations(_inputs(t)).select("c_custkey", "input")


@query(
    "extract_place_ids",
    B.with_views(f"SELECT c_custkey, {place_id('raw')} AS place_id FROM loc_inputs", loc_inputs=B.LOC_INPUTS),
)
def extract_place_ids(t):
    return _inputs(t).select("c_custkey", urls.place_id_in_url(F.col("input")).alias("place_id"))


def _enc(c):
    return f"replace(replace(replace(url_encode({c}), '%20', '+'), '~', '%7E'), '%2A', '*')"


def _dec(c):
    return f"url_decode(replace({c}, '+', ' '))"


CANONICAL = f"""
SELECT c_custkey, url,
 CASE WHEN contains(url, '{V.SHORT_URL_HOST}') OR NOT regexp_matches(url, '(?i)^https?://[^/?#\\s:]+') THEN url
 ELSE lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]+)', 1))
  || array_to_string(list_transform(regexp_extract_all(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '.'),
     lambda c: CASE WHEN c = ' ' THEN '%20' WHEN regexp_matches(c, '[^!-~]') THEN url_encode(c) ELSE c END), '')
  || '?' || array_to_string(list_transform(kept, lambda p: CASE WHEN {_dec("split_part(p, '=', 1)")} = 'hl' THEN 'hl=en'
     ELSE {_enc(_dec("split_part(p, '=', 1)"))} || '=' || {_enc(_dec("regexp_replace(p, '^[^=]*=?', '')"))} END)
     || CASE WHEN loc_at = 0 THEN ['hl=en'] ELSE CAST([] AS VARCHAR[]) END, '&')
  || regexp_extract(url, '(#.*)$', 1) END AS target_url,
 NOT contains(url, 'hl=en') AS needs_locale_fix
FROM (SELECT *, list_filter(pairs, lambda p, i: NOT ({_dec("split_part(p, '=', 1)")} IN ('g_ep', 'entry'))
   AND ({_dec("split_part(p, '=', 1)")} <> 'hl' OR i = loc_at)) AS kept
 FROM (SELECT *, coalesce(list_position(list_transform(pairs, lambda p: {_dec("split_part(p, '=', 1)")}), 'hl'), 0) AS loc_at
  FROM (SELECT c_custkey, url, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '') AS pairs
   FROM classified WHERE kind IS NOT NULL)))
"""


@query(
    "canonicalise_urls",
    B.with_views(f"SELECT c_custkey, target_url FROM ({CANONICAL})", **LOC_VIEWS),
)
def canonicalise_urls(t):
    return L.navigation_urls(L.valid_locations(_inputs(t))).select("c_custkey", "target_url")


@query(
    "needs_locale_fix",
    B.with_views(
        "SELECT place_key, resolved_url, NOT contains(resolved_url, 'hl=en') AS needs_locale_fix "
        "FROM (SELECT place_key, resolved_url || CASE WHEN length(place_key) % 2 = 0 THEN '?hl=en' ELSE '?hl=fr' END AS resolved_url FROM locs)",
        locs=B.CAPTURED_LOCS,
    ),
)
def needs_locale_fix(t):
    url = F.concat(
        "resolved_url", F.when(F.length("place_key") % 2 == 0, "?hl=en").otherwise("?hl=fr")
    )
    return (
        t.sql(B.CAPTURED_LOCS)
        .select("place_key", url.alias("resolved_url"))
        .withColumn("needs_locale_fix", urls.needs_locale_fix(F.col("resolved_url")))
    )


SLUG = (
    "coalesce(nullif(regexp_replace(regexp_replace(replace(lower(name), '''', ''), '[^a-z0-9]+', '-', 'g'), "
    "'^-+|-+$', '', 'g'), ''), left(sha256(name), 12))"
)


@query("file_slugs", B.with_views(f"SELECT arrival, name, {SLUG} AS slug FROM names", names=B.NAMES))
def file_slugs(t):
    return t.sql(B.NAMES).withColumn("slug", file_slug(F.col("name")))


@query(
    "verifiable_place_id",
    B.with_views(
        "SELECT place_key, coalesce(starts_with(place_id, '0x'), false) AS verifiable FROM locs",
        locs=B.CAPTURED_LOCS,
    ),
)
def verifiable_place_id(t):
    return t.sql(B.CAPTURED_LOCS).select(
        "place_key", urls.is_verifiable_place_id(F.col("place_id")).alias("verifiable")
    )


MATCH = (
    "CASE WHEN coalesce(place_id, '') = '' THEN true WHEN resolved IS NULL THEN false "
    "ELSE lower(place_id) = lower(resolved) END"
)
RESOLVED = f"SELECT *, {place_id('resolved_url')} AS resolved FROM locs"


@query(
    "place_ids_match",
    B.with_views(
        f"SELECT place_key, {MATCH} AS matched FROM resolved", locs=B.CAPTURED_LOCS, resolved=RESOLVED
    ),
)
def place_ids_match(t):
    resolved = urls.place_id_in_url(F.col("resolved_url"))
    return t.sql(B.CAPTURED_LOCS).select(
        "place_key", urls.place_ids_match(F.col("place_id"), resolved).alias("matched")
    )


@query(
    "verify_identity",
    B.with_views(
        f"""SELECT place_key, resolved AS resolved_place_id,
        NOT coalesce(starts_with(place_id, '0x'), false) OR {MATCH} AS verified,
        coalesce(place_id, resolved) AS final_place_id, resolved_url AS final_url,
        CASE WHEN coalesce(starts_with(place_id, '0x'), false) AND NOT {MATCH} THEN 'NAV_VERIFY' END AS error_kind
        FROM resolved""",
        locs=B.CAPTURED_LOCS,
        resolved=RESOLVED,
    ),
)
def verify_identity(t):
    locs = t.sql(B.CAPTURED_LOCS)
    return L.verify_identity(
        locs.select("place_key", "resolved_url"), locs.select("place_key", "place_id")
    ).select("place_key", "resolved_place_id", "verified", "final_place_id", "final_url", "error_kind")


@query(
    "pending_locations",
    B.with_views(
        "SELECT o_orderkey, input FROM wanted WHERE input NOT IN (SELECT input FROM done)",
        wanted=B.WANTED_INPUTS,
        done=B.DONE_INPUTS,
    ),
)
def pending_locations(t):
    return L.pending_locations(t.sql(B.WANTED_INPUTS), t.sql(B.DONE_INPUTS)).select(
        "o_orderkey", "input"
    )


@query(
    "read_location_lists",
    B.with_views(
        f"""SELECT list_no, ordinal, input FROM (
        SELECT CAST(c_custkey // 500 AS BIGINT) AS list_no, c_custkey % 500 AS ordinal,
        CASE WHEN c_custkey // 500 % 2 = 0 THEN raw ELSE {TRIMMED} END AS input, {TRIMMED} AS t
        FROM loc_inputs) WHERE t <> '' AND (list_no % 2 = 0 OR NOT starts_with(t, '#'))""",
        loc_inputs=B.LOC_INPUTS,
    ),
)
def read_location_lists(t):
    """Writes list files of 500 inputs each, JSON arrays and lines by turns, then reads them."""
    path = scratch_path(t.spark, "lists")
    lists = (
        _inputs(t)
        .groupBy(F.expr("c_custkey div 500").alias("list_no"))
        .agg(F.array_sort(F.collect_list(F.struct("c_custkey", "input"))).alias("x"))
        .select("list_no", F.transform("x", lambda e: e["input"]).alias("x"))
    )
    body = F.when(F.col("list_no") % 2 == 0, F.to_json("x")).otherwise(F.array_join("x", "\n"))
    lists.select("list_no", body.alias("value")).write.partitionBy("list_no").option(
        "lineSep", " "
    ).text(path)
    number = F.regexp_extract("source_file", "list_no=([0-9]+)", 1).cast("bigint")
    return readers.read_location_lists(t.spark, path).select(
        number.alias("list_no"), "ordinal", "input"
    )


LARGE_ITEM = "'https://maps.app.goo.gl/s' || o_orderkey || '?q=' || repeat('x', 1200)"


KEYS_PER_ROW = 10_000


def _large_list(t, form):
    """Lines of one list file, in order in one task. Only keys are sorted there, many in a row; texts are made of them after it."""
    keys = t.table("orders").select("o_orderkey")
    block, key = F.floor(F.col("o_orderkey") / KEYS_PER_ROW), F.col("o_orderkey")
    nulls = F.array_repeat(F.lit(None).cast("bigint"), F.count_if(key.isNull()).cast("int"))
    rows = keys.groupBy(block.alias("block")).agg(
        F.concat(nulls, F.array_sort(F.collect_list(key))).alias("keys"), F.lit(1).alias("place"), F.lit(None).cast("string").alias("mark")
    )
    if form == "array":
        marks = t.spark.createDataFrame([(0, "["), (2, "]")], "place int, mark string")
        rows = rows.unionByName(marks, allowMissingColumns=True)
    ordered = rows.repartition(1).sortWithinPartitions("place", "block")
    lines = ordered.select("mark", F.explode_outer("keys").alias("o_orderkey"))
    text = F.expr(LARGE_ITEM)
    if form == "array":
        last = F.lit(keys.agg(F.max("o_orderkey")).first()[0]).cast("bigint")
        text = F.concat(F.lit('  "'), text, F.when(F.col("o_orderkey") < last, '",').otherwise('"'))
    return lines.select(F.coalesce("mark", text).alias("value"))


@query(
    "read_large_location_lists",
    f"""SELECT form, CAST(row_number() OVER (PARTITION BY form ORDER BY o_orderkey) - 1 AS BIGINT) AS ordinal, sha256({LARGE_ITEM}) AS input_sha256
    FROM orders, (SELECT 'array' AS form UNION ALL SELECT 'lines')""",
)
def read_large_location_lists(t):
    """One list of all orders, of 1.2 kB each, as a JSON array over many lines and as plain lines."""
    path = scratch_path(t.spark, "large-lists")
    for form in ("array", "lines"):
        _large_list(t, form).write.text(f"{path}/form={form}")
    form = F.regexp_extract("source_file", "form=([a-z]+)", 1)
    return readers.read_location_lists(t.spark, path).select(form.alias("form"), "ordinal", F.sha2("input", 256).alias("input_sha256"))


@query("read_run_state", "SELECT input FROM (" + B.DONE_INPUTS + ")")
def read_run_state(t):
    path = scratch_path(t.spark, "state")
    commit_run_state(t.sql(B.DONE_INPUTS), path)
    return readers.read_run_state(t.spark, path).select("input")


STATES = """
SELECT o_custkey, CASE o_custkey % 6
 WHEN 0 THEN '{"completed": ["https://maps.app.goo.gl/s' || o_custkey || '", "b"]}'
 WHEN 1 THEN '{"completed": ["a", 5]}' WHEN 2 THEN '{not json' WHEN 3 THEN '{"completed": "a"}'
 WHEN 4 THEN '{"completed": "no", "completed": ["z' || o_custkey || '"]}'
 ELSE '{"completed": ["' || o_custkey || '"], "more": 1}' END AS value
FROM (SELECT DISTINCT o_custkey FROM orders )
"""


@query(
    "validate_state",
    B.with_views(
        """SELECT o_custkey, unnest(list_transform(items, lambda x: json_extract_string(x, '$'))) AS input FROM (
        SELECT o_custkey, CASE WHEN json_type(value, '$.completed') = 'ARRAY' THEN json_extract(value, '$.completed[*]') END AS items
        FROM states WHERE json_valid(value))
        WHERE len(list_filter(items, lambda x: json_type(x) <> 'VARCHAR')) = 0""",
        # The other engine takes the first of repeated keys; the last one counts.
        states=f"""SELECT o_custkey, replace(value, '"completed": "no", ', '') AS value FROM ({STATES})""",
    ),
)
def validate_state(t):
    return readers.state_inputs(t.sql(STATES), "o_custkey")


COUNTERS = f"SELECT *, row_number() OVER (PARTITION BY slug ORDER BY arrival) AS n FROM (SELECT *, {SLUG} AS slug FROM names)"


@query("name_counters", B.with_views(f"SELECT arrival, slug, n FROM ({COUNTERS})", names=B.NAMES))
def name_counters(t):
    return naming.name_counters(t.sql(B.NAMES)).select("arrival", "slug", "n")


# The n-th free number by trying numbers one after the other.
FREE = f"""
SELECT arrival, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS stem FROM (
 SELECT arrival, slug, n, k, row_number() OVER (PARTITION BY arrival ORDER BY k) AS free_no FROM (
  SELECT c.arrival, c.slug, c.n, unnest(generate_series(1, c.n + (SELECT count(*) FROM files))) AS k FROM counters c)
 WHERE (CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END) || '.json' NOT IN (SELECT filename FROM files))
WHERE free_no = n
"""


@query(
    "free_filenames",
    B.with_views(FREE, names=B.NAMES, files=B.EXISTING_FILES, counters=COUNTERS),
)
def free_filenames(t):
    stems = t.sql(B.EXISTING_FILES).select(F.regexp_replace("filename", r"\.json\z", "").alias("stem"))
    return naming.free_filenames(naming.name_counters(t.sql(B.NAMES)), stems).select("arrival", "stem")


@query(
    "file_plan",
    B.with_views(
        f"SELECT arrival, stem || '.json' AS filename FROM ({FREE})",
        names=B.NAMES, files=B.EXISTING_FILES, counters=COUNTERS,
    ),
)
def file_plan(t):
    return naming.file_plan(t.sql(B.NAMES), t.sql(B.EXISTING_FILES), ".json").select(
        "arrival", "filename"
    )
