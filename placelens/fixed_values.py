"""Values that results depend on. All of them are data, not logic.

Patterns are written for ``java.util.regex`` and kept free of look-around where
possible so that the same text also runs in an RE2 engine.
"""

# --- fixed values: enums -----------------------------------------------------
SORT_ORDERS = ("newest", "relevant", "highest", "lowest")
OUTPUT_FORMATS = ("json", "csv")
PROVIDERS = ("playwright",)

# --- fixed values: location inputs -------------------------------------------
PLACE_ID_PATTERN = r"^ChIJ[A-Za-z0-9_-]{20,}\z"
LONG_URL_PATTERN = r"^https?://(www\.)?google\.[a-z.]+/maps/place/"
SHORT_URL_PATTERN = r"^https?://maps\.app\.goo\.gl/"
CID_URL_PATTERN = r"^https?://(www\.)?google\.[a-z.]+/maps/?\?cid="
FTID_URL_PATTERN = r"^https?://(www\.)?google\.[a-z.]+/maps/?\?([^#]*&)?ftid="
FTID_VALUE_PATTERN = r"ftid=(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)"
DATA_TOKEN_PATTERN = r"!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)"
PLACE_ID_QUERY_URL = "https://www.google.com/maps/place/?q=place_id:"
SHORT_URL_HOST = "maps.app.goo.gl"
LOCALE_PARAM = "hl"
LOCALE_VALUE = "en"
TRACKING_PARAMS = ("g_ep", "entry")
CONSENT_HOST = "consent.google.com"

# --- fixed values: header and card texts -------------------------------------
UNKNOWN_NAME = "Unknown"
ANONYMOUS_AUTHOR = "Anonymous"
BODY_SNIPPET_CHARS = 10000
SHARED_SNIPPET_CHARS = 200
ID_TEXT_PREFIX_UNITS = 50
ID_HEX_CHARS = 16
SLUG_HASH_HEX_CHARS = 12
LIMITED_VIEW_TEXT = "limited view"
SIGN_IN_TEXT = "sign in"
STALE_SELECTOR_BODY_CHARS = 1000
COUNT_SOURCES = ("tabText", "badgeText", "bodySnippet")

# --- fixed values: collection loop, retry and pacing -------------------------
MAX_DRY_ROUNDS = 6
SPINNERS_PER_DRY_ROUND = 3
POLL_DELAY_MS = 3000
POLL_DELAY_MULTIPLIER = 4
POLL_JITTER = 0.15
POLL_SETTLE_MS = 500
MAX_RETRIES = 2
RETRY_BASE_MS = 2000
RETRY_FACTOR = 4
RETRY_CAP_MS = 30000
LOCATION_DELAY_MS = 10000
LOCATION_TIMEOUT_MS = 300000
UNRECOVERABLE_PHRASES = (
    "invalid input",
    "invalid url",
    "captcha",
    "access denied",
    "executable doesn't exist",
    "browser has been closed",
    "browsertype.launch",
    "sort verification failed",
    "navigation verification failed",
)
NAVIGATION_ERROR_KIND = "NAV_VERIFY"

# --- fixed values: flat export columns, in file order ------------------------
CSV_COLUMNS = (
    "business_name",
    "review_id",
    "author",
    "author_url",
    "rating",
    "publish_time",
    "text",
    "original_text",
    "original_language",
    "photos",
    "owner_response_text",
    "owner_response_time",
)

# --- fixed values: page selectors (they go stale; pass your own to override) --
DEFAULT_SELECTORS = {
    "review_card": "div.jftiEf",
    "review_id": "[data-review-id]",
    "review_id_attr": "data-review-id",
    "author_name": "div.d4r55",
    "author_button": 'button[data-href*="/contrib/"]',
    "author_url_attr": "data-href",
    "stars": 'span.kvMYJc[role="img"]',
    "stars_attr": "aria-label",
    "time_container": "div.DU9Pgb",
    "time": "span.rsqaWe",
    "text": "div.MyEned span.wiI7pd",
    "response_container": "div.CDe7pd",
    "response_text": "div.wiI7pd",
    "response_time": "span.DZSIDd",
    "photo": "button.Tya61d",
    "name": "h1",
    "rating_label": '[role="img"][aria-label*="star"]',
    "rating_span": 'span[aria-hidden="true"]',
    "tab": 'button[role="tab"]',
    "main_region": '[role="main"]',
    "review_badge": '[aria-label*="review" i]',
    "address": 'button[data-item-id="address"] div.fontBodyMedium, [data-item-id="address"]',
    "sort_region": 'div[aria-live="polite"][aria-atomic="true"]',
    "loading": "div.lXJj5c",
    "sign_in_label": 'a[aria-label="Sign in"]',
    "sign_in_text": "a, button",
}
