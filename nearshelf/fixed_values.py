"""Word lists, patterns, formats and limits that decide the results.

They are part of the operators' definition and must not be tuned; whatever a
deployment may change is a function parameter whose default is taken from here.
"""

# --- whitespace, as text tools outside the JVM understand it ----------------
# The JVM's own `trim` removes only U+0020 and its `\s` is ASCII.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LINE_BREAK_CLASS = r"[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# --- page markup ------------------------------------------------------------
JSONLD_BLOCK = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
OG_URL = r'(?idU)<meta\s+property="og:url"\s+content="(.*?)"'
PRODUCT_MEMBERS = [
    "@type", "sku", "name", "category", "countryOfOrigin", "size", "image", "description", "offers", "keywords", "review", "aggregateRating",
]
PRODUCT_TYPE = "Product"
PAGE_FILE_ID = r"^(\d+)\.html$"
PAGE_FILE_GLOB = "*.html"

# --- product predicate ------------------------------------------------------
CATEGORY_MUST_CONTAIN = "wine"
CATEGORY_MUST_NOT_CONTAIN = [
    "brandy", "cordial", "liqueur", "spirits", "whiskey", "whisky", "rum",
    "gin", "vodka", "tequila", "mezcal", "cognac", "armagnac",
]

# --- names ------------------------------------------------------------------
YEAR = r"\b(19\d{2}|20\d{2})\b"
PRODUCER_STOP_WORDS = [
    "marsannay", "chablis", "sancerre", "barolo", "barbaresco", "rioja",
    "chianti", "brunello", "champagne",
]
PRODUCER_MAX_TOKENS = 4
BRAND_OPENERS = ["domaine", "chateau", "clos", "mas", "vina", "bodega"]
BRAND_KEYWORDS = [
    "the", "le", "la", "les", "domaine", "chateau", "clos", "mas", "campo",
    "vina", "bodega", "cellers", "reserve", "cuvee", "old", "vine", "estate",
    "vineyard", "selection", "grand", "cru", "brut", "sec", "appellation",
    "contrôlée", "controlée", "cabernet", "sauvignon", "merlot",
    "chardonnay", "pinot", "noir", "gris", "grigio", "syrah", "shiraz",
    "zinfandel", "riesling", "malbec", "grenache", "blend", "rhône",
]
BRAND_REGIONS = ["rhone", "paso robles", "napa", "valley", "red", "white", "rose"]
BRAND_QUOTES = ["'", '"', "“", "”"]
BRAND_MAX_WORDS = 3
MISSING = "N/A"

# --- text limits ------------------------------------------------------------
STORED_PROFILE_CHARS = 1000
STORED_REVIEWS = 3
STORED_REVIEW_CHARS = 240
PROFILE_REVIEW_CHARS = 280
PROFILE_KEYWORDS = 6
QUERY_KEYWORDS = 8
VARIANT_KEYWORDS = 10
SNIPPET_CHARS = 200
ELLIPSIS = "…"
IDENTITY_LINE_PREFIXES = ["name:", "producer:", "vintage:", "price:"]

# --- default sentences ------------------------------------------------------
DEFAULT_AUTHOR = "Critic"
DEFAULT_REVIEW_AUTHOR = "Anonymous"
EMPTY_QUERY_TEXT = "Generic item description."
EMPTY_QUERY_TEXT_V1 = "Generic wine description. No tasting notes available."
QUERY_TEXT_V1_CHARS = 3000
NO_ITEM_TEXT = "No wine data available."
NO_REVIEWS_TEXT = "No detailed reviews available."

BUILT_TEXT_FALLBACK = "Basic wine entry for "
UNNAMED_ITEM = "Unknown Wine"
BASE_NAME_DEFAULT = "The Selected Wine"
RECOMMENDED_NAME_DEFAULT = "This Recommendation"
PAIR_NO_DESCRIPTION = "No desc."
BASE_NO_DESCRIPTION = "No description."
PAIR_DESCRIPTION_CHARS = 300
BASE_DESCRIPTION_CHARS = 200
PAIR_SNIPPETS = 2
BASE_SNIPPETS = 1
V1_UNKNOWN = "Unknown"
V1_NO_REVIEW = "No review text"
V1_REVIEWS = 3
BASE_BLURB_DEFAULT = "Enjoying {base_name}? Here's what makes it special based on its profile."
RECOMMENDED_BLURB_DEFAULT = "{rec_name} is a great pick if you like {base_name}, offering similar enjoyment."
BASE_ONLY_BLURB_DEFAULT = "You likely enjoy {base_name} for its general characteristics and profile."
FREE_TEXT_BASE_LABEL = "Your vibe: "
FREE_TEXT_BASE_DESCRIPTION = "A sommelier-style prompt (not a specific bottle)."

# --- taste sliders: column, low cut, high cut, low / middle / high words -----
TASTE_SCALES = [
    ("body", 30, 70, "light-bodied", "medium-bodied", "full-bodied"),
    ("acidity", 30, 70, "low-acid", "balanced acidity", "high-acid"),
    ("tannin", 30, 70, "soft tannins", "moderate tannins", "firm tannins"),
    ("fruit_earth", 30, 70, "fruit-forward", "balanced fruit/earth", "earthy/savory"),
    ("oak", 25, 65, "little/no oak", "some oak", "noticeable oak"),
]
FLIGHT_REQUEST = (
    "Recommend a small curated flight with a few close matches and a couple of "
    "adjacent explorations."
)

# --- search and selection limits --------------------------------------------
PRICE_MIN_OFF = 0.0
PRICE_MAX_OFF = 999999.0
WEIGHTS_V1 = {"tasting": 0.75, "category": 0.15, "country": 0.10}
NAME_CANDIDATES = 20
NAME_CANDIDATES_V1 = 10
NAME_MIN_SCORE = 75
NAME_MIN_SCORE_V1 = 90
MAX_SAME_PRODUCER_AS_BASE = 1
MAX_PER_PRODUCER = 2
SUGGESTIONS = 250
RECENT_LIKES = 5
TIER_CUTS = (3, 5)
TIER_NAMES = ("core", "explore", "wildcard")
CHART_PRICE_MARGIN = 10
CHART_SIMILARITY_MARGIN = 5


def similar_item_depth(k: int) -> int:
    """Candidates fetched per query text when looking for k similar items."""
    return max(k * 80, 400)


def free_text_depth(k: int) -> int:
    """Candidates fetched for a free-text request of k items."""
    return max(k * 12, 50)


def weighted_depth(k: int) -> int:
    """Candidates fetched by the weighted-vector search of k items."""
    return k * 2


# --- note sections ----------------------------------------------------------
SECTION_SEPARATOR = "||END_SECTION||"
SECTION_LABELS = (
    "BASE_WINE_BLURB:", "RECOMMENDED_WINE_BLURB:", "DETAILED_COMPARISON_MARKDOWN:",
)
UNSPLIT_NOTES_HEADING = "**AI Notes:**\n"
NOTES_PENDING_TEXT = "Detailed comparison notes are being crafted..."
