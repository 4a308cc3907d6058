"""Thresholds, limits and lists the results depend on."""

# --- clustering and embedding (fixed values) ---
EMBED_DIM = 384
EMBED_BODY_CHARS = 2000
SIMILARITY_THRESHOLD = 0.75
LOOKBACK_DAYS = 3
STORY_TITLE_CHARS = 500

# --- article state machine (fixed values) ---
MAX_ATTEMPTS = 3
ERROR_CHARS = 2000
PROCESSING_STATES = (
    "discovered", "extracted", "embedded", "clustered", "analyzed", "complete",
    "failed_extract", "failed_embed", "failed_analyze",
)
NEXT_STATE = {
    "discovered": "extracted",
    "extracted": "embedded",
    "embedded": "clustered",
    "clustered": "analyzed",
}
FAILED_STATE = {
    "discovered": "failed_extract",
    "extracted": "failed_embed",
    "clustered": "failed_analyze",
}
RUN_TRIGGERS = ("cron", "manual", "backfill")
RUN_STATUSES = ("running", "success", "failed", "skipped")
RUN_PURPOSES = ("enrich", "compare")

# --- enrichment and comparison (fixed values) ---
HEADLINE_CHARS = 1000
PROMPT_BODY_CHARS = 8000
ENRICH_LIMIT = 20
ENRICH_PER_STORY = 4
HOME_TOP_STORIES = 8
HOME_FRESH_HOURS = 72
COMPARE_LIMIT = 10
COMPARE_MIN_ARTICLES = 2
COMPARE_MIN_OUTLETS = 2
FRAMING_LABELS = ("critical", "neutral", "supportive", "mixed", "insufficient")
DISPLAY_LABELS = ("critical", "neutral", "supportive", "mixed", "insufficient", "unlabeled")
STANCE_WORDS = {
    "supports": "supports", "support": "supports", "supportive": "supports",
    "criticizes": "criticizes", "critical": "criticizes", "criticises": "criticizes",
    "neutral": "neutral",
    "unclear": "unclear", "mixed": "unclear",
}
QUOTE_MARKS = "\"“”'‘’"
NO_SPEAKER = "Unattributed"
QUOTE_STANCES = ("supports", "criticizes", "neutral", "unclear")
ENTITY_KINDS = ("people", "organizations", "locations", "other")
SOURCE_CATEGORIES = (
    "government", "opposition", "expert", "civil_society", "corporate", "unnamed_source", "other",
)
# Two cut-offs live side by side: analysts label articles at 0.33, outlet
# averages are bucketed at 0.15.
FRAMING_BUCKET_CUT = 0.15

# --- positive stories (fixed values) ---
POSITIVE_WINDOW_DAYS = 7
POSITIVE_MIN_OUTLETS = 3
POSITIVE_MIN_ANALYZED = 3
POSITIVE_MEAN = 0.15
POSITIVE_ARTICLE = 0.10
POSITIVE_FRACTION = 0.60
POSITIVE_LIMIT = 12

# --- publication ratings (fixed values): (rating source, lowered label) -> category ---
BIAS_LABELS = {
    ("MBFC", "left"): "left",
    ("MBFC", "left-center"): "left",
    ("MBFC", "least biased"): "center",
    ("MBFC", "center"): "center",
    ("MBFC", "right-center"): "right",
    ("MBFC", "right"): "right",
    ("AdFontes", "left"): "left",
    ("AdFontes", "skews left"): "left",
    ("AdFontes", "middle"): "center",
    ("AdFontes", "skews right"): "right",
    ("AdFontes", "right"): "right",
}
BIAS_CATEGORIES = ("left", "center", "right")
BIAS_SOURCE_PRIORITY = ("MBFC",)
BIAS_MIN_OUTLETS = 3
BIAS_MIN_RATED = 3

# --- image links (fixed values) ---
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".avif")
IMAGE_BAD_SUBSTRINGS = (
    "logo", "sprite", "favicon", "placeholder", "default-", "pixel", "1x1", "spacer", "beacon",
    "tracker", "tracking", "advert", "google-analytics", "doubleclick", "/ads/", "/ad-", "-ad.",
    "amazon-adsystem",
)
IMAGE_MIN_SIDE = 200
OG_PROPERTIES = ("og:image", "og:image:url", "og:image:secure_url")
OG_NAMES = ("og:image", "og:image:url")
TWITTER_NAMES = ("twitter:image", "twitter:image:src")

# --- home page sections (fixed values) ---
HOME_POOL = 40
HOT_NOW = 8
JUST_UPDATED = 6
DISCOVER = 9

# --- text folding for grounding checks (fixed values) ---
FOLD_FROM = "\u2018\u2019\u201c\u201d\u2013\u2014\u2011\u2010\u00a0\u2009\u202f\u200b"
FOLD_TO = "''\"\"----   "  # one shorter: the zero-width space is deleted
ELLIPSIS = "\u2026"

# --- English stop words of the public Snowball list (fixed values) ---
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
    her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now
    """.split()
)
