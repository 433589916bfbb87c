"""Defaults of the operators. Every one can be overridden by a keyword argument."""

# These must stay as they are for results to agree with existing vaults.
EXCLUDED_EXTENSIONS = (
    "pdf", "docx", "xlsx", "pptx", "zip", "rar", "exe", "img", "png", "jpg", "jpeg", "gif",
)
LANGUAGE = "en"
PROMPT_VARIANT = "standard"
CHECK_MODEL = "sonar"
THEME_MODEL = "sonar"
LINK_MODEL = "sonar-medium-online"
ENHANCE_MODEL = "sonar-reasoning-pro"

FULL_CHUNK_CHARS = 4000
FIXED_SECTION_CHARS = 5000
SAMPLE_CHARS = 5000
CHECK_CHARS = 5000
COMPARE_CHARS = 3000
PREVIEW_CHARS = 200
REWRITE_SPLIT_CHARS = 15000
ESTIMATE_CHARS = 4000
AUTO_THRESHOLD = 3
NAMES_PER_CHUNK = 100
CACHE_TTL_MS = 24 * 60 * 60 * 1000
MIN_RELEVANCE = 0.3
MAX_SUGGESTIONS = 20
CURRENT_MODE_CANDIDATES = 20
MIN_ACCEPTED_CORRECTION_CHARS = 50
MIN_CONFIDENCE = 0.75

NO_CONTEXT = "No context available"
NO_ORIGINAL = "No original text available"
NO_SUGGESTED = "No suggested text available"

# (max_tokens, temperature) of each kind of request.
REQUEST_LIMITS = {
    "check": (4000, 0.1),
    "themes": (1000, 0.3),
    "link": (1500, 0.2),
    "correct": (6000, 0.1),
    "enhance": (6000, 0.1),
}

# Own choices, not given values.
THEMES_PER_NOTE = 5
COMMON_THEMES = 5
THEMES_PER_CHUNK = None
MIN_TERM_CHARS = 1
