"""Fixed values. Results depend on these words and numbers, so they are stated plainly."""

# Decisions, weakest first: the severity of a decision is its position here.
DECISIONS = ("pass", "abstain", "cannot_verify", "fail")

FAILURE_CLASSES = (
    "fabricated_source",
    "unknown_variant",
    "source_mismatch",
    "stale_evidence",
    "unsupported_claim",
    "precondition_unknown",
    "policy_violation",
    "scope_violation",
    "malformed",
    "not_applicable",
    "internal_error",
)

POLICY_ACTIONS = ("block", "warn")

# Query parameters dropped from a URL: prefix test, any letter case.
TRACKING_PARAMS = ("utm_", "gclid", "fbclid", "ref=", "source=", "mc_cid", "mc_eid")

# The tracking parameter a drifted sample carries.
DRIFT_PARAMETER = "utm_source=newsletter"

# Keys of a capture document whose string value is a URL.
URL_KEYS = ("url", "html_url", "hn_url", "link", "source_url")

# A shared prefix shorter than this says nothing about provenance.
MIN_PREFIX_LENGTH = 20

# Punctuation and whitespace removed from titles before they are compared.
TITLE_PUNCTUATION = (
    r"[\s　·—–\-:：,，.。;；!！?？'\"“”‘’()（）\[\]【】《》<>/\\|*#`~+=]+"
)

# News lead-ins removed from the front of a title, each at most once, in this order.
TITLE_LEAD_INS = (
    "消息称", "报道称", "据报道", "据外媒", "官方", "官方", "突发", "独家", "解读", "解读",
)

CJK = r"一-鿿"

# Every character with the Unicode property White_Space.
WHITESPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Duplicate scoring bands.
DUPLICATE_SCORE = 0.86
BORDERLINE_SCORE = 0.60

# Article contract.
SECTION_CAPS = {"insights": 20, "github": 10, "papers": 12}
ITEM_KEYS = ("title", "prose", "fields", "summary", "comment", "body", "sources", "meta")
ARTICLE_KEYS = (
    "date", "generated_at", "title", "summary", "tldr", "sections", "references", "notes", "stats",
)

REFUND_CHECKS = ("order_status", "refund_window", "payment_reference", "currency")
MERGE_CHECKS = ("TESTS_PASS", "ARCHITECTURE_OK", "NO_UNINTENDED_SCOPE")

# Fragments that mark an argument name as a secret.
SECRET_WORDS = ("key", "token", "secret", "password", "authorization")

# Coverage signal per capture bucket: title field, url field, signal field, label.
CAPTURE_SIGNALS = {
    "hn": ("title", "url", "points", "HN"),
    "github": ("full_name", "html_url", "stars_per_day", "GitHub"),
    "arxiv": ("title", "url", "published", "arXiv"),
    "techmeme": ("title", "url", "hour", "Techmeme"),
}

SAMPLE_KINDS = (
    "legit",
    "legit_drift",
    "prefix_extension",
    "fabricated_suffix",
    "unrelated",
    "stale_evidence",
    "plausible_uncited",
)
EXPECT_PASS = "pass"
EXPECT_NOT_PASS = "not_pass"
