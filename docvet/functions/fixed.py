"""Fixed values.

Everything in this module is a value that must stay exactly as written for
results to agree with the behaviour being reproduced: allowed label sets,
keyword lists, alias lists, patterns, thresholds, limits and message formats.
They are listed plainly, in their natural order.  Operators take them as
default arguments, so callers can pass their own.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# Allowed values per governed field, in field order (field order sets the
# order of verification issues).
ALLOWED_VALUES: dict[str, tuple[str, ...]] = {
    "self_serve": ("Self Serve", "Paid Plan", "Enterprise", "Partner Required", "Admin Approval", "Unknown"),
    "credential_requirement": (
        "Secret API Key",
        "Internal Integration Token",
        "Programmatic API Key",
        "Service Account Key",
        "Developer account + Connected App + OAuth",
        "API key",
        "API token",
        "OAuth credentials",
        "Access token",
        "Personal access token",
        "Unknown",
    ),
    "api_type": ("REST", "GraphQL", "SOAP", "SDK", "Unknown"),
    "api_scope": ("Small", "Medium", "Large", "Very Large", "Unknown"),
    "mcp_support": ("Yes", "No", "Unknown"),
    "buildability": ("Yes", "Partially", "No", "Unknown"),
    "blocker": ("None", "Unknown"),
}

# Issue messages.
CATEGORY_ISSUE = "Category must match known category: {category}"
ALLOWED_ISSUE = "{field} must be one of: {values}"  # values: sorted, joined by ", "
BLOCKER_ISSUE = "blocker must be None unless the docs clearly name a blocker"
MCP_EVIDENCE_ISSUE = "mcp_support should be Unknown unless the docs explicitly mention MCP"
MCP_EVIDENCE_NEEDLES = ("mcp", "model context protocol")
BLOCKER_ACCEPTED = ("None", "Unknown")

# Penalty: 5 points per issue, at most 25, floor 0.
PENALTY_PER_ISSUE = 5
PENALTY_CAP = 25

# Extraction scoring: the ten fields whose fill rate gives the confidence.
FILL_FIELDS = (
    "description",
    "auth_method",
    "self_serve",
    "credential_requirement",
    "api_type",
    "api_scope",
    "mcp_support",
    "buildability",
    "blocker",
    "evidence_url",
)
UNFILLED_TOKENS = ("", "Unknown")  # plus NULL
UNFILLED_PENALTY = 3
RETRY_PENALTY = 5
CONFIDENCE_CAP = 95

# Description fallback: these descriptions are replaced ("{name}" is the app).
DESCRIPTION_PLACEHOLDERS = ("", "Unknown", "{name} API", "{name} API documentation")
DESCRIPTION_MAX_CHARS = 200
SCOPE_PLACEHOLDERS = ("", "Unknown")

# Endpoint mentions, the stated count, and the size buckets.
ENDPOINT_PATTERN = r"\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/[^\s]*"
STATED_COUNT_PATTERN = r"(\d{1,4})\s+(?:endpoints|operations|routes|API methods)"
SCOPE_BUCKETS = ((500, "Very Large"), (200, "Large"), (50, "Medium"), (1, "Small"))

# Document collection.
SEARCH_TEXT = "\n{name} developer documentation API overview getting started authentication\n"
DOC_INDICATORS = ("developer.", "developers.", "docs.", "api.", ".dev", "official", "reference")
DOC_BLOCKED = ("medium.com", "reddit.com", "stoplight.io", "rapidapi.com", "youtube.com", "blog.")
PAGES_PER_APP = 3
CHARS_PER_PAGE = 1500
PAGE_HEADER = "\n\n--- PAGE: {url} ---\n\n"
EVIDENCE_SEPARATOR = ", "
REQUEST_DOC_CHARS = 6000

# Failure outputs and run log.
NO_RESULT_ERROR = "No result returned"
NO_RESULT_NOTES = "No documentation or research result"
NO_RESULT_LOG = "No documentation or research failed"
EXCEPTION_NOTES = "Exception during research"
LOG_OK = "✔"
LOG_FAIL = "❌"

# Canonical category.
CATEGORY_SYNONYMS = ("sales", "crm", "crm and sales")
CATEGORY_CANONICAL = "CRM and Sales"

# Named sample (10 apps).
SAMPLE_APPS = (
    "Salesforce",
    "HubSpot",
    "Slack",
    "Stripe",
    "GitHub",
    "Shopify",
    "Notion",
    "Zendesk",
    "Twilio",
    "MongoDB Atlas",
)

# Verification sample: confidence below this, or flagged.
LOW_CONFIDENCE = 80

# Boolean text.
TRUE_TOKENS = ("true", "1", "yes")

# Missing-value tokens that a pandas CSV reader turns into NULL by default
# (the reports were produced by such a reader); "none", "No", "Unknown" stay.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Logical field -> physical column aliases, first alias wins (normalised pass).
NORMALISED_ALIASES: dict[str, tuple[str, ...]] = {
    "App": ("App", "app", "name"),
    "Category": ("Category", "category"),
    "Auth Method": ("Auth Method", "auth_method", "auth", "authentication"),
    "API Type": ("API Type", "api_type", "api"),
    "Self Serve": ("Self Serve", "self_serve", "selfserve"),
    "Buildability": ("Buildability", "buildability"),
    "Blocker": ("Blocker", "blocker"),
    "MCP": ("MCP", "mcp", "mcp_support"),
    "Confidence": ("Confidence", "confidence"),
    "Needs Review": ("Needs Review", "manual_review", "needs_review"),
}

# Logical field -> aliases (raw-value pass).
RAW_ALIASES: dict[str, tuple[str, ...]] = {
    "app": ("App", "app", "name"),
    "category": ("Category", "category"),
    "auth_method": ("Auth Method", "auth_method", "auth", "authentication"),
    "self_serve": ("Self Serve", "self_serve", "selfserve"),
    "api_type": ("API Type", "api_type", "api"),
    "buildability": ("Buildability", "buildability"),
    "mcp_support": ("MCP", "mcp", "mcp_support"),
    "blocker": ("Blocker", "blocker"),
    "confidence": ("Confidence", "confidence"),
    "needs_review": ("Needs Review", "manual_review", "needs_review"),
    "issues": ("Issues", "issues"),
    "credential_requirement": ("Credential Requirement", "credential_requirement"),
}

# Result table: snake_case -> display name, in output order.
DISPLAY_NAMES = (
    ("name", "App"),
    ("category", "Category"),
    ("description", "Description"),
    ("auth_method", "Auth Method"),
    ("credential_requirement", "Credential Requirement"),
    ("self_serve", "Self Serve"),
    ("api_type", "API Type"),
    ("api_scope", "API Surface"),
    ("mcp_support", "MCP"),
    ("buildability", "Buildability"),
    ("blocker", "Blocker"),
    ("evidence_url", "Evidence URL"),
    ("confidence", "Confidence"),
    ("manual_review", "Needs Review"),
    ("issues", "Issues"),
)

# Report: top-k per section, review-rate threshold for the findings line.
TOP_K = 5
TOP_K_CATEGORIES = 6
REVIEW_RATE_FINDING = 10
FINDING_AUTH = "Top auth method is {value} ({share}%)."
FINDING_SELF_SERVE = "Most products are {value} ({share}%)."
FINDING_BLOCKER = "Most common blocker is {value}."
FINDING_REVIEW = "{rate}% of rows need manual review."
NO_RESULTS_MESSAGE = "No research results found."
HISTOGRAM_BINS = 10
# ------------------------------------------------------------ END FIXED VALUES
