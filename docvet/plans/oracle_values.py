"""Values of the oracle SQL, stated apart from the engine's rule packs and constants.

The DuckDB side of the rule, scoring and verification queries is built from this module only, so a
wrong keyword, label, threshold or allowed value on the engine's side shows as a mismatch.  In the
rules, ``{raw}`` is the field as text, ``{t}`` the trimmed field (with the rule's text for NULL) and
``{low}`` that in lower case.
"""

from __future__ import annotations

#: Text that stands for NULL before the rules, or None.
NULL_TEXT: dict[str, str | None] = {
    "API_TYPE": 'Unknown',
    "AUTH": 'Unknown',
    "BLOCKER": 'Unknown',
    "BUILDABILITY": 'Unknown',
    "FIX_API_TYPE": None,
    "FIX_AUTH": None,
    "FIX_BLOCKER": None,
    "FIX_BUILDABILITY": None,
    "FIX_CREDENTIAL": None,
    "FIX_MCP": None,
    "FIX_SCOPE": None,
    "FIX_SELF_SERVE": None,
    "MCP": 'Unknown',
    "SELF_SERVE": 'Unknown',
}

RULES: dict[str, str] = {
    "API_TYPE": """CASE
        WHEN contains({low}, 'graphql') AND contains({low}, 'rest') THEN 'Mixed'
        WHEN (contains({low}, 'graphql')) THEN 'GraphQL'
        WHEN (contains({low}, 'soap')) THEN 'SOAP'
        WHEN (contains({low}, 'rest') OR contains({low}, 'api')) THEN 'REST'
        WHEN {low} IN ('unknown', 'none', 'nan') THEN 'Unknown'
        ELSE 'Other'
        END""",
    "AUTH": """CASE
        WHEN (contains({low}, 'oauth')) THEN 'OAuth2'
        WHEN (contains({low}, 'api key') OR contains({low}, 'api-key')) THEN 'API Key'
        WHEN (contains({low}, 'personal access') OR contains({low}, 'pat')) THEN 'PAT'
        WHEN (contains({low}, 'basic')) THEN 'Basic'
        WHEN {low} IN ('unknown', 'none', 'nan', '') THEN 'Unknown'
        ELSE 'Other'
        END""",
    "BLOCKER": """CASE
        WHEN {low} IN ('', 'none', 'unknown', 'nan') THEN 'Unknown'
        WHEN (contains({low}, 'paid') OR contains({low}, 'plan')) THEN 'Paid plan required'
        WHEN (contains({low}, 'partner') OR contains({low}, 'approval')) THEN 'Partner approval'
        WHEN (contains({low}, 'no public api') OR contains({low}, 'no api') OR contains({low}, 'unsupported')) THEN 'No public API'
        WHEN (contains({low}, 'limited') OR contains({low}, 'poor') OR contains({low}, 'documentation')) THEN 'Limited documentation'
        ELSE {t}
        END""",
    "BUILDABILITY": """CASE
        WHEN (contains({low}, 'yes')) THEN 'Yes'
        WHEN (contains({low}, 'partial') OR contains({low}, 'limited')) THEN 'Partial'
        WHEN (contains({low}, 'no') OR contains({low}, 'contact')) THEN 'No'
        WHEN {low} IN ('unknown', 'none', 'nan') THEN 'Unknown'
        ELSE 'Other'
        END""",
    "FIX_API_TYPE": """CASE
        WHEN {raw} IS NULL THEN 'Unknown'
        ELSE CASE WHEN {t} IN ('REST', 'GraphQL', 'SOAP', 'SDK', 'Unknown') THEN {t} ELSE 'Unknown' END
        END""",
    "FIX_AUTH": """CASE
        WHEN {raw} IS NULL THEN 'Unknown'
        WHEN (contains({low}, 'oauth')) THEN 'OAuth 2.0'
        WHEN (contains({low}, 'api key')) THEN 'API key'
        WHEN (contains({low}, 'bearer')) THEN 'Bearer token'
        WHEN (contains({low}, 'basic')) THEN 'Basic auth'
        WHEN (contains({low}, 'personal access token')) THEN 'Personal access token'
        ELSE {t}
        END""",
    "FIX_BLOCKER": """CASE
        WHEN {raw} IS NULL THEN 'Unknown'
        WHEN {low} IN ('', 'none', 'unknown', 'n/a', 'na') THEN 'None'
        ELSE CASE WHEN {t} IN ('None', 'Unknown') THEN {t} ELSE 'Unknown' END
        END""",
    "FIX_BUILDABILITY": """CASE
        WHEN {raw} IS NULL THEN 'Unknown'
        WHEN {low} IN ('yes', 'high', 'highly buildable', 'buildable') THEN 'Yes'
        WHEN {low} IN ('partially', 'partial', 'maybe', 'somewhat') THEN 'Partially'
        WHEN {low} IN ('no', 'not buildable') THEN 'No'
        ELSE CASE WHEN {t} IN ('Yes', 'Partially', 'No', 'Unknown') THEN {t} ELSE 'Unknown' END
        END""",
    "FIX_CREDENTIAL": """CASE
        WHEN {raw} IS NULL THEN 'Unknown'
        WHEN {low} IN ('', 'unknown', 'n/a', 'na') THEN 'Unknown'
        WHEN contains({low}, 'developer account') AND contains({low}, 'oauth') THEN 'Developer account + Connected App + OAuth'
        WHEN (contains({low}, 'personal access token')) THEN 'Personal access token'
        WHEN (contains({low}, 'internal integration token')) THEN 'Internal Integration Token'
        WHEN (contains({low}, 'programmatic api') OR contains({low}, 'programmatic key')) THEN 'Programmatic API Key'
        WHEN (contains({low}, 'secret api key') OR contains({low}, 'secret key')) THEN 'Secret API Key'
        WHEN (contains({low}, 'service account')) THEN 'Service Account Key'
        ELSE {t}
        END""",
    "FIX_MCP": """CASE
        WHEN {raw} IS NULL THEN 'Unknown'
        WHEN {low} IN ('true', 'yes') THEN 'Yes'
        WHEN {low} IN ('false', 'no') THEN 'No'
        ELSE CASE WHEN {t} IN ('Yes', 'No', 'Unknown') THEN {t} ELSE 'Unknown' END
        END""",
    "FIX_SCOPE": """CASE
        WHEN {raw} IS NULL THEN 'Unknown'
        WHEN (contains({low}, 'very large')) THEN 'Very Large'
        WHEN (contains({low}, 'large')) THEN 'Large'
        WHEN (contains({low}, 'medium')) THEN 'Medium'
        WHEN (contains({low}, 'small')) THEN 'Small'
        ELSE CASE WHEN {t} IN ('Small', 'Medium', 'Large', 'Very Large', 'Unknown') THEN {t} ELSE 'Unknown' END
        END""",
    "FIX_SELF_SERVE": """CASE
        WHEN {raw} IS NULL THEN 'Unknown'
        WHEN {low} IN ('true', 'yes', 'self serve', 'self-serve') THEN 'Self Serve'
        WHEN {low} IN ('false', 'no') THEN 'Unknown'
        ELSE CASE WHEN {t} IN ('Self Serve', 'Paid Plan', 'Enterprise', 'Partner Required', 'Admin Approval', 'Unknown') THEN {t} ELSE 'Unknown' END
        END""",
    "MCP": """CASE
        WHEN (contains({low}, 'yes') OR contains({low}, 'supported')) THEN 'Yes'
        WHEN (contains({low}, 'no') OR contains({low}, 'unsupported')) THEN 'No'
        WHEN {low} IN ('unknown', 'none', 'nan') THEN 'Unknown'
        ELSE 'Unknown'
        END""",
    "SELF_SERVE": """CASE
        WHEN (contains({low}, 'self')) THEN 'Self Serve'
        WHEN (contains({low}, 'enterprise')) THEN 'Enterprise'
        WHEN (contains({low}, 'admin') OR contains({low}, 'approval')) THEN 'Admin Approval'
        WHEN (contains({low}, 'paid') OR contains({low}, 'sales') OR contains({low}, 'trial')) THEN 'Paid Plan'
        WHEN {low} IN ('unknown', 'none', 'nan') THEN 'Unknown'
        ELSE 'Other'
        END""",
}

ALLOWED_VALUES = {
    "self_serve": ('Self Serve', 'Paid Plan', 'Enterprise', 'Partner Required', 'Admin Approval', 'Unknown'),
    "credential_requirement": ('Secret API Key', 'Internal Integration Token', 'Programmatic API Key', 'Service Account Key', 'Developer account + Connected App + OAuth', 'API key', 'API token', 'OAuth credentials', 'Access token', 'Personal access token', 'Unknown'),
    "api_type": ('REST', 'GraphQL', 'SOAP', 'SDK', 'Unknown'),
    "api_scope": ('Small', 'Medium', 'Large', 'Very Large', 'Unknown'),
    "mcp_support": ('Yes', 'No', 'Unknown'),
    "buildability": ('Yes', 'Partially', 'No', 'Unknown'),
    "blocker": ('None', 'Unknown'),
}
SCOPE_BUCKETS = ((500, 'Very Large'), (200, 'Large'), (50, 'Medium'), (1, 'Small'))
FILL_FIELDS = ('description', 'auth_method', 'self_serve', 'credential_requirement', 'api_type', 'api_scope', 'mcp_support', 'buildability', 'blocker', 'evidence_url')
UNFILLED_TOKENS = ('', 'Unknown')
UNFILLED_PENALTY = 3
RETRY_PENALTY = 5
CONFIDENCE_CAP = 95
PENALTY_CAP = 25
PENALTY_PER_ISSUE = 5
BLOCKER_ACCEPTED = ('None', 'Unknown')
MCP_EVIDENCE_NEEDLES = ('mcp', 'model context protocol')
DOC_INDICATORS = ('developer.', 'developers.', 'docs.', 'api.', '.dev', 'official', 'reference')
DOC_BLOCKED = ('medium.com', 'reddit.com', 'stoplight.io', 'rapidapi.com', 'youtube.com', 'blog.')
SCOPE_PLACEHOLDERS = ('', 'Unknown')
CATEGORY_SYNONYMS = ('sales', 'crm', 'crm and sales')
CATEGORY_CANONICAL = 'CRM and Sales'
CATEGORY_ISSUE = 'Category must match known category: {category}'
ALLOWED_ISSUE = '{field} must be one of: {values}'
BLOCKER_ISSUE = 'blocker must be None unless the docs clearly name a blocker'
MCP_EVIDENCE_ISSUE = 'mcp_support should be Unknown unless the docs explicitly mention MCP'
TRUE_TOKENS = ('true', '1', 'yes')
DESCRIPTION_MAX_CHARS = 200
