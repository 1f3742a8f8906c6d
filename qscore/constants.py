"""The scores, word lists, patterns and texts every result depends on."""

# ---------------------------------------------------------------------------
# Pillars and their maximum points (fixed values).
STATIC, ARCHITECTURE, VERIFICATION, SECURITY = (
    "static",
    "architecture",
    "verification",
    "security",
)
PILLAR_MAX = {STATIC: 20.0, ARCHITECTURE: 25.0, VERIFICATION: 35.0, SECURITY: 20.0}
PILLAR_TITLES = {
    STATIC: "Static Code Health",
    ARCHITECTURE: "Engineering Architecture",
    VERIFICATION: "Dynamic Verification",
    SECURITY: "Security & Supply Chain",
}
STATIC_DEDUCTION = 0.5
ARCHITECTURE_DEDUCTION = 1.0
BLOCKING_SEVERITIES = ("CRITICAL", "HIGH")
PRIORITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

# Exit codes (fixed values).
EXIT_PASS, EXIT_ERROR, EXIT_FAIL = 0, 1, 2

# ---------------------------------------------------------------------------
# Path word lists (fixed values).
SOURCE_EXTENSIONS = (
    ".go", ".py", ".js", ".ts", ".java", ".rb", ".rs",
    ".c", ".cpp", ".h", ".cs", ".php", ".swift", ".kt",
)
NON_CODE_EXTENSIONS = (
    ".md", ".txt", ".json", ".yml", ".yaml", ".toml", ".xml",
    ".html", ".css", ".scss", ".lock", ".sum", ".svg", ".png",
    ".jpg", ".gif", ".ico", ".woff", ".woff2", ".ttf", ".eot",
)
NON_CODE_NAMES = (
    "LICENSE", "LICENSE.md", "LICENSE.txt", ".gitignore", ".editorconfig",
    "Makefile", "Dockerfile", "docker-compose.yml", "docker-compose.yaml",
)
DEFAULT_EXCLUSIONS = ("**/vendor/**", "**/node_modules/**", "**/dist/**")
UNMATCHED_PATTERN_TEXT = "exclusion pattern matched no files: "
TRIVIAL_TEXT = "Changes are trivial (non-code or whitespace-only): "

# ---------------------------------------------------------------------------
# Regular expressions (fixed values).
_SECRET_PATTERNS = (
    r"""(api[_-]?key|apikey)\s*[=:]\s*["'][^"']{8,}["']""",
    r"""(secret|password|passwd|pwd)\s*[=:]\s*["'][^"']{4,}["']""",
    r"sk-[a-zA-Z0-9]{10,}",
)
_SCRUB_PATTERNS = (
    r"""(api[_-]?key|apikey)\s*[:?]?=\s*["'][^"']{8,}["']""",
    r"""(secret|password|passwd|pwd)\s*[:?]?=\s*["'][^"']{4,}["']""",
    r"sk-[a-zA-Z0-9]{10,}",
    r"Bearer\s+[a-zA-Z0-9\-._~+/]+=*",
    r"-----BEGIN\s+(RSA\s)?PRIVATE\s+KEY-----",
)
# Java's own ``\s`` also takes the vertical tab, which is not meant here. ``iu`` folds case over Unicode.
SECRET_PATTERNS, SCRUB_PATTERNS = (
    tuple(p.replace(r"\s", r"[\t\n\f\r ]") for p in patterns)
    for patterns in (_SECRET_PATTERNS, _SCRUB_PATTERNS)
)
FOLD = "(?iu)"
REDACTED = "[REDACTED]"

# Unicode White_Space, as the inside of a character class.
WHITE_SPACE = (
    r"\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
)
# A line that opens a function once its surrounding white space is trimmed.
FUNCTION_HEADER = (
    "^[" + WHITE_SPACE + "]*(?:func|def) [" + WHITE_SPACE + "]*[^" + WHITE_SPACE + "]"
)
# Names that say nothing about their purpose, and branching tokens: our own lists.
POOR_NAME = r"\b(a|b|x|tmp|temp|data\d+)\b"
BRANCH_TOKEN = r"\b(?:if|for|while|case|catch)\b|&&|\|\|"
MAX_NESTING = 3
MAX_COMPLEXITY = 10

# ---------------------------------------------------------------------------
# Finding texts (fixed values).
SECRET_TEXT = "Potential hardcoded secret detected"
SECRET_FIX = "Move this secret to an environment variable or a secure secrets manager"
DIFF_SECRET_TEXT = "Potential hardcoded secret in diff"
DIFF_SECRET_FIX = "Move this secret to an environment variable or secrets manager"
NESTING_TEXT = "Function has nesting depth of %d (max recommended: %d)"
NESTING_FIX = (
    "Extract nested logic into separate helper functions to reduce complexity"
)

# ---------------------------------------------------------------------------
# Verification and review (fixed values).
MUTATION_FACTOR = 0.8
MUTATION_TEXT = (
    "Mutation coverage %s%% is below the %s%% floor; "
    "Verification pillar penalized by 20%%"
)
DEFAULT_THRESHOLD = 75.0
DEFAULT_MUTATION_FLOOR = 80.0
FARLEY_WEIGHTS = {
    "u": 1.5, "m": 1.5, "r": 1.25, "a": 1.0, "n": 1.0, "g": 1.0, "f": 0.75, "t": 1.0,
}
FARLEY_DIVISOR = 9.0
FARLEY_POINTS = 3.5
TIERS = (
    (90.0, "Elite Tier"),
    (75.0, "Target Standard"),
    (60.0, "Technical Debt Alert"),
)
LOWEST_TIER = "Critical Remediate Status"
PAYLOAD_BYTES = 24 * 1024
PAYLOAD_MARKER = (
    "\n[truncated: remaining files omitted to fit provider context window]\n"
)
REVIEW_ATTEMPTS = 3
REVIEW_TIMEOUT_MS = 4000
# What a reviewing model is asked for; the answer is read by schemas.EVALUATION.
_ANSWER = (
    '{"pillar_adjustments": {"static_health_deduction": number, "architecture_deduction": number}, '
    '"remediations": [{"priority": text, "pillar": text, "location": text, "finding": text, '
    '"actionable_fix": text}]}'
)
REVIEW_PROMPT = (
    f"You read source code for a maintainer. Reply in JSON of this shape alone: {_ANSWER}. "
    f"Deductions run from 0 to {PILLAR_MAX[STATIC]:.0f} and from 0 to {PILLAR_MAX[ARCHITECTURE]:.0f} points; "
    f"priority is one of {', '.join(PRIORITIES[1:])}, pillar one of {', '.join(PILLAR_MAX)}. "
    "Take points off where a newcomer would lose their way: words that mislead, duties that are mixed up, "
    "parts that cannot be tried on their own. What a linter reports has been counted already. "
    "Name a place and a next step in every remediation."
)
# Report texts (fixed values).
MARKDOWN_HEAD = (
    "## Quality Report", "", "**Quality Score: {total} / 100**", "",
    "### Pillar Breakdown", "", "| Pillar | Score |", "| --- | --- |",
)
MARKDOWN_FINDINGS = (
    "", "### Findings", "", "| Priority | Location | Lines | Description |",
    "| --- | --- | --- | --- |",
)
MARKDOWN_FIXES = ("", "### Remediations", "")
AUTH_TYPES = ("api_key", "oauth_browser")
# Policy errors (fixed values); the required fields are tested in this order.
OAUTH_FIELDS = (
    "oauth_token_url",
    "oauth_auth_url",
    "oauth_client_id_env_var",
    "oauth_client_secret_env_var",
    "oauth_redirect_url",
)
UNREADABLE_TEXT = "policy is not valid JSON"
BAD_THRESHOLD_TEXT = "target_threshold must be between 0 and 100, got %f"
BAD_AUTH_TEXT = "unsupported auth_type: \"%s\"; must be 'api_key' or 'oauth_browser'"
MISSING_FIELD_TEXT = "%s is required when auth_type is 'oauth_browser'"
