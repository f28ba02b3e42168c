"""Fixed values of the crawl-queue data model.

Everything in the first block must equal the values the original service
uses, otherwise results differ (status words, literal nulls, URL shapes,
defaults, read bounds, report layout).  Operators take most of them as
parameters with these values as defaults.
"""

# ---------------------------------------------------------------------------
# Fixed values (must match the original service for the same results)
# ---------------------------------------------------------------------------

# Status vocabulary of every queue.  NULL status reads as pending for seed
# and URL queues, not for keyword queues.
PENDING = "pending"
PROCESSING = "processing"
COMPLETED = "completed"
FAILED = "failed"
SKIPPED = "skipped"

# Resume priority of URL rows: processing, failed, skipped, pending/NULL, other.
RESUME_PRIORITY = (("processing", 0), ("failed", 1), ("skipped", 2), ("pending", 3))
RESUME_PRIORITY_NULL = 3
RESUME_PRIORITY_OTHER = 4

# Text values that mean "no value" in incoming social profiles.
NULL_LITERALS = ("None", "null", "undefined", "")

# Owner label used by the roll-up when a row has no owner.
UNASSIGNED = "unassigned"

# Suffix appended to every keyword of the first platform.
KEYWORD_SITE_SUFFIX = " site:linkedin.com"

# A valid seed URL starts with this prefix and ends with this suffix.
SEED_URL_PREFIX = "https://www.facebook.com/"
SEED_URL_SUFFIX = "/followers"

# Friend URLs of the second platform are this base followed by the friend id.
FRIEND_URL_BASE = "https://www.facebook.com/"

# Path segment that precedes the account name in first-platform profile URLs.
ACCOUNT_URL_MARKER = "in"

# Frontier expansion stops once depth + 1 would exceed this value.
MAX_CRAWL_DEPTH = 3
DEFAULT_CRAWL_DEPTH = 1

# Defaults written into new queue rows.
DEFAULT_START = 0
DEFAULT_MAX_PROFILES = 100

# Read bounds: (default limit, max limit) per read.
LIMIT_KEYWORDS = (100, 1000)
LIMIT_PROFILES = (100, 1000)
LIMIT_SEEDS_PENDING = (10, 100)
LIMIT_SEEDS_PAGE = (100, 500)
LIMIT_URLS = (200, 500)

# Update payload columns each patch route accepts.
ALLOWED_KEYWORD_PATCH = ("status", "start")
ALLOWED_STATUS_PATCH = ("status",)
ALLOWED_SEED_PATCH = ("status", "extension_id")

# String fields of social profiles that NULL turns into "" (only when present).
SOCIAL_TEXT_FIELDS = (
    "username", "gender", "birthday", "current_city", "hometown", "email",
    "phone_number", "status",
)

# Array fields of social profiles that NULL or a non-array turns into [].
SOCIAL_ARRAY_FIELDS = (
    "experiences", "educations", "posts", "friend_lists", "languages", "websites",
)

# Error report layout.
ERROR_SUBJECT_SUFFIX = " Error"
ERROR_REPORT_TITLE_SUFFIX = " Error Report"
ERROR_RULE_EXTRA = 13  # '=' rule is len(title) + 13 characters long
ERROR_DETAILS_RULE = "-" * 8
ERROR_CONTEXT_RULE = "-" * 25
ERROR_REPORT_FOOTER = (
    "--\n"
    "This error report was automatically generated by the Extension Error.\n"
    "Please investigate and resolve the issue as soon as possible."
)
ERROR_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# ---------------------------------------------------------------------------
# Engine defaults of this library (not taken from the original service)
# ---------------------------------------------------------------------------

# A merge source with at most this many rows is broadcast; larger sources are
# merged by a shuffle join.  The count that decides it is bounded (limit + 1).
BROADCAST_MAX_ROWS = 200_000

# Column written by merge operators: insert / update / keep / reject.
ACTION_COL = "_action"
REASON_COL = "_reject_reason"
