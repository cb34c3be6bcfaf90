"""Results depend on these exact words, patterns and numbers, so they are stated as they are."""

# File suffixes that count as logs.
LOG_SUFFIXES = [".log", ".csv", ".rpt", ".xel", ".docx", ".pdf", ".txt", ".json", ".xml"]

# Severities, change types, change sources and edit actions that a stored row may carry.
SEVERITIES = ["info", "warning", "error", "critical"]
SOURCE_TYPES = ["cloudwatch", "cloudtrail", "s3_bucket", "local_file"]
CHANGE_TYPES = [
    "node_added", "node_removed", "node_metadata_updated", "edge_added", "edge_removed",
    "health_status_changed", "health_error_recorded", "human_annotation",
]
CHANGE_SOURCES = ["log_analysis", "resource_discovery", "human_input", "topology_merge", "stale_prune"]
EDIT_ACTIONS = ["add_node", "remove_node", "add_edge", "remove_edge", "update_health", "annotate"]

# Patterns.
ARN_PATTERN = r"arn:aws:[a-z0-9\-]+:[a-z0-9\-]*:\d*:[a-zA-Z0-9\-_/:.]+"
REGION_PATTERN = (
    r"^(us|eu|ap|sa|ca|me|af|il|mx)-"
    r"(north|south|east|west|central|northeast|southeast|northwest|southwest)-[0-9]+$"
)
ANSI_PATTERN = r"\x1b\[[0-9;]*[a-zA-Z]|\x1b\[\?[0-9;]*[a-zA-Z]"
EVENT_BLOCK_PATTERN = r"(?s)<event\b[^>]*>.*?</event>"

# Relationship of an edge: the first row with a word inside the lower-cased message wins.
RELATIONSHIP_WORDS = [
    ("invokes", ["invok"]),
    ("reads_from", ["read", "get", "query", "select"]),
    ("writes_to", ["write", "put", "insert", "update"]),
    ("depends_on", ["timeout", "latency", "slow"]),
    ("access_denied_to", ["denied", "unauthorized", "forbidden"]),
    ("routes_to", ["route", "backend", "forward"]),
    ("publishes_to", ["publish", "notify"]),
    ("blocks", ["block", "lock", "contention"]),
    ("replicates_to", ["replica", "replication"]),
]
DEFAULT_RELATIONSHIP = "connected_to"

# Services whose own log records incoming requests, so the edge points at the log source.
CALLED_SERVICES = ["rds", "s3", "dynamodb", "sqs", "sns", "kinesis"]

DEFAULT_REGION = "us-east-1"
UNKNOWN = "unknown"

# Confidence labels.
CONFIDENCE_LABELS = {"HIGH": 0.85, "MEDIUM": 0.6, "LOW": 0.3, "VERY": 0.9}
DEFAULT_CONFIDENCE = 0.5
UNPARSED_CONFIDENCE = 0.3

# Limits.
FILE_SIZE_LIMIT = 50_000_000
TEXT_CHUNK_CHARS = 80_000
RETENTION_DAYS = 7
PRINTABLE_RUN = 8

# Head and usage table of a report.
REPORT_HEAD = "# Incident Report"
USAGE_HEAD = ["## Credit Usage", "", "| Metric | Value |", "|--------|-------|"]

# Node colours of the DOT export by service.
SERVICE_COLOURS = {
    "lambda": "lightyellow", "apigateway": "lightcyan", "rds": "lightblue",
    "dynamodb": "lightsalmon", "s3": "lightgreen", "sqs": "plum",
    "sns": "peachpuff", "ec2": "wheat", "iam": "lavender",
}
DEFAULT_COLOUR = "white"

# Model names: alias to full name, and the price per 1,000 tokens (input, output).
DEFAULT_MODEL = "claude-sonnet-4-6"
MODEL_ALIASES = {
    "claude-opus-4.6": "claude-opus-4-6",
    "claude-opus-4.5": "claude-opus-4-5",
    "claude-sonnet-4.6": "claude-sonnet-4-6",
    "claude-sonnet-4.5": "claude-sonnet-4-5",
    "claude-sonnet-4": "claude-sonnet-4-5",
    "claude-haiku-4.5": "claude-haiku-4-5",
    "opus": "claude-opus-4-6",
    "sonnet": "claude-sonnet-4-6",
    "haiku": "claude-haiku-4-5",
    "auto": "claude-sonnet-4-6",
}
MODEL_PRICES = {
    "claude-sonnet-4-6": ("0.003", "0.015"),
    "claude-sonnet-4-5": ("0.003", "0.015"),
    "claude-opus-4-6": ("0.015", "0.075"),
    "claude-opus-4-5": ("0.015", "0.075"),
    "claude-opus-4-7": ("0.015", "0.075"),
    "claude-haiku-4-5": ("0.0008", "0.004"),
}
DEFAULT_PRICE = ("0.003", "0.015")
CONTEXT_WINDOW = 200_000
CHARS_PER_TOKEN = 4

# Credit multipliers and context windows of the credit-priced models.
CREDIT_MULTIPLIERS = {
    "auto": 1.0,
    "claude-opus-4.6": 2.2,
    "claude-opus-4.6-1m": 2.2,
    "claude-sonnet-4.6": 1.3,
    "claude-sonnet-4.6-1m": 1.3,
    "claude-opus-4.5": 2.2,
    "claude-sonnet-4.5": 1.3,
    "claude-sonnet-4": 1.3,
    "claude-haiku-4.5": 0.4,
}
CREDIT_CONTEXT_WINDOWS = {"claude-opus-4.6-1m": 1_000_000, "claude-sonnet-4.6-1m": 1_000_000}
TOKENS_PER_CREDIT = 10_000

# Trigger routing.
INVESTIGATE_TOOL = "error_root_cause"
UPDATE_TOOL = "topology_update"
