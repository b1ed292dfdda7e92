"""Vocabularies, tables, patterns and limits that results depend on.

Patterns are written for java.util.regex; UNICODE asks for Unicode classes and for "." to stop at a line feed only.
"""

UNICODE = "(?Ud)"

# Level aliases.
LEVEL_ALIASES = {
    "TRACE": "TRACE", "TRC": "TRACE", "VERBOSE": "TRACE",
    "DEBUG": "DEBUG", "DBG": "DEBUG",
    "INFO": "INFO", "INF": "INFO", "INFORMATION": "INFO", "INFORMATIONAL": "INFO",
    "NOTICE": "NOTICE",
    "WARN": "WARN", "WARNING": "WARN", "WRN": "WARN",
    "ERROR": "ERROR", "ERR": "ERROR", "EROR": "ERROR", "SEVERE": "ERROR", "FAIL": "ERROR", "FAILURE": "ERROR",
    "CRIT": "CRITICAL", "CRITICAL": "CRITICAL", "FATAL": "CRITICAL", "ALERT": "CRITICAL", "EMERG": "CRITICAL", "EMERGENCY": "CRITICAL", "PANIC": "CRITICAL",
}
# Levels from least to most severe, syslog severities by number, buckets and abbreviations.
LEVELS = ("TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "ERROR", "CRITICAL")
SYSLOG = ("CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG")
BUCKETS = {"all": (), "trace": ("TRACE",), "debug": ("DEBUG", "TRACE"), "info": ("INFO", "NOTICE"), "warn": ("WARN",), "error": ("ERROR", "CRITICAL")}

# Line formats.
LEVEL_TOKEN = "|".join(sorted(LEVEL_ALIASES, key=len, reverse=True))
ISO_TIME = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
ISO_ZONE = r"(?:Z|[+-]\d{2}:?\d{2})?"
PYTHON_LOGGING = rf"^({ISO_TIME})\s+-\s+(\w+)\s+-\s+(.*)$"
ISO_LEVEL = rf"(?iu)^\[?({ISO_TIME}{ISO_ZONE})\]?[\s:|-]+\[?({LEVEL_TOKEN})\]?[\s:|-]*(.*)$"
ISO_PLAIN = rf"^\[?({ISO_TIME}{ISO_ZONE})\]?\s*(.*)$"
SYSLOG_BSD = r"^([A-Z][a-z]{2}\s{1,2}\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\s:\[]+)(?:\[(\d+)\])?:\s*(.*)$"
SYSLOG_5424 = r"^<(\d{1,3})>(\d)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+|\[.*?\])\s*(.*)$"
COMMON_LOG = r"""^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3})\s+(\S+)"""
BARE_LEVEL = rf"[\[\(<|\s]?\b({LEVEL_TOKEN})\b[\]\)>|:\s]"
BARE_LEVEL_WINDOW = 80
FIELDS = {
    "syslog": {"host": 2, "tag": 3, "pid": 4},
    "syslog-5424": {"host": 4, "tag": 5, "pid": 6, "msgid": 7},
    "access-log": {"host": 1, "ident": 2, "user": 3, "request": 5, "status": 6, "size": 7},
}
NIL = ("", "-")

# Keys of JSON lines by priority, and limits of their flattening.
JSON_TIME_KEYS = ("timestamp", "@timestamp", "time", "ts", "asctime", "eventTime", "date")
JSON_LEVEL_KEYS = ("level", "levelname", "severity", "lvl", "loglevel", "log_level", "priority")
JSON_MESSAGE_KEYS = ("message", "msg", "event", "text", "log")
JSON_DEPTH, JSON_FIELDS = 4, 64

# Query keys that are known before any line is read.
KNOWN_KEYS = frozenset(("host", "tag", "pid", "msgid", "ident", "user", "request", "status", "size", "node"))

# Volatile tokens of a message, replaced in this order.
SHAPE_RULES = (
    (r"""\"[^\"]*\"|'[^']*'""", "<str>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}(?:\s[+-]\d{4})?|\b\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}|\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<ts>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}\b", "<ipv6>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<ip>"),
    (r"\b0[xX][0-9a-fA-F]+\b|\b[0-9a-fA-F]{8,}\b", "<hex>"),
    (r"(?<![\w/])/[\w.\-+@%/]+", "<path>"),
    (r"\b\d+\.\d+", "<float>"),
    (r"\b\d+", "<int>"),
)

# Default limits.
LOOKBACK, BUFFER_LINES, MAX_FILES, WATCH_WINDOW = 200, 5000, 5000, 60.0

# Fields of each format that name who spoke, its process, and what is shown behind a line.
PROFILES = {
    "syslog": {"source": ("tag",), "pid": "pid", "pinned": (), "chips": ("host",)},
    "syslog-5424": {"source": ("tag",), "pid": "pid", "pinned": (), "chips": ("host", "msgid")},
    "access-log": {"source": ("host",), "pid": "", "pinned": ("status",), "chips": ("user", "size")},
    "json": {
        "source": ("unit", "logger", "service", "component", "tag", "name"), "pid": "pid", "pinned": (),
        "chips": ("host", "status", "code", "error", "exception", "method", "path", "duration_ms", "latency_ms", "request_id", "trace_id"),
    },
}
CHIP_WIDTH = 24
BACKOFF = (1, 2, 5, 15, 30, 60)  # seconds before a source that failed is tried again
