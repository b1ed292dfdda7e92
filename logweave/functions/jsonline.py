"""JSON lines by Python's own strict reader: Spark's accepts more and orders keys otherwise."""

import json
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import functions as F

from .fixed import JSON_DEPTH, JSON_FIELDS, JSON_LEVEL_KEYS, JSON_MESSAGE_KEYS, JSON_TIME_KEYS, LEVEL_ALIASES, SYSLOG

SCHEMA = "ok boolean, time string, level string, message string, fields map<string,string>"


def writable(text):
    """Text that UTF-8 can hold: JSON may escape half of a surrogate pair."""
    return text.encode("utf-8", "replace").decode()


def as_text(value):
    if isinstance(value, str):
        return writable(value)
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else json.dumps(value, separators=(",", ":"))


def flatten(document):
    """Dotted keys in document order, at most JSON_FIELDS of them and JSON_DEPTH segments deep."""
    out, todo = {}, [iter([("", k, v, 1) for k, v in document.items()])]
    while todo and len(out) < JSON_FIELDS:
        item = next(todo[-1], None)
        if item is None:
            todo.pop()
            continue
        prefix, key, value, depth = item
        if isinstance(value, dict) and value and depth < JSON_DEPTH:
            todo.append(iter([(f"{prefix}{key}.", k, v, depth + 1) for k, v in value.items()]))
        else:
            out[writable(f"{prefix}{key}")] = as_text(value)
    return out


def level_of(value):
    if isinstance(value, bool) or value is None:
        return None
    if not isinstance(value, int):
        value = str(value).strip().strip("[]()<>:").upper()
        if not (value.isascii() and value.isdecimal()) or len(value) > 4:
            return LEVEL_ALIASES.get(value)
    return SYSLOG[int(value)] if 0 <= int(value) < len(SYSLOG) else None


def time_of(value):
    """ISO text of a time; numbers are seconds since 1970 in UTC, without an offset."""
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        try:
            return datetime.fromtimestamp(value, timezone.utc).replace(tzinfo=None).isoformat()
        except (OverflowError, OSError, ValueError):
            return None
    try:
        text = str(value).strip().replace(",", ".").replace("Z", "+00:00")
        return datetime.fromisoformat(text).isoformat()
    except ValueError:
        return None


def read_line(line):
    try:
        document = json.loads(line)
    except (ValueError, RecursionError):
        return None
    if not isinstance(document, dict):
        return None
    try:
        fields = flatten(document)
    except (ValueError, RecursionError):  # numbers and nesting that can be read but not written
        return None
    first = lambda keys, f: next((y for k in keys if k in document and (y := f(document[k])) is not None), None)
    message = first(JSON_MESSAGE_KEYS, lambda v: v if isinstance(v, str) and v else None)
    return {"ok": True, "time": first(JSON_TIME_KEYS, time_of), "level": first(JSON_LEVEL_KEYS, level_of), "message": writable(message or line), "fields": fields}


def read_json(line):
    """Column struct of SCHEMA; null lines and those that are no JSON object have ok = false."""

    def read(lines: pd.Series) -> pd.DataFrame:
        rows = [None if x is None else read_line(x) for x in lines]
        return pd.DataFrame([r or {"ok": False, "time": None, "level": None, "message": None, "fields": None} for r in rows], columns=["ok", "time", "level", "message", "fields"])

    return F.pandas_udf(read, SCHEMA)(line)
