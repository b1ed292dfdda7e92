"""Column functions on levels, timestamps, shapes and user patterns."""

import re
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def grab(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, X.UNICODE + pattern, group)


def table(mapping) -> Column:
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))


def normal_level(token: Column) -> Column:
    """Canonical level of a token; digits are syslog severities; null where unknown."""
    bare = F.upper(F.btrim(F.trim(token), F.lit("[]()<>:")))
    number = F.when(bare.rlike("^[0-9]+$"), F.expr("null").cast("int")).otherwise(F.lit(None).cast("int"))
    number = F.when(bare.rlike("^0*[0-7]$"), F.right(bare, F.lit(1)).cast("int")).otherwise(number)
    return F.coalesce(F.get(F.array(*map(F.lit, X.SYSLOG)), number), F.try_element_at(table(X.LEVEL_ALIASES), bare))


def level_rank(level: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, X.LEVELS)), level).cast("int") - 1, F.lit(-1))


def worst_level(level: Column) -> Column:
    """Aggregate: the most severe known level, null where there is none."""
    known = F.when(level.isin(*X.LEVELS), level)
    return F.max_by(known, level_rank(known))


def in_bucket(level: Column, bucket: str) -> Column:
    accepted = X.BUCKETS.get(bucket.lower(), ())
    return F.coalesce(level.isin(*accepted), F.lit(False)) if accepted else F.lit(True)


def scan_level(text: Column) -> Column:
    return normal_level(F.nullif(grab(F.left(text, F.lit(X.BARE_LEVEL_WINDOW)), X.BARE_LEVEL, 1), F.lit("")))


def zone_seconds(zone: Column) -> Column:
    """Seconds of "Z", "+02:00" or "-0530"; null for anything else."""
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    seconds = sign * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60)
    return F.when(zone == "Z", F.lit(0)).when(zone.rlike(r"^[+-]\d{2}:?\d{2}$"), seconds)


ISO = r"^\s*(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)?)\s*(Z|[+-]\d{2}:?\d{2})?\s*$"


def iso_time(text: Column):
    """(wall clock as written, offset in seconds or null)."""
    wall = F.nullif(F.regexp_extract(text, ISO, 1), F.lit(""))
    return F.replace(wall, F.lit(","), F.lit(".")).try_cast("timestamp_ntz"), zone_seconds(F.regexp_extract(text, ISO, 2))


def syslog_time(text: Column, now) -> Column:
    """Wall clock of "Mon d hh:mm:ss": the year of `now`, or the one before where that lies over a day ahead."""
    words = F.regexp_replace(F.trim(text), r"\s+", " ")
    at = lambda year: F.try_to_timestamp(F.concat(F.lit(f"{year} "), words), F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz")
    this, last = at(now.year), at(now.year - 1)
    limit = F.lit(str(now)).cast("timestamp_ntz") + F.expr("interval 1 day")
    return F.when(this > limit, F.coalesce(last, this)).otherwise(F.coalesce(this, last))


def common_log_time(text: Column):
    zone = F.regexp_extract(text, r"\s([+-]\d{4})\s*$", 1)
    bare = F.trim(F.regexp_replace(F.trim(text), r"\s[+-]\d{4}$", ""))
    return F.try_to_timestamp(bare, F.lit("dd/MMM/yyyy:HH:mm:ss")).cast("timestamp_ntz"), zone_seconds(zone)


def normalised(text: Column) -> Column:
    """The message with its volatile tokens replaced, white space collapsed."""
    for pattern, mark in X.SHAPE_RULES:
        text = F.regexp_replace(text, X.UNICODE + pattern, mark)
    return F.trim(F.regexp_replace(text, X.UNICODE + r"\s+", " "))


# --- user patterns ------------------------------------------------------------------------------------------------

DOUBTFUL = re.compile(r"\(\?\(|\\[NZ]|\\[0-7]{2,}|\(\?[aLx]|\(\?P=|\\x|\\u|\\U|&&|\[[^\]\\]*\[", re.S)


def to_java(pattern: str):
    """The pattern for java.util.regex, or None where equality cannot be shown."""
    if DOUBTFUL.search(pattern):
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    names = re.findall(r"\(\?P<(\w+)>", pattern)
    out = pattern
    for i, name in enumerate(names):
        out = out.replace(f"(?P<{name}>", f"(?<g{i}x>", 1)
    return X.UNICODE + out


def smart_case(pattern: str, case_sensitive=None) -> bool:
    """Whether a pattern is matched with case: as told, else where its text holds an upper-case letter."""
    return any(c.isupper() for c in pattern) if case_sensitive is None else case_sensitive


def searched(text: Column, pattern: str, *, regex=True, case_sensitive=None) -> Column:
    """Whether a pattern is found anywhere in a text, in Python's dialect of regular expressions."""
    case = smart_case(pattern, case_sensitive)
    if not regex:
        return F.contains(text, F.lit(pattern)) if case else F.contains(F.lower(text), F.lit(pattern.lower()))
    java = to_java(pattern)
    if java is not None:
        return text.rlike(java if case else "(?iu)" + java)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)  # on what a pattern may mean one day
        compiled = re.compile(pattern, 0 if case else re.IGNORECASE)

    def by_python(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else compiled.search(v) is not None)

    return F.pandas_udf(by_python, "boolean")(text)
