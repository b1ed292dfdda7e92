"""Lines to entries: eight formats tried in order, and what a continuation inherits."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..functions.jsonline import read_json
from .positions import carried

ENTRY = "source string, source_idx int, line_no long, node string, member string, raw string, ts timestamp_ntz, ts_offset_s int, level string, message string, format_name string, continuation boolean, fields map<string,string>"
NOW = datetime(2024, 12, 31, 23, 59, 59)


def once(value: Column) -> Column:
    """The value, in a form that the optimizer neither copies into filters above nor merges with projections above.

    A line's columns rest on dozens of expressions; copied into each use of a column, they would multiply.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def captured(text: Column, pattern: str, groups: dict) -> Column:
    """Map of a format's fields without those that say nothing."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, groups)), F.array(*(T.grab(text, pattern, g) for g in groups.values())))
    return F.map_filter(pairs, lambda k, v: ~v.isin(*X.NIL))


def parse_lines(lines: DataFrame, now: datetime = NOW) -> DataFrame:
    """lines (raw, and any other columns) with ts, ts_offset_s, level, message, format_name and fields.

    Every line gives one entry; an unknown one is raw, with its whole text.  now: dates syslog stamps.
    """
    raw, s, head = F.col("raw"), F.col("_s"), F.col("_head")
    df = lines.withColumn("_s", F.regexp_replace("raw", X.UNICODE + r"^\s+", "")).withColumn("_head", F.left("_s", F.lit(1)))
    df = df.withColumn("_json", read_json(F.when(head == "{", s)))
    digit, dashed = head.rlike(r"(?U)^\d"), F.substring("_s", 5, 1) == "-"
    match = lambda p: s.rlike(X.UNICODE + p)
    kind = (
        F.when((head == "{") & F.col("_json.ok"), "json")
        .when((head == "<") & F.substring("_s", 2, 1).rlike(r"(?U)^\d") & match(X.SYSLOG_5424), "syslog-5424")
        .when(digit & (F.length("_s") > 10) & dashed & match(X.PYTHON_LOGGING) & T.normal_level(T.grab(s, X.PYTHON_LOGGING, 2)).isNotNull(), "python-logging")
        .when(((head == "[") | digit & dashed) & match(X.ISO_LEVEL), "iso-level")
        .when(((head == "[") | digit & dashed) & match(X.ISO_PLAIN) & T.iso_time(T.grab(s, X.ISO_PLAIN, 1))[0].isNotNull(), "iso")
        .when(head.rlike(r"^\p{L}") & match(X.SYSLOG_BSD), "syslog")
        .when(match(X.COMMON_LOG), "access-log")
        .otherwise("raw")
    )
    df = df.withColumn("format_name", once(F.when(s == "", "raw").otherwise(kind)))
    name = F.col("format_name")
    stamp = (
        F.when(name == "json", F.col("_json.time")).when(name == "syslog-5424", T.grab(s, X.SYSLOG_5424, 3)).when(name == "python-logging", T.grab(s, X.PYTHON_LOGGING, 1))
        .when(name == "iso-level", T.grab(s, X.ISO_LEVEL, 1)).when(name == "iso", T.grab(s, X.ISO_PLAIN, 1)).when(name == "syslog", T.grab(s, X.SYSLOG_BSD, 1))
        .when(name == "access-log", T.grab(s, X.COMMON_LOG, 4))
    )
    message = (
        F.when(name == "json", F.col("_json.message")).when(name == "syslog-5424", T.grab(s, X.SYSLOG_5424, 9)).when(name == "python-logging", T.grab(s, X.PYTHON_LOGGING, 3))
        .when(name == "iso-level", T.grab(s, X.ISO_LEVEL, 3)).when(name == "iso", T.grab(s, X.ISO_PLAIN, 2)).when(name == "syslog", T.grab(s, X.SYSLOG_BSD, 5))
        .when(name == "access-log", T.grab(s, X.COMMON_LOG, 5)).otherwise(raw)
    )
    df = df.withColumns({"_stamp": stamp, "message": message})
    wall, offset = T.iso_time(F.col("_stamp"))
    clf, clf_offset = T.common_log_time(F.col("_stamp"))
    status = T.grab(s, X.COMMON_LOG, 6).try_cast("int")
    severity = F.pmod(T.grab(s, X.SYSLOG_5424, 1).try_cast("int"), F.lit(8))
    level = (
        F.when(name == "json", F.col("_json.level")).when(name == "syslog-5424", F.get(F.array(*map(F.lit, X.SYSLOG)), severity))
        .when(name == "python-logging", T.normal_level(T.grab(s, X.PYTHON_LOGGING, 2))).when(name == "iso-level", T.normal_level(T.grab(s, X.ISO_LEVEL, 2)))
        .when(name.isin("iso", "syslog"), T.scan_level(F.col("message"))).when(name == "access-log", F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO"))
        .otherwise(T.scan_level(raw))
    )
    fields = F.when(name == "json", F.col("_json.fields"))
    for kind, groups in X.FIELDS.items():
        fields = fields.when(name == kind, captured(s, {"syslog": X.SYSLOG_BSD, "syslog-5424": X.SYSLOG_5424, "access-log": X.COMMON_LOG}[kind], groups))
    df = df.withColumns({
        "ts": F.when(name == "syslog", T.syslog_time(F.col("_stamp"), now)).when(name == "access-log", clf).otherwise(wall),
        "ts_offset_s": F.when(name == "access-log", clf_offset).when(name != "syslog", offset).cast("int"),
        "level": level, "fields": F.coalesce(fields, F.create_map().cast("map<string,string>")),
    })
    df = df.withColumn("ts_offset_s", F.when(F.col("ts").isNotNull(), F.col("ts_offset_s"))).withColumn("level", once(F.col("level")))
    return df.drop("_s", "_head", "_json", "_stamp")


def carry_forward(entries: DataFrame, keys=("source",), order="line_no", segment: int = 1_000_000) -> DataFrame:
    """Raw lines behind a recognised one take its timestamp, and its level unless they name one themselves.

    Timestamp and level are carried apart; fields are not.  Adds continuation.
    """
    known = F.col("format_name") != "raw"
    stamp = F.when(known & F.col("ts").isNotNull(), F.struct("ts", "ts_offset_s"))
    out = carried(entries, {"_stamp": stamp, "_level": F.when(known, F.col("level"))}, list(keys), order, segment)
    heir = ~known & (F.col("_stamp").isNotNull() | F.col("_level").isNotNull())
    return out.withColumns({
        "continuation": heir, "ts": F.when(heir, F.col("_stamp.ts")).otherwise(F.col("ts")), "ts_offset_s": F.when(heir, F.col("_stamp.ts_offset_s")).otherwise(F.col("ts_offset_s")),
        "level": F.when(heir, F.coalesce("level", "_level")).otherwise(F.col("level")),
    }).drop("_stamp", "_level")
