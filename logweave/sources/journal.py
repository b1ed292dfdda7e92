"""Exported journal records as JSON lines of the common vocabulary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X

# Journal keys by their common name, and severities that a reader may filter by beforehand.
NAMES = {"unit": "_SYSTEMD_UNIT", "host": "_HOSTNAME", "pid": "_PID", "tag": "SYSLOG_IDENTIFIER", "boot": "_BOOT_ID"}
PRIORITY = {"error": 3, "warn": 4, "info": 6}


def journal_lines(records: DataFrame, severity: str = "all", unit: str | None = None, boot: str | None = None) -> DataFrame:
    """(raw) for records with a map column `record` of texts; MESSAGE may be a list of byte values.

    Common names come first, then the record's own keys.  A severity keeps a superset of what its bucket holds.
    """
    get = lambda k: F.try_element_at("record", F.lit(k))
    if severity in PRIORITY:
        records = records.where(get("PRIORITY").isNull() | (get("PRIORITY").try_cast("int") <= PRIORITY[severity]))
    for key, value in (("_SYSTEMD_UNIT", unit), ("_BOOT_ID", boot)):
        if value is not None:
            records = records.where(get(key) == value)
    stamp = F.timestamp_micros(get("__REALTIME_TIMESTAMP").try_cast("long"))
    level = F.get(F.array(*map(F.lit, X.SYSLOG)), F.when(get("PRIORITY").rlike("^[0-7]$"), get("PRIORITY").cast("int")))
    message = get("MESSAGE")
    numbers = F.from_json(F.when(message.rlike(r"^\[[0-9, ]*\]$"), message), "array<int>")
    text = F.decode(F.unhex(F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "UTF-8")
    common = {"timestamp": F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSS"), "level": level, "message": F.coalesce(text, message, F.lit("")), **{n: F.nullif(get(k), F.lit("")) for n, k in NAMES.items()}}
    first = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, common)), F.array(*common.values())), lambda k, v: v.isNotNull())
    rest = F.map_filter("record", lambda k, v: ~k.isin(*common) & v.isNotNull())
    return records.select(F.to_json(F.map_concat(first, rest)).alias("raw"))
