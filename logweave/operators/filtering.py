"""Filtering with a counted reason for every hidden row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..plans.query import Filter, terms_outcome

OUTCOMES = ("kept", "field", "missing-field", "query", "severity", "missing-level", "time", "missing-timestamp")


def outcome(spec: Filter) -> Column:
    """Why a row is hidden, by the first stage that hides it: terms, text, severity, time."""
    query = spec.parsed()
    terms = terms_outcome(query.terms)
    text = T.searched(F.col("raw"), query.text, regex=spec.regex, case_sensitive=spec.case_sensitive) if query.text else F.lit(True)
    text = ~text if spec.invert and query.text else text
    level = T.in_bucket(F.col("level"), spec.severity)
    time = spec.window.holds() if spec.window and (spec.window.start or spec.window.end) else F.lit(True)
    return (
        F.when(terms == "miss", "field").when(terms == "missing-field", "missing-field").when(~text, "query")
        .when(~level & F.col("level").isNull(), "missing-level").when(~level, "severity").when(~time & F.col("ts").isNull(), "missing-timestamp").when(~time, "time").otherwise("kept")
    )


def matching(entries: DataFrame, spec: Filter) -> DataFrame:
    return entries.where(outcome(spec) == "kept")


def filter_stats(entries: DataFrame, spec: Filter) -> DataFrame:
    """One row that accounts for every entry."""
    of = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return entries.select(outcome(spec).alias("outcome")).agg(
        F.count("*").alias("total"), of("kept").alias("matched"), of("field", "missing-field", "query").alias("hidden_by_query"), of("severity", "missing-level").alias("hidden_by_severity"),
        of("time", "missing-timestamp").alias("hidden_by_time"), of("missing-level").alias("hidden_missing_level"), of("missing-timestamp").alias("hidden_missing_timestamp"), of("missing-field").alias("hidden_missing_field"))


def matches(spec: Filter) -> Column:
    """Whole-query predicate for counts and navigation; inversion does not apply."""
    query = spec.parsed()
    text = T.searched(F.col("raw"), query.text, regex=spec.regex, case_sensitive=spec.case_sensitive) if query.text else F.lit(True)
    return (terms_outcome(query.terms) == "hit") & text


def field_names(entries: DataFrame) -> DataFrame:
    """(name): fields seen in the entries, and those known before."""
    seen = entries.select(F.explode(F.map_keys("fields")).alias("name"))
    known = entries.sparkSession.createDataFrame([(k,) for k in sorted(X.KNOWN_KEYS)], "name string")
    return seen.unionByName(known).distinct()


def explanation(stats, spec: Filter) -> str:
    """Why nothing is shown, from a row of filter_stats."""
    if stats["matched"]:
        return ""
    if not stats["total"]:
        return "The source has no lines."
    parts = [f"{stats['hidden_by_query']} hidden by the query" + (f" ({stats['hidden_missing_field']} without its field)" if stats["hidden_missing_field"] else "") if stats["hidden_by_query"] else "",
             f"{stats['hidden_by_severity']} by severity {spec.severity}" + (f" ({stats['hidden_missing_level']} without a level)" if stats["hidden_missing_level"] else "") if stats["hidden_by_severity"] else "",
             f"{stats['hidden_by_time']} by time" + (f" ({stats['hidden_missing_timestamp']} without a timestamp)" if stats["hidden_missing_timestamp"] else "") if stats["hidden_by_time"] else ""]
    return f"Of {stats['total']} lines, " + ", ".join(p for p in parts if p) + "."
