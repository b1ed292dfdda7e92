"""Small views over entries: bounds, navigation, marks, watches, columns, payloads."""

import csv
import io
import json
import re
import xml.dom.minidom

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from .filtering import matches

# --- bounds ---------------------------------------------------------------------------------------------------------


def last_lines(entries: DataFrame, n: int = X.BUFFER_LINES, keys=("source",), order: str = "line_no") -> DataFrame:
    """The last n lines of each source."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return entries.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def rotated_tail(lines: DataFrame, budget: int) -> DataFrame:
    """The last `budget` lines of rotated sets, spent on the newest member first (rank 0), given oldest first.

    lines: (set_base, member_rank, line_no, ...); adds pos, the place in the set's concatenation.
    """
    newest = Window.partitionBy("set_base").orderBy("member_rank", F.desc("line_no"))
    kept = lines.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= budget)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("set_base").orderBy(F.desc("_n"))) - 1).drop("_n")


def visible(entries: DataFrame, n: int, order: str = "pos") -> DataFrame:
    return entries.orderBy(F.desc(order)).limit(n)


def byte_suffix(entries: DataFrame, limit: int, keys=("source",), order: str = "line_no") -> DataFrame:
    """The newest whole lines of each source that fit into a number of bytes, a line feed counted for each."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("_bytes", F.sum(F.octet_length("raw") + 1).over(newest)).where(F.col("_bytes") <= limit).drop("_bytes")


# --- navigation -----------------------------------------------------------------------------------------------------


def first_at(entries: DataFrame, when, order: str = "pos") -> DataFrame:
    """The first row in order whose stamp is not before a time."""
    return entries.where(F.col("ts") >= F.lit(str(when)).cast("timestamp_ntz")).orderBy(order).limit(1)


def steps(entries: DataFrame, spec, order: str = "pos") -> DataFrame:
    """Matches as (order, k, n, next, previous); the last leads to the first and back.

    One order over the matches of one view; give it a view that is bounded, such as last_lines.
    """
    found = entries.where(matches(spec)).select(order)
    line = Window.orderBy(order)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return found.select(
        order, F.row_number().over(line).cast("long").alias("k"), F.count("*").over(whole).alias("n"),
        F.coalesce(F.lead(order).over(line), F.first(order).over(whole)).alias("next"), F.coalesce(F.lag(order).over(line), F.last(order).over(whole)).alias("previous"))


# --- marks and watches ----------------------------------------------------------------------------------------------


def digest(raw: str = "raw") -> Column:
    return F.sha2(F.col(raw), 256)


def marked(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """Lines whose (source, digest) is marked; every occurrence of a marked line counts."""
    return entries.withColumn("digest", digest()).join(marks.select("source", "digest"), ["source", "digest"], "left_semi")


def retained(marks: DataFrame, entries: DataFrame, sources) -> DataFrame:
    """Marks whose lines are still there, and those of sources out of view."""
    live = entries.select("source", digest().alias("digest"))
    seen = F.col("source").isin(list(sources))
    return marks.where(~seen).unionByName(marks.where(seen).join(live, ["source", "digest"], "left_semi"))


def marks_by_source(marks: DataFrame) -> DataFrame:
    """(source, n): how many lines of each source are marked."""
    return marks.select("source", "digest").distinct().groupBy("source").agg(F.count("*").alias("n"))


def watch_hits(entries: DataFrame, rules) -> DataFrame:
    """Adds hits, the names of the rules that a line meets.

    rules: {name: Filter}; a rule without terms or text, or one that cannot be understood, never matches.
    """
    tests = []
    for name, spec in rules.items():
        try:
            query = spec.parsed()
        except ValueError:
            continue
        if query.terms or query.text:
            tests.append(F.when(matches(spec), F.lit(name)))
    hits = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return entries.withColumn("hits", hits)


def rate_limited(hits: DataFrame, seconds: float = X.WATCH_WINDOW) -> DataFrame:
    """Notifications (rule, at, n) from (rule, at): a rule's first hit at once, what follows once its window closes.

    A notification at the end of a window opens the next one; each carries the hits since the one before.
    """

    def notify(rows: pd.DataFrame) -> pd.DataFrame:
        out, free, held, due = [], None, 0, None
        name = rows["rule"].iloc[0]
        for at in rows["at"].sort_values():
            if held and at >= due:
                out.append((name, due, held))
                free, held, due = due + pd.Timedelta(seconds=seconds), 0, None
            if free is None or at >= free:
                out.append((name, at, 1))
                free = at + pd.Timedelta(seconds=seconds)
            else:
                held, due = held + 1, free
        if held:
            out.append((name, due, held))
        return pd.DataFrame(out, columns=["rule", "at", "n"])

    return hits.select("rule", "at").groupBy("rule").applyInPandas(notify, "rule string, at timestamp_ntz, n long")


# --- columns and fields ---------------------------------------------------------------------------------------------


def column_plan(entries: DataFrame, keys=()) -> DataFrame:
    """One row: which cells a view needs, and which fields vary in it."""
    varies = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))  # noqa: E731  two values suffice
    return entries.agg(
        F.bool_or(F.col("ts").isNotNull()).alias("has_time"), varies(F.to_date("ts")).alias("has_date"), F.coalesce(F.bool_or(F.date_format("ts", "SSSSSS") != "000000"), F.lit(False)).alias("has_fraction"),
        F.bool_or(F.col("level").isNotNull()).alias("has_level"), varies(F.col("source")).alias("has_source"), *(varies(F.try_element_at("fields", F.lit(k))).alias(f"varies_{k}") for k in keys))


def filled(key: str) -> Column:
    """A field that is there and not empty."""
    return F.nullif(F.try_element_at("fields", F.lit(key)), F.lit(""))


def row_layout(entries: DataFrame) -> dict:
    """What rows of a view have to show, read off all of them: all_raw, has_source and the chips that vary."""
    chips = sorted({c for p in X.PROFILES.values() for c in p["chips"]})
    varies = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    able = lambda key: F.col("format_name").isin([f for f, p in X.PROFILES.items() if key in p["chips"]])
    found = entries.agg(F.coalesce(F.bool_and(F.col("format_name") == "raw"), F.lit(False)).alias("all_raw"), varies(speaker()["value"]).alias("has_source"), *(varies(F.when(able(c), filled(c))).alias(c) for c in chips)).first()
    return {"all_raw": found["all_raw"], "has_source": found["has_source"], "varying": {c for c in chips if found[c]}}


def by_format(pick) -> Column:
    """The value of pick(profile) for the profile of a row's format; null for formats without one."""
    return F.coalesce(*(F.when(F.col("format_name") == name, pick(profile)) for name, profile in X.PROFILES.items()))


def speaker() -> Column:
    """struct(key, value): the first field of its format that says who spoke."""
    pair = lambda k: F.when(filled(k).isNotNull(), F.struct(F.lit(k).alias("key"), filled(k).alias("value")))
    return by_format(lambda p: F.coalesce(*(pair(k) for k in p["source"])))


def structured_rows(entries: DataFrame, merged: bool = False) -> DataFrame:
    """Entries with cells in place of their prefix: level_label, speaker, pid, body and chips.

    chips: fields (key, value) worth showing behind the line: pinned ones always, others where they vary in the view.
    A merged view shows the source in its own cell, so the speaker becomes the first chip there.
    """
    varying = row_layout(entries)["varying"]
    none = F.lit(None).cast("string")
    cut = lambda c: F.when(F.length(c) > X.CHIP_WIDTH, F.concat(F.substring(c, 1, X.CHIP_WIDTH - 1), F.lit("…"))).otherwise(c)
    chip = lambda k: F.struct(F.lit(k).alias("key"), cut(filled(k)).alias("value"))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    first = F.when(speaker().isNotNull(), F.array(F.struct(speaker()["key"].alias("key"), cut(speaker()["value"]).alias("value")))) if merged else None
    rest = by_format(lambda p: F.concat(empty, F.array(*(chip(k) for k in (*p["pinned"], *(c for c in p["chips"] if c in varying))))))
    chips = F.filter(F.concat(*([F.coalesce(first, empty)] if merged else []), F.coalesce(rest, empty)), lambda c: c["value"].isNotNull())
    return entries.withColumns({
        "level_label": labelled_levels(F.col("level")), "speaker": F.lit(None).cast("string") if merged else speaker()["value"],
        "pid": none if merged else by_format(lambda p: filled(p["pid"]) if p["pid"] else none), "body": F.coalesce(F.nullif("message", F.lit("")), "raw"), "chips": chips})


def properties(entries: DataFrame) -> DataFrame:
    """Fields as rows (source, line_no, key, value)."""
    return entries.select("source", "line_no", F.explode("fields").alias("key", "value"))


def source_labels(sources: DataFrame) -> DataFrame:
    """(source, label) for (source, node, path): the base name on one machine, the machine for one base name on several,
    else node/name.  A null node is the local machine."""
    base, node = F.regexp_extract("path", r"([^/]*)$", 1), F.coalesce("node", F.lit(""))
    names, nodes = sources.agg(F.count_distinct(base), F.count_distinct(node)).first()
    label = base if nodes <= 1 else F.when(node == "", "local").otherwise(node) if names == 1 else F.when(node == "", base).otherwise(F.concat_ws("/", node, base))
    return sources.select("source", label.alias("label"))


# --- payloads -------------------------------------------------------------------------------------------------------

# Elements that make markup credible, and what makes a selector.
ELEMENTS = frozenset("html head body div span p a table tr td th ul ol li h1 h2 h3 br img form input script style link meta title pre code section nav header footer button label tbody thead".split())
SIGILS, COMBINATORS = (".", "#", "@", "*", ":"), (">", "+", "~", "[")
RULE = re.compile(r"([^{}();]{1,120})\{([^{}]{0,2000})\}")
DECLARATION = re.compile(r"""(?:[^;"'\\]|\\.|"(?:[^"\\]|\\.)*(?:"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z))+""", re.S)
PROSE_WORDS = 4


def as_json(body):
    return json.dumps(json.loads(body), indent=2, ensure_ascii=False) if body[0] in "{[" else None


def as_xml(body):
    if body[0] != "<" or "<!ENTITY" in body:  # entities may grow without end
        return None
    return "\n".join(x for x in xml.dom.minidom.parseString(body).toprettyxml(indent="  ").splitlines() if x.strip())


def as_html(body):
    """Markup that is no XML: a closing tag, three tags, and two known elements unless it says that it is HTML."""
    tags = [t.lower() for t in re.findall(r"</?([a-zA-Z][a-zA-Z0-9]*)", body)]
    declared = body[:16].lower().startswith(("<!doctype html", "<html"))
    return body if body[0] == "<" and "</" in body and len(tags) > 2 and (declared or len(ELEMENTS.intersection(tags)) > 1) else None


def as_css(body):
    """Rules and nothing else; some selector has a sigil or a combinator, and every declaration names a property."""
    found = RULE.findall(body)
    if body[0] == "{" or body.count("{") != body.count("}") or not found or RULE.sub("", body).strip():
        return None
    rules = [(" ".join(name.split()), [d.strip() for d in DECLARATION.findall(inner) if d.strip()]) for name, inner in found]
    able = all(name and name.count(" ") < PROSE_WORDS and all(re.match(r"-{0,2}[a-zA-Z][a-zA-Z0-9-]*\s*:", d) for d in inner) for name, inner in rules)
    signal = any(name.startswith(SIGILS) or any(c in name for c in COMBINATORS) for name, _ in rules)
    if not able or not signal or not any(inner for _, inner in rules):
        return None
    return "\n".join("\n".join((f"{name} {{", *(f"  {d};" for d in inner), "}")) for name, inner in rules)


def as_csv(body):
    """Rows of one width with two commas at least, three columns if it is one row, and no cells of prose without quotes."""
    if body.count(",") < 2:
        return None
    rows = list(csv.reader(io.StringIO(body)))
    width = len(rows[0])
    if width < 2 or {len(r) for r in rows} != {width} or len(rows) == 1 and width < 3:
        return None
    most = 1 if len(rows) == 1 else PROSE_WORDS
    if '"' not in body and any(len(c.split()) > most for r in rows for c in r):
        return None
    return "\n".join("\t".join(c.strip() for c in r) for r in rows)


def classify(text, limit=8192):
    """(label, pretty) by the first proof: JSON, XML, HTML, CSS, CSV; else nothing."""
    body = (text or "").strip()
    if not body or len(body) > limit:
        return None, None
    for label, proof in (("JSON", as_json), ("XML", as_xml), ("HTML", as_html), ("CSS", as_css), ("CSV", as_csv)):
        try:
            pretty = proof(body)
        except Exception:  # noqa: BLE001  a reader raises whatever its parts raise; then it is not of that kind
            continue
        if pretty is not None:
            return label, pretty.encode("utf-8", "replace").decode()
    return None, None


def payload(text: Column) -> Column:
    """struct(label, pretty)."""

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classify(v) for v in values], columns=["label", "pretty"])

    return F.pandas_udf(run, "label string, pretty string")(text)


def labelled_levels(level: Column) -> Column:
    """Three letters for each level."""
    return F.try_element_at(T.table({"TRACE": "TRC", "DEBUG": "DBG", "INFO": "INF", "NOTICE": "NTC", "WARN": "WRN", "ERROR": "ERR", "CRITICAL": "CRT"}), level)


# --- machines -------------------------------------------------------------------------------------------------------


def across_hosts(catalog: DataFrame, hosts: DataFrame) -> DataFrame:
    """(path, nodes, lacking, unreachable) for each path of a catalog (node, path) over hosts (node, reachable).

    nodes: machines that have the path; lacking: reachable ones that have not; unreachable: those nothing is known of.
    """
    every = hosts.agg(F.collect_set(F.when(F.col("reachable"), F.col("node"))).alias("up"), F.collect_set(F.when(~F.col("reachable"), F.col("node"))).alias("down"))
    found = catalog.groupBy("path").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    out = found.crossJoin(F.broadcast(every))  # one row
    return out.select("path", "nodes", F.array_sort(F.array_except("up", "nodes")).alias("lacking"), F.array_sort("down").alias("unreachable"))
