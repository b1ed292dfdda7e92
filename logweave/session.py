"""The public entry: open sources, then filter, merge, cluster, draw a timeline, watch, navigate and export."""

import json
import os
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sinks
from .functions.fixed import BUFFER_LINES, LOOKBACK
from .functions.text import table
from .operators import cluster, filtering, merge, timeline, views
from .plans.parse import carry_forward, parse_lines
from .plans.query import Filter, absolute_window, relative_window
from .sources import catalog, files


class Entries:
    """A thin wrapper around the DataFrame in .df."""

    def __init__(self, df: DataFrame, facts: DataFrame | None = None):
        self.df, self.facts = df, facts

    def filter(self, spec: Filter) -> "Entries":
        return Entries(filtering.matching(self.df, spec), self.facts)

    def stats(self, spec: Filter) -> DataFrame:
        return filtering.filter_stats(self.df, spec)

    def merge(self) -> "Entries":
        return Entries(merge.merged(self.df, self.facts), self.facts)

    def cluster(self, lookback: int = LOOKBACK) -> DataFrame:
        return cluster.summaries(self.df if "pos" in self.df.columns else self.merge().df, lookback)

    def timeline(self, width: int = 60) -> DataFrame:
        return timeline.timeline(self.df, width)

    def watch(self, rules) -> DataFrame:
        return views.watch_hits(self.df, rules)

    def goto(self, when) -> DataFrame:
        return views.first_at(self.df, when, "pos" if "pos" in self.df.columns else "line_no")

    def rows(self, merged: bool = False) -> DataFrame:
        return views.structured_rows(self.df, merged)

    def export(self, path: str, kind: str, registry=None) -> None:
        """Writes by one of the kinds of sinks.write, or by an exporter that a user added."""
        exporter = registry.exporter(kind) if registry else None
        if exporter is None:
            sinks.write(self.df, path, kind)
        else:
            registry.run(kind, exporter, self.df, path)


class Session:
    def __init__(self, spark):
        self.spark = spark

    def open(self, *roots, budget: int = BUFFER_LINES, facts: DataFrame | None = None, hosts=None, **how):
        """(Entries of the files below the roots, report).  Rotated files are one source each.

        A root that cannot be read and a damaged file are reported, the rest is opened.  hosts: {node: catalog.Host}
        for machines whose globs or budgets differ; a path such as /logs/node=web1/app.log names its machine.
        """
        refused = {r: why for r in roots if os.path.exists(r) and (why := catalog.check_access(r))}
        report = catalog.discover_hosts([r for r in roots if r not in refused], hosts or {}, **how)
        report.missing += refused.values()
        report.leave_out(files.damaged(self.spark, report.files))
        sets, single = catalog.group_rotated(report.files)
        members = [f for m in sets.values() for f in m] + [catalog.File(f.path, f.root, f.kind, f.encoding, f.path) for f in single]
        if not members:
            raise FileNotFoundError("; ".join(report.summary()))
        own = {n: h.budget for n, h in (hosts or {}).items() if h.budget is not None}
        node = F.nullif(F.regexp_extract("member", "(?:^|/)node=([^/]+)/", 1), F.lit(""))
        limits = F.coalesce(F.try_element_at(table(own), node), F.lit(budget)) if own else F.lit(budget)
        lines = files.as_one_log(files.read_files(self.spark, members, max([budget, *own.values()])), limits)
        return Entries(carry_forward(parse_lines(lines)).withColumn("node", node), facts), report

    def open_source(self, registry, name: str, **options) -> Entries:
        """Entries of a source that a user added: a function (spark, options) -> (source, source_idx, line_no, raw)."""
        lines = registry.source(name)(self.spark, **options)
        return Entries(carry_forward(parse_lines(lines)).withColumn("node", F.lit(None).cast("string")))

    def open_view(self, view: "View", now, **how):
        """(Entries that a saved view shows, report): its merged set or its source, its globs and its filter."""
        globs = {k: tuple(v.split()) for k, v in (("include", view.include), ("exclude", view.exclude)) if v.strip()}
        entries, report = self.open(*(view.merged or (view.source,)), **globs, **how)
        return entries.filter(view.spec(now)), report


@dataclass
class View:
    """A named filter that can be kept."""

    name: str
    query: str = ""
    severity: str = "all"
    regex: bool = True
    invert: bool = False
    window: str = "all"  # "all", "range" for start and end, or a span such as "6h"
    start: str = ""
    end: str = ""
    case_sensitive: bool = False
    include: str = ""
    exclude: str = ""
    source: str = ""
    merged: tuple = ()

    def spec(self, now=None) -> Filter:
        """The filter; a window is told from `now`, without which there is none."""
        span = None
        if now is not None:
            span = absolute_window(self.start, self.end, now) if self.window == "range" else relative_window(self.window, now)
        return Filter(self.query, self.severity, span, self.case_sensitive or None, self.regex, self.invert)


# Names of fields in files of saved views.
OTHER_NAMES = {"use_regex": "regex", "invert_match": "invert", "time_window": "window", "custom_start": "start", "custom_end": "end", "include_globs": "include", "exclude_globs": "exclude"}


def save_views(path: str, views_) -> None:
    stage = f"{path}.{uuid.uuid4().hex}"
    with open(stage, "w", encoding="utf-8") as f:
        json.dump([asdict(v) for v in views_], f)
    os.replace(stage, path)


def load_views(path: str):
    """Views of a file; a record without a name is left out, a field of another kind is as if it were not there."""
    try:
        with open(path, encoding="utf-8") as f:
            rows = json.load(f)
    except (OSError, ValueError):
        return []
    kinds = View.__annotations__
    out = []
    for r in rows if isinstance(rows, list) else ():
        if not isinstance(r, dict) or not isinstance(r.get("name"), str) or not r["name"].strip():
            continue
        named = {OTHER_NAMES.get(k, k): v for k, v in r.items()} | {"name": r["name"].strip()}
        if isinstance(named.get("merged"), list):
            named["merged"] = tuple(m for m in named["merged"] if isinstance(m, str))
        out.append(View(**{k: v for k, v in named.items() if k in kinds and isinstance(v, kinds[k])}))
    return out
