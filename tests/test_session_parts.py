"""Damaged members, machines, saved views, structured rows, added sources and exporters, waits."""

import gzip
import json
import os
from datetime import datetime

import pytest

from logweave import sinks
from logweave.operators import timeline, views
from logweave.plans.parse import parse_lines
from logweave.plugins import Registry, StageError
from logweave.session import Session, View, load_views, save_views
from logweave.sources import catalog, files
from logweave.streaming.tail import MOST, Backoff, TailReader

from .test_sources import put, sheet


def test_damaged_members_are_left_out_and_named(spark, tmp_path):
    text = b"".join(b"2024-01-01 00:00:%02d - INFO - %s\n" % (i % 60, os.urandom(20).hex().encode()) for i in range(4000))
    whole = gzip.compress(text)
    put(f"{tmp_path}/l/app.log", b"2024-01-02 00:00:00 - ERROR - live\n")
    bad = put(f"{tmp_path}/l/app.log.1.gz", whole[: len(whole) // 2])
    put(f"{tmp_path}/l/app.log.2.gz", whole)
    torn = put(f"{tmp_path}/l/other.gz", whole[:-20] + b"x" * 20)
    entries, report = Session(spark).open(f"{tmp_path}/l", budget=5000)
    assert report.damaged == sorted([bad, torn]) and report.skipped["damaged"] == 2 and report.partial == [f"{tmp_path}/l/app.log"]
    assert entries.df.count() == 4001 and entries.df.where("level = 'ERROR'").count() == 1
    assert any("a member is damaged" in line for line in report.summary())
    assert files.damaged(spark, [f for f in report.files if f.kind == "text"]) == []


def test_machines_have_their_own_globs_and_budgets(spark, tmp_path):
    for node in ("web1", "web2"):
        for name in ("a.log", "b.txt"):
            put(f"{tmp_path}/node={node}/{name}", b"2024-01-01 00:00:00 - INFO - x\n" * 9)
    put(f"{tmp_path}/here/a.log", b"2024-01-01 00:00:00 - INFO - x\n" * 9)
    hosts = {"web1": catalog.Host(include=("*.log",), budget=2), "web2": catalog.Host(include=())}
    entries, report = Session(spark).open(f"{tmp_path}/node=web1", f"{tmp_path}/node=web2", f"{tmp_path}/here", include=("a.*",), budget=4, hosts=hosts)
    got = {(r.node, os.path.basename(r.source)): r["count"] for r in entries.df.groupBy("node", "source").count().collect()}
    assert got == {("web1", "a.log"): 2, ("web2", "a.log"): 4, ("web2", "b.txt"): 4, (None, "a.log"): 4}
    assert report.skipped["filtered"] == 1 and catalog.node_of("/x/node=n/y") == "n" and catalog.node_of("/x/n") == ""


def test_first_lines_of_a_sheet_are_kept(spark, tmp_path):
    found = catalog.discover([os.path.dirname(put(f"{tmp_path}/s/s.ods", sheet()))]).files
    rows = files.read_files(spark, found, 2).orderBy("line_no").collect()
    assert [r.raw for r in rows] == ["--- S ---", "a\t\t\tb"]


def test_saved_views_keep_all_fields(spark, tmp_path):
    log = put(f"{tmp_path}/l/a.log", b"".join(b"2024-01-01 0%d:00:00 - %s - m%d\n" % (i, b"ERROR" if i % 2 else b"INFO", i) for i in range(8)))
    put(f"{tmp_path}/l/b.log", b"2024-01-01 03:00:00 - ERROR - other\n")
    view = View("late", "m", "error", window="range", start="2024-01-01T02:00:00", end="2024-01-01T06:00:00", include="a.*", source=f"{tmp_path}/l", merged=())
    path = f"{tmp_path}/v.json"
    save_views(path, [view])
    assert load_views(path) == [view]
    entries, _ = Session(spark).open_view(load_views(path)[0], datetime(2024, 1, 2))
    assert sorted(r.message for r in entries.df.collect()) == ["m3", "m5"]
    both = View("both", merged=(log, f"{tmp_path}/l/b.log"), window="22h")
    assert Session(spark).open_view(both, datetime(2024, 1, 2))[0].df.count() == 7
    with open(path, "w") as f:
        json.dump([{"name": " x ", "use_regex": False, "invert_match": True, "time_window": "6h", "merged": ["/a", 3], "custom_start": 5, "unknown": 1}, {"name": " "}], f)
    assert load_views(path) == [View("x", regex=False, invert=True, window="6h", merged=("/a",))]


def test_rows_show_who_spoke_and_what_varies(spark):
    raw = [
        '10.0.0.1 - bob [04/Mar/2025:11:22:33 +0000] "GET /x HTTP/1.1" 500 77', '10.0.0.2 - bob [04/Mar/2025:11:22:33 +0000] "GET /x HTTP/1.1" 500 78',
        "Mar  4 11:22:33 node7 crond[818]: job", "Mar  4 11:22:33 node7 init: ready", '{"msg":"m","service":"","component":"c","path":"' + "p" * 40 + '"}', '{"msg":"m","path":"q"}', "~~ odd"]
    lines = spark.createDataFrame([("s", 0, i, r) for i, r in enumerate(raw)], "source string, source_idx int, line_no long, raw string")
    entries = parse_lines(lines)
    flat = lambda r: (r.speaker, r.pid, [f"{c.key}={c.value}" for c in r.chips])
    rows = [flat(r) for r in views.structured_rows(entries).orderBy("line_no").collect()]
    assert rows == [
        ("10.0.0.1", None, ["status=500", "size=77"]), ("10.0.0.2", None, ["status=500", "size=78"]), ("crond", "818", []), ("init", None, []),
        ("c", None, ["path=" + "p" * 23 + "…"]), (None, None, ["path=q"]), (None, None, [])]
    merged = [flat(r) for r in views.structured_rows(entries, merged=True).orderBy("line_no").collect()]
    assert merged[0] == (None, None, ["host=10.0.0.1", "status=500", "size=77"]) and merged[2] == (None, None, ["tag=crond"])
    assert not views.row_layout(entries)["all_raw"] and views.row_layout(entries.where("format_name = 'raw'")) == {"all_raw": True, "has_source": False, "varying": set()}
    assert views.row_layout(entries.where("false"))["all_raw"] is False and views.structured_rows(entries.where("false")).count() == 0


def test_added_sources_and_exporters_are_used_until_they_fail(spark, tmp_path):
    registry, seen = Registry(), []
    registry.add("sources", "two", lambda spark, n: spark.range(n).selectExpr("'two' as source", "0 as source_idx", "id as line_no", "'2024-01-01 00:00:00 - WARN - x' as raw"))
    registry.add("exporters", "count", lambda entries, path: seen.append((entries.count(), path)))
    registry.add("exporters", "broken", lambda entries, path: 1 / 0)
    entries = Session(spark).open_source(registry, "two", n=2)
    entries.export("there", "count", registry)
    assert seen == [(2, "there")] and [r.level for r in entries.df.collect()] == ["WARN"] * 2
    with pytest.raises(StageError):
        entries.export("there", "broken", registry)
    assert "broken" in registry.disabled and registry.errors[-1][0] == "broken"
    with pytest.raises(StageError):
        Session(spark).open_source(registry, "none")


def test_small_parts(tmp_path):
    now = datetime(2026, 8, 11, 14, 25, 30)
    assert sinks.export_name("/var/log/syslog", now) == "syslog-20260811-142530" and sinks.export_name("/v/a.log.1", now, "web1") == "web1-a.log.1-20260811-142530"
    assert timeline.undated_note(3, 1) == "" and "4 lines" in timeline.undated_note(0, 4) and "no lines" in timeline.undated_note(0, 0)
    path = put(f"{tmp_path}/x/a.log", b"")
    os.symlink(path, f"{tmp_path}/x/link.log")
    one = catalog.toggled((), path)
    assert one == (os.path.realpath(path),) and catalog.toggled(one, f"{tmp_path}/x/link.log") == ()
    assert catalog.check_access(path) is None and "No such file" in catalog.check_access(f"{tmp_path}/none")


def test_waits_grow_and_end_and_long_lines_pass(tmp_path):
    now = [0.0]
    waits = Backoff((1, 2), lambda: now[0])
    for pause in (1, 2):
        waits.failed("p", "why")
        assert not waits.over("p")
        now[0] += pause
        assert waits.over("p")
    waits.failed("p", "why")
    now[0] += 1e9
    assert not waits.over("p")
    waits.fine("p")
    assert waits.over("p")
    path = put(f"{tmp_path}/t/long.log", b"x" * (MOST + 5) + b"\nshort\n")
    reader = TailReader([path], True)
    start = reader.initialOffset()
    rows, end = reader.read(start)
    assert [len(r[3]) for r in rows] == [MOST + 5]
    assert [len(r[3]) for r in reader.readBetweenOffsets(start, end)] == [MOST + 5]
    assert [r[3] for r in reader.read(end)[0]] == ["short"]
