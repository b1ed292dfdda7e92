from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logweave.functions import text as T
from logweave.functions.jsonline import flatten, read_line
from logweave.operators import filtering, merge, timeline, views
from logweave.plans.parse import carry_forward, parse_lines
from logweave.plans.positions import with_position
from logweave.plans.query import Filter, Query, QueryError, Term, Window, absolute_window, moment, parse_query, relative_window, terms_outcome, tokens
from logweave.plugins import Registry, StageError, by_row, run_stages

NOW = datetime(2025, 3, 4, 12)


def parsed(spark, lines, now=NOW):
    df = spark.createDataFrame([("s", 0, i, x) for i, x in enumerate(lines)], "source string, source_idx int, line_no long, raw string")
    return parse_lines(df, now)


def test_formats(spark):
    cases = [
        ("2025-03-04 11:22:33,5 - WARNING - pool", "python-logging", "WARN", "pool", "2025-03-04 11:22:33.500000", None),
        ("2025-03-04 11:22:33 - nothing - pool", "iso", None, "- nothing - pool", "2025-03-04 11:22:33", None),
        ("Mar  4 11:22:33 node7 crond[818]: job", "syslog", None, "job", "2025-03-04 11:22:33", None),
        ("Dec 31 23:00:00 node7 x: ERROR: late", "syslog", "ERROR", "ERROR: late", "2024-12-31 23:00:00", None),
        ("<12>1 2025-03-04T11:22:33Z node7 api 55 - - slow", "syslog-5424", "WARN", "slow", "2025-03-04 11:22:33", 0),
        ('192.0.2.9 - eve [04/Mar/2025:11:22:33 -0330] "GET /x HTTP/1.1" 503 77', "access-log", "ERROR", "GET /x HTTP/1.1", "2025-03-04 11:22:33", -12600),
        ('  {"time":"2025-03-04T11:22:33+01:00","severity":"fatal","msg":"bye"}', "json", "CRITICAL", "bye", "2025-03-04 11:22:33", 3600),
        ('{"ts":1.5,"lvl":4}', "json", "WARN", '{"ts":1.5,"lvl":4}', "1970-01-01 00:00:01.500000", None),
        ('{"a":1} x', "raw", None, '{"a":1} x', None, None), ("[2025-03-04 11:22:33] [notice] rotated", "iso-level", "NOTICE", "rotated", "2025-03-04 11:22:33", None),
        ("~~ nothing", "raw", None, "~~ nothing", None, None), ("[ERROR] boom", "raw", "ERROR", "[ERROR] boom", None, None), ("", "raw", None, "", None, None), ("ends with ERROR", "raw", None, "ends with ERROR", None, None),
    ]
    rows = parsed(spark, [c[0] for c in cases]).orderBy("line_no").collect()
    for r, (raw, name, level, message, ts, offset) in zip(rows, cases):
        assert (r.raw, r.format_name, r.level, r.message, r.ts and str(r.ts), r.ts_offset_s) == (raw, name, level, message, ts, offset)
    assert rows[2].fields == {"host": "node7", "tag": "crond", "pid": "818"} and rows[5].fields == {"host": "192.0.2.9", "user": "eve", "request": "GET /x HTTP/1.1", "status": "503", "size": "77"}


def test_json_flattening():
    deep = {"a": {"b": {"c": {"d": {"e": 1}}}}, "l": [1, "é"], "n": None, "t": True, "o": {}}
    assert flatten(deep) == {"a.b.c.d": '{"e":1}', "l": '[1,"\\u00e9"]', "n": "", "t": "true", "o": "{}"}
    assert len(flatten({str(i): i for i in range(99)})) == 64 and read_line("[1]") is None and read_line('{"a":1}{') is None
    assert read_line('{"level":true,"severity":"3"}')["level"] == "ERROR"


def test_carry_equals_a_fold_in_any_segment(spark):
    import random

    rng = random.Random(3)
    lines = [rng.choice(["  at x", "2025-03-04 11:22:3{} - ERROR - e".format(rng.randrange(9)), "[WARN] raw", "2025-03-04T10:00:00+02:00 plain", "Mar  4 11:22:33 n a: m"]) for _ in range(80)]
    entries = parsed(spark, lines).cache()
    ts = level = None
    want = []
    for r in entries.orderBy("line_no").collect():
        if r.format_name != "raw":
            ts, level = r.ts or ts, r.level or level
            want.append((r.ts, r.level, False))
        else:
            want.append((ts, r.level or level, True) if ts or level else (None, r.level, False))
    for segment in (7, 1000):
        assert [(r.ts, r.level, r.continuation) for r in carry_forward(entries, segment=segment).orderBy("line_no").collect()] == want


def test_grammar():
    assert tokens("""a "b c" d:'e f' don't "open""") == ["a", "b c", "d:e f", "don't", '"open']
    assert parse_query("10:30:00 foo|bar") == Query((), "10:30:00 foo|bar")
    assert parse_query('status>=500 host:"web 1" slow  disk') == Query((Term("status", ">=", "500"), Term("host", ":", "web 1")), "slow disk")
    assert parse_query("other=1") == Query((), "other=1") and parse_query("host:") == Query((Term("host", ":", ""),), "")
    with pytest.raises(QueryError):
        parse_query("host=")
    with pytest.raises(QueryError):
        Filter("([").parsed()
    assert Term("a", "=", "b c").render() == 'a="b c"'
    assert relative_window("2h", NOW) == Window(NOW - timedelta(hours=2), None) and relative_window("all", NOW) is None
    assert moment("-30m", NOW) == moment("30m", NOW) == NOW - timedelta(minutes=30) and moment("+1d", NOW) == NOW + timedelta(days=1)
    assert absolute_window("2025-03-05", "2025-03-01", NOW) == Window(datetime(2025, 3, 1), datetime(2025, 3, 5))


def test_terms(spark):
    rows = [(1, {"status": "500", "Host": "Web"}), (2, {"status": "1e2"}), (3, {"status": "abc"}), (4, {}), (5, {"status": "nan"}), (6, {"status": "1_000"}), (7, {"status": "5d"})]
    df = spark.createDataFrame(rows, "i long, fields map<string,string>").cache()
    of = lambda q: [r[0] for r in df.orderBy("i").select(terms_outcome(parse_query(q).terms)).collect()]
    assert of("status>=500") == ["hit", "miss", "hit", "missing-field", "miss", "hit", "hit"]
    assert of("host:web")[0] == "hit" and of("host:WEB")[0] == "miss" and of("host:web")[1] == "missing-field"
    assert of("host=x status=500") == ["miss", "miss", "miss", "missing-field", "miss", "miss", "miss"] and of("status!=500")[:2] == ["miss", "hit"]


def test_python_expressions_mean_the_same(spark):
    lines = ["abc def", "É", "a1", "٣", "Tab\tx", "foo foo"]
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    import re

    for p in (r"\w+\d", "a.c.d", "é", r"(?P<w>foo) (?P=w)", r"(?P<my_name>a)\d", r"\bTab\b", "[[:alpha:]]", r"\d"):
        flags = 0 if any(c.isupper() for c in p) else re.I
        assert [r.raw for r in df.where(T.searched(F.col("raw"), p)).collect()] == [x for x in lines if re.search(p, x, flags)], p
    assert df.where(T.searched(F.col("raw"), "a.c", regex=False)).count() == 0


def test_stats_account_for_every_line(spark):
    lines = ["2025-03-04 10:00:00 - ERROR - slow", "2025-03-04 11:00:00 - INFO - slow", "2025-03-04 09:00:00 - ERROR - slow", "slow raw", "[ERROR] slow raw", "quick"]
    spec = Filter("slow", severity="error", window=Window(datetime(2025, 3, 4, 10), None))
    r = filtering.filter_stats(parsed(spark, lines), spec).first()
    assert r.asDict() == {"total": 6, "matched": 1, "hidden_by_query": 1, "hidden_by_severity": 2, "hidden_by_time": 2, "hidden_missing_level": 1, "hidden_missing_timestamp": 1, "hidden_missing_field": 0}
    assert "Of 6 lines" in filtering.explanation(r.asDict() | {"matched": 0}, spec)
    aware = Window(datetime(2025, 3, 4, 11, tzinfo=timezone.utc), None)
    assert parsed(spark, ["2025-03-04T12:30:00+02:00 a", "2025-03-04T13:30:00+02:00 a", "2025-03-04T11:30:00 a"]).where(aware.holds()).count() == 2


def test_steps_fit_and_buckets_tile(spark):
    for span in range(0, 400, 7):
        for width in (1, 2, 7, 60):
            s = timeline.step_seconds(span, width)
            assert max(1, span) // s + 1 <= width or width == 1
            assert s == 1 or max(1, span) // (s - 1) + 1 > width or width == 1
    assert timeline.timeline(parsed(spark, ["x"])).collect() == []


def test_merge_keeps_stray_lines_with_their_source(spark):
    a = [("a", 0, i, x) for i, x in enumerate(["  head", "2025-03-04 10:00:00 - INFO - a1", "  tail", "2025-03-04 09:00:00 - INFO - a2"])]
    b = [("b", 1, i, x) for i, x in enumerate(["2025-03-04 09:30:00 - INFO - b1", "2025-03-04 10:00:00 - INFO - b2"])]
    df = parse_lines(spark.createDataFrame(a + b, "source string, source_idx int, line_no long, raw string"), NOW)
    rows = merge.merged(df).orderBy("pos").collect()
    assert [(r.source, r.line_no) for r in rows] == [("a", 0), ("a", 3), ("b", 0), ("a", 1), ("a", 2), ("b", 1)] and [r.pos for r in rows] == list(range(6))


def test_positions_payloads_rates_plugins(spark):
    df = spark.range(500).withColumn("k", (F.col("id") * 7919) % 500)
    assert all(r.pos == r.k for r in with_position(df, "k").collect())
    kinds = {'{"a":1}': "JSON", "<a><b/></a>": "XML", "<!DOCTYPE html><p>x<br></p>": "HTML", "<!DOCTYPE html><p>x": None, ".p { color: red }": "CSS", "p { color: red }": None, "a,b\n1,2": "CSV", "words": None, None: None}
    assert {x: views.classify(x)[0] for x in kinds} == kinds
    hits = spark.createDataFrame([("r", NOW + timedelta(seconds=s)) for s in (0, 10, 20, 61, 500)], "rule string, at timestamp_ntz")
    assert [(int((r.at - NOW).total_seconds()), r.n) for r in views.rate_limited(hits, 60.0).orderBy("at").collect()] == [(0, 1), (60, 2), (120, 1), (500, 1)]
    small = spark.createDataFrame([(1, "a"), (2, "b")], "i long, raw string")
    assert [r.raw for r in run_stages(small, [by_row(lambda r: r | {"raw": "z"} if r["i"] == 1 else None, None)]).collect()] == ["z"]
    with pytest.raises(StageError):
        run_stages(small, [lambda df, c: df.select("nothing")])
    registry = Registry()
    assert registry.add("stages", "s", lambda df, c: df.where("i = 1")) and not registry.add("stages", "s", None) and not registry.add("stages", "t", None, (2, 0))
    assert registry.apply(small).count() == 1 and len(registry.errors) == 2


def test_paths_across_hosts_and_marks(spark):
    files = spark.createDataFrame([("a", "/x"), ("b", "/x"), ("a", "/y")], "node string, path string")
    hosts = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "node string, reachable boolean")
    assert {r.path: (r.nodes, r.lacking, r.unreachable) for r in views.across_hosts(files, hosts).collect()} == {"/x": (["a", "b"], [], ["c"]), "/y": (["a"], ["b"], ["c"])}
    lines = spark.createDataFrame([("s", 0, "one"), ("s", 1, "two"), ("t", 0, "one")], "source string, line_no long, raw string")
    marks = lines.where("raw = 'one'").select("source", views.digest().alias("digest"))
    assert views.marked(lines, marks).count() == 2
    assert sorted(r.source for r in views.retained(marks, lines.where("line_no = 1"), ["s"]).collect()) == ["t"]
