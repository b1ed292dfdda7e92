"""Odd lines, payload proofs, labels, zones of a merge, and exports that replace one another."""

import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave import sinks
from logweave.functions.jsonline import read_line
from logweave.operators import cluster, merge, views
from logweave.plans.parse import parse_lines


def test_no_line_stops_the_job(spark):
    lines = ['{"msg":"\\ud800"}', '{"level":"²"}', '{"\\udfff":{"a":[1,"\\ud800"]}}', '{"time":1e999}', '{"time":NaN}', '{"level":123456789}', "[" * 5000, '{"a":' * 3000 + "1" + "}" * 3000, '{"level":"٣"}']
    rows = parse_lines(spark.createDataFrame([(x,) for x in lines], "raw string")).collect()
    assert len(rows) == len(lines)
    assert [r.level for r in rows[:2]] == [None, None] and rows[0].format_name == "json"


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats() | st.integers() | st.text(st.characters(), max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["time", "level", "msg", "a", "\ud800"]), x, max_size=4), max_leaves=12))
def test_any_document_is_read_and_can_be_written(value):
    import json

    got = read_line(json.dumps(value))
    if got:
        for text in (got["message"], got["level"] or "", got["time"] or "", *got["fields"], *got["fields"].values()):
            text.encode("utf-8")


def test_payloads_are_proved():
    want = {
        "<html><body><p>x</p></body></html>": "XML", "Java{name:bob}": None, "body{margin:0}": None, '.a{content:"x;y"}': "CSS", '1,"a,b"\n2,c': "CSV", "a,b,c": "CSV", "<p>lone": None,
        "<div><p>one<br></p>": "HTML", "<!doctype html><p>x</p><i>": "HTML", "</dev/null> failed": None, "a, b": None, "failed, status 22, again and again": None, "{a,b,c}": "CSV", ".a{color:red} tail": None,
        "com.acme.User{name:bob}": None, "ul > li{margin:0;padding:0}": "CSS", "@media{a:b}": "CSS", "a,b\n1": None, '{"a": "\ud800"}': "JSON", "x" * 9000: None,
    }
    assert {k: views.classify(k)[0] for k in want} == want
    assert views.classify("<div><p>one<br></p>")[1] == "<div><p>one<br></p>" and views.classify('.a{content:"x;y"}')[1] == '.a {\n  content:"x;y";\n}'


def test_labels_of_a_merged_set(spark):
    label = lambda rows: {r.source: r.label for r in views.source_labels(spark.createDataFrame(rows, "source string, node string, path string")).collect()}
    assert label([("a", None, "/x/l.log"), ("b", None, "/y/l.log")]) == {"a": "l.log", "b": "l.log"}
    assert label([("a", "n1", "/x/l.log"), ("b", "n2", "/x/l.log"), ("c", None, "/x/l.log")]) == {"a": "n1", "b": "n2", "c": "local"}
    assert label([("a", "n1", "/x/l.log"), ("b", "n2", "/x/m.log"), ("c", None, "/k.log")]) == {"a": "n1/l.log", "b": "n2/m.log", "c": "k.log"}


def test_when_a_merge_compares_instants(spark):
    lines = spark.sql("select source, 0 source_idx, 0L line_no, timestamp_ntz'2024-01-01 12:00:00' ts, cast(null as int) ts_offset_s from values ('a'), ('b') t(source)")

    def moments(*facts):
        df = spark.createDataFrame(list(facts), "source string, node string, zone_offset_s int, skew_s double, correct_skew boolean")
        return [r.moment.strftime("%H:%M:%S") for r in merge.with_moment(lines, df).orderBy("source").collect()]

    assert moments(("a", None, 0, 0.0, False), ("b", None, 3600, 0.0, False)) == ["12:00:00", "11:00:00"]
    assert moments(("a", None, None, 0.0, False), ("b", None, 3600, 0.0, False)) == ["12:00:00", "12:00:00"]
    assert moments(("a", None, None, 30.0, True), ("b", None, 3600, 5.0, False)) == ["11:59:30", "11:00:00"]
    assert moments(("a", None, 3600, 0.0, True), ("b", None, 3600, 0.0, False)) == ["12:00:00", "12:00:00"]
    assert moments(("a", None, 3600, 30.0, True)) == ["12:00:00", "12:00:00"]
    one = spark.createDataFrame([(2.0,)], "skew_s double")
    assert merge.skew_spread(one).first().spread == 0 and merge.skew_spread(one.where("false")).first().spread == 0


def test_exports_replace_one_another(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (3, 2):
        rows = parse_lines(spark.range(n).select(F.format_string("line %d", "id").alias("raw")))
        sinks.write(rows, path, "raw")
        assert spark.read.text(path).count() == n and os.listdir(tmp_path) == ["out"]


def test_clusters_do_not_depend_on_segments(spark):
    rows = [(f"s{i % 2}", "ERROR" if i % 5 else None, "job 1 ok" if i % 3 else f"word{i % 4} x", i) for i in range(400) if i % 37 > 9]
    df = spark.createDataFrame([(a, b, c, c, n, None, "raw") for a, b, c, n in rows], "source string, level string, raw string, message string, pos long, ts timestamp_ntz, format_name string")
    want = None
    for segment in (1_000_000, 7, 50):
        marked = cluster.with_clusters(df, 6, segment=segment)
        got = sorted((r.pos, r.island) for r in marked.select("pos", "island").collect())
        want = want or got
        assert got == want
    last, opened = {}, {}
    for (source, level, raw, n), (pos, island) in zip(rows, want):
        key = source, level, raw.rstrip(" xok") if raw.startswith("word") else "job"
        if n - last.get(key, -99) > 6:
            opened[key] = n
        last[key] = n
        assert (pos, island) == (n, opened[key])
