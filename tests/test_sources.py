import bz2
import gzip
import io
import lzma
import os
import zipfile

from pyspark.sql import functions as F

from logweave.session import Session, View, load_views, save_views
from logweave.sources import catalog, files, journal
from logweave.plans.parse import parse_lines
from logweave.plans.query import Filter
from logweave import sinks


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return str(path)


def sheet():
    cell = '<table:table-cell {}><text:p>{}</text:p></table:table-cell>'.format
    body = f'<table:table-row>{cell("", "a")}<table:table-cell table:number-columns-repeated="2"/>{cell("", "b")}<table:table-cell table:number-columns-repeated="900"/></table:table-row><table:table-row table:number-rows-repeated="2">{cell("", "c")}</table:table-row>'
    spaces = " ".join(f'xmlns:{n}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for n in ("office", "table", "text"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f'<office:document-content {spaces}><office:body><office:spreadsheet><table:table table:name="S">{body}</table:table></office:spreadsheet></office:body></office:document-content>')
    return out.getvalue()


def test_discovery_counts_what_it_leaves_out(tmp_path):
    root = str(tmp_path / "logs")
    for name, data in {"b.log": b"x\n", "A.log": b"y\n", "sub/c.txt": b"z\n", "bin.log": b"a\0b", "p.pdf": b"%PDF", "bad.gz": b"nope", "wide.log": "hé\n".encode("utf-16")}.items():
        put(f"{root}/{name}", data)
    os.symlink(root, f"{root}/sub/loop")
    report = catalog.discover([root], exclude=("*.txt",))
    assert [os.path.basename(f.path) for f in report.files] == ["A.log", "b.log", "wide.log"]
    assert dict(report.skipped) == {"filtered": 1, "binary": 1, "unsupported": 1, "damaged": 1} and report.files[2].encoding == "utf-16-le"
    assert catalog.discover([f"{root}/sub/c.txt"], exclude=("*.txt",)).files and not catalog.discover([f"{root}/p.pdf"]).files
    assert catalog.discover([root], max_files=1).truncated == [root] and catalog.discover(["/nowhere"]).missing == ["/nowhere"]


def test_rotation_orders_numbers_and_dates():
    f = lambda n: catalog.File(n, "", "text")
    sets, single = catalog.group_rotated([f("a.log"), f("a.log.2.gz"), f("a.log.1"), f("d-20260811"), f("d.2026-08-12"), f("d"), f("lone.3"), f("e.gz")])
    assert [m.path for m in sets["a.log"]] == ["a.log", "a.log.1", "a.log.2.gz"] and [m.path for m in sets["d"]] == ["d", "d.2026-08-12", "d-20260811"]
    assert [s.path for s in single] == ["lone.3", "e.gz"]


def test_every_kind_of_file_gives_its_lines(spark, tmp_path):
    text = "one\ntwo half\x0bthird\nlast"
    want = ["one", "two", "half", "third", "last"]
    raw = text.encode()
    paths = {"p.log": raw, "g.gz": gzip.compress(raw), "b.bz2": bz2.compress(raw), "x.xz": lzma.compress(raw), "u.log": text.encode("utf-16"), "m.log": b"\xef\xbb\xbf" + raw, "s.ods": sheet(), "sp ace+%41.log": raw}
    found = catalog.discover([os.path.dirname(put(f"{tmp_path}/in/{n}", d)) for n, d in paths.items()]).files
    assert len(found) == len(paths)
    rows = files.read_files(spark, found).orderBy("member", "line_no").collect()
    by = {}
    for r in rows:
        by.setdefault(os.path.basename(r.member), []).append(r.raw)
        assert r.line_no == len(by[os.path.basename(r.member)]) - 1
    assert by.pop("s.ods") == ["--- S ---", "a\t\t\tb", "c", "c"]
    assert by == {n: want for n in paths if n != "s.ods"}
    assert files.unpack("gzip", gzip.compress(raw)[:-12], 1 << 20)[1] is False and files.unpack("xz", lzma.compress(b"a" * 5000), 100)[0] == b"a" * 100


def test_large_file_is_numbered_across_splits(spark, tmp_path):
    put(f"{tmp_path}/big.log", b"".join(b"line %d\n" % i for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.text_lines(spark, [f"{tmp_path}/big.log"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line_no, r.raw) for r in rows) == [(i, f"line {i}") for i in range(3000)]


def test_session_reads_rotated_logs_newest_first_within_the_budget(spark, tmp_path):
    line = "2024-01-0{} 00:00:0{} - {} - m{}\n".format
    put(f"{tmp_path}/l/app.log", "".join(line(3, i, "INFO", i) for i in range(3)).encode())
    put(f"{tmp_path}/l/app.log.1", "".join(line(2, i, "ERROR", i) for i in range(3)).encode() + b"   at trace\n")
    put(f"{tmp_path}/l/app.log.2.gz", gzip.compress("".join(line(1, i, "WARN", i) for i in range(3)).encode()))
    entries, report = Session(spark).open(f"{tmp_path}/l", budget=8)
    rows = entries.df.orderBy("line_no").collect()
    assert [r.level for r in rows] == ["WARN", "ERROR", "ERROR", "ERROR", "ERROR", "INFO", "INFO", "INFO"] and rows[4].continuation and rows[0].raw.endswith("m2")
    errors = entries.filter(Filter(severity="error"))
    assert errors.df.count() == 4 and errors.merge().df.agg(F.max("pos")).first()[0] == 3 and entries.timeline(10).count() <= 10
    errors.export(f"{tmp_path}/out", "csv")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 4
    assert entries.cluster().agg(F.sum("n")).first()[0] == 8 and len(report.files) == 3


def test_journal_records_become_parsed_lines(spark):
    rows = [({"__REALTIME_TIMESTAMP": "1700000000123456", "PRIORITY": "3", "_HOSTNAME": "h", "_PID": "7", "MESSAGE": "boom"},), ({"PRIORITY": "6", "MESSAGE": "[104, 195, 169]", "X": "1"},), ({"MESSAGE": "plain"},)]
    records = spark.createDataFrame(rows, "record map<string,string>")
    got = parse_lines(journal.journal_lines(records)).collect()
    assert (got[0].level, got[0].message, got[0].fields["host"], str(got[0].ts)) == ("ERROR", "boom", "h", "2023-11-14 22:13:20.123000")
    assert got[1].message == "hé" and got[1].fields["X"] == "1" and got[2].level is None
    assert journal.journal_lines(records, "error").count() == 2


def test_views_survive_a_bad_record(tmp_path):
    path = f"{tmp_path}/v.json"
    save_views(path, [View("a", "x", "error", False, True)])
    assert load_views(path) == [View("a", "x", "error", False, True)]
    with open(path, "w") as f:
        f.write('[{"name": "ok", "regex": "bad"}, 3, {"query": "nameless"}]')
    assert load_views(path) == [View("ok")] and load_views("/nowhere") == []


def test_clustered_export_marks_groups(spark):
    df = spark.createDataFrame([("s", None, "INFO", f"job {i} done", f"job {i} done", "raw", i) for i in range(3)], "source string, ts timestamp_ntz, level string, raw string, message string, format_name string, pos long")
    from logweave.operators.cluster import summaries

    row = sinks.clustered(summaries(df)).first()
    assert row.raw == "×3 job 0 done" and row.fields == {"cluster.count": "3"}
