import os

from pyspark.sql import functions as F

from logweave.plans.parse import carry_forward, parse_lines
from logweave.plans.query import Filter
from logweave.streaming.follow import Follower, windowed
from logweave.streaming.tail import tail


def append(path, text):
    with open(path, "a", encoding="utf-8") as f:
        f.write(text)


def run(spark, path, out, rules=None):
    q = tail(spark, [path]).writeStream.foreachBatch(Follower(out, rules)).option("checkpointLocation", f"{out}/checkpoint").trigger(processingTime="0 seconds").start()
    return q


def test_batches_give_what_one_batch_gives(spark, tmp_path):
    log, out = f"{tmp_path}/a.log", f"{tmp_path}/out"
    lines = ["2024-01-01 00:00:00 - ERROR - first", "  at one", "  at two", "2024-01-01 00:00:09 - INFO - next", "  tail", "~~ end"]
    append(log, "\n".join(lines[:2]) + "\n" + lines[2][:3])
    q = run(spark, log, out, {"err": Filter("ERROR")})
    try:
        q.processAllAvailable()
        assert spark.read.parquet(f"{out}/entries").count() == 2
        append(log, lines[2][3:] + "\n" + lines[3] + "\n")
        q.processAllAvailable()
        append(log, "\n".join(lines[4:]) + "\n")
        q.processAllAvailable()
        got = spark.read.parquet(f"{out}/entries").orderBy("line_no").collect()
        whole = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "source string, line_no long, raw string")
        want = carry_forward(parse_lines(whole)).orderBy("line_no").collect()
        assert [(r.raw, r.ts, r.level, r.continuation) for r in got] == [(r.raw, r.ts, r.level, r.continuation) for r in want]
        assert spark.read.parquet(f"{out}/hits").agg(F.sum("n")).first()[0] == 1
        os.remove(log)
        append(log, "  orphan\n")
        q.processAllAvailable()
        last = spark.read.parquet(f"{out}/entries").where("raw = '  orphan'").first()
        assert last.epoch == 1 and last.ts is None and not last.continuation
    finally:
        q.stop()


def test_windows_of_event_time(spark, tmp_path):
    path = f"{tmp_path}/in"
    rows = [("2024-01-01 00:00:01", "INFO"), ("2024-01-01 00:00:59", "ERROR"), ("2024-01-01 00:05:00", None)]
    spark.createDataFrame(rows, "t string, level string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "level").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp_ntz, level string").parquet(path)
    q = windowed(stream, "1 minute", "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").start()
    try:
        q.processAllAvailable()
        assert sorted((r.n, r.worst_level) for r in spark.table("w").collect()) == [(1, None), (2, "ERROR")]
    finally:
        q.stop()
