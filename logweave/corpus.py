"""A deterministic log rendered from an events table: eight formats by event, and stray lines in between."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL_OF = {"error": "ERROR", "purchase": "WARN", "signup": "NOTICE", "click": "INFO", "view": "DEBUG"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(parts)  # one small file is one task, and parsing is the work
    return rows.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))


def log_lines(spark: SparkSession, sf_dir: str, sources: int = 3) -> DataFrame:
    """(source, source_idx, line_no, event_id, raw)."""
    e = events(spark, sf_dir)
    level = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in LEVEL_OF.items()))
    at = lambda f: F.date_format("ts", f)
    iso, text = at("yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" by user "), F.col("user_id").cast("string"))
    severity = F.element_at(F.create_map(*(F.lit(x) for p in {"ERROR": "3", "WARN": "4", "NOTICE": "5", "INFO": "6", "DEBUG": "7"}.items() for x in p)), level)
    status = F.when(level == "ERROR", "500").when(level == "WARN", "404").otherwise("200")
    node = F.concat(F.lit("node"), (F.col("user_id") % 5).cast("string"))
    lines = [
        F.concat(iso, F.lit(" - "), level, F.lit(" - "), text),
        F.concat(at("MMM"), F.lit(" "), F.lpad(at("d"), 2, " "), F.lit(" "), at("HH:mm:ss "), node, F.lit(" app["), (F.col("event_id") % 1000).cast("string"), F.lit("]: ["), level, F.lit("] "), text),
        F.concat(F.lit("<"), (F.lit(128) + severity.cast("int")).cast("string"), F.lit(">1 "), at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), node, F.lit(" app "), (F.col("event_id") % 1000).cast("string"), F.lit(" - - "), text),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 200).cast("string"), F.lit(" - u"), F.col("user_id").cast("string"), F.lit(" ["), at("dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /event/'), F.col("event_id").cast("string"), F.lit(' HTTP/1.1" '), status, F.lit(" "), (F.col("event_id") % 5000).cast("string")),
        F.concat(F.lit('{"time":"'), at("yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z","severity":"'), F.lower(level), F.lit('","msg":"'), text, F.lit('","user":{"id":'), F.col("user_id").cast("string"), F.lit("}}")),
        F.concat(F.lit("["), iso, F.lit("] ["), F.lower(level), F.lit("] "), text),
        F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00 "), text),
        F.concat(F.lit("~~ "), text),
    ]
    main = F.coalesce(*(F.when(F.col("event_id") % 8 == i, x) for i, x in enumerate(lines)))
    idx = (F.col("user_id") % sources).cast("int")
    stray = F.when(F.col("event_id") % 5 == 0, F.lit("    at pkg.Klass.run(Klass.java:9)"))
    both = F.array_compact(F.array(main, stray))
    rows = e.select(idx.alias("source_idx"), F.concat(F.lit("src"), idx.cast("string")).alias("source"), "event_id", F.posexplode(both).alias("i", "raw"))
    return rows.select("source", "source_idx", (2 * F.col("event_id") + F.col("i")).alias("line_no"), "event_id", "raw")
