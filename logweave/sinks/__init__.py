"""Exports of entries: JSON Lines, CSV and text, whole or one row for each cluster."""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_name(source, now, node: str = "") -> str:
    """A name without suffix for an export: machine, source and time; two exports of one log are told apart."""
    base = (source or "logweave-export").rstrip("/").rsplit("/", 1)[-1]
    return f"{node + '-' if node else ''}{base}-{now:%Y%m%d-%H%M%S}"


def isoformat(ts="ts", offset="ts_offset_s") -> Column:
    """A stamp as Python writes it: the fraction only where there is one, the offset where it is known."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    o = F.col(offset)
    zone = F.concat(F.when(o < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(o) / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(F.abs(o) % 3600 / 60).cast("string"), 2, "0"))
    return F.concat(base, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.coalesce(zone, F.lit("")))


def export_fields() -> Column:
    """Fields with source and node put in, over keys of the same name."""
    own = F.map_filter("fields", lambda k, v: ~k.isin("source", "node"))
    more = F.map_filter(F.create_map(F.lit("source"), "source", F.lit("node"), "node"), lambda k, v: v.isNotNull())
    return F.map_concat(own, more)


def sorted_json(fields: Column) -> Column:
    """A map as a JSON object in the order of its keys; "" if it is empty."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(fields)))
    return F.when(F.cardinality(fields) == 0, "").otherwise(F.to_json(ordered))


def json_lines(entries: DataFrame) -> DataFrame:
    line = F.struct("raw", isoformat().alias("timestamp"), "level", "message", F.col("format_name").alias("format"), "continuation", export_fields().alias("fields"))
    return entries.select(F.to_json(line, {"ignoreNullFields": "false"}).alias("value"))


def csv_rows(entries: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit(""))
    return entries.select(text(isoformat()).alias("timestamp"), text(F.col("level")).alias("level"), F.col("format_name").alias("format"), F.col("continuation").cast("string").alias("continuation"),
                          "message", "raw", text(F.col("node")).alias("node"), sorted_json(F.col("fields")).alias("fields"))


def clustered(clusters: DataFrame) -> DataFrame:
    """One entry for each cluster, groups of two or more with their count in front and cluster.* fields."""
    many = F.col("n") >= 2
    mark = lambda c: F.when(many, F.concat(F.lit("×"), F.col("n").cast("string"), F.lit(" "), F.col(c))).otherwise(F.col(c)).alias(c)
    extra = F.map_filter(F.create_map(F.lit("cluster.count"), F.col("n").cast("string"), F.lit("cluster.first"), F.date_format("first_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("cluster.last"), F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss")), lambda k, v: v.isNotNull())
    return clusters.select("source", F.lit(None).cast("string").alias("node"), mark("raw"), F.col("first_ts").alias("ts"), F.lit(None).cast("int").alias("ts_offset_s"), "level", mark("message"), "format_name",
                           F.lit(False).alias("continuation"), F.when(many, extra).otherwise(F.create_map().cast("map<string,string>")).alias("fields"))


def write(entries: DataFrame, path: str, kind: str) -> None:
    """Writes to a staging folder beside the path and moves it there when it is whole; what stood there goes last."""
    spark = entries.sparkSession
    stage = f"{path}.staging-{uuid.uuid4().hex}"
    if kind == "jsonl":
        json_lines(entries).write.text(stage)
    elif kind == "csv":
        csv_rows(entries).write.csv(stage, header=True, quote='"', escape='"', emptyValue="")
    else:
        entries.select("raw").write.text(stage)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = Path(f"{stage}.old")
    before = fs.exists(Path(path))
    if before and not fs.rename(Path(path), old):
        raise OSError(f"{path} cannot be replaced")
    if not fs.rename(Path(stage), Path(path)):
        if before:
            fs.rename(old, Path(path))
        raise OSError(f"{path} cannot be written")
    if before:
        fs.delete(old, True)
