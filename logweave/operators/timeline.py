"""Severity timelines over a fixed grid of whole seconds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.positions import saved
from ..plans.query import Window


def step_seconds(span: int, width: int) -> int:
    """The least whole second with which a span, both ends included, fits into the width."""
    return max(1, span) // max(1, width) + 1


def undated_note(buckets: int, undated: int) -> str:
    """Why a timeline is empty; nothing if it is not."""
    if buckets:
        return ""
    return f"no timeline: {undated} lines carry no time" if undated else "no timeline: there are no lines"


def timeline(entries: DataFrame, width: int = 60, at: str = "ts") -> DataFrame:
    """(bucket, bucket_start, bucket_end, n, worst_level) for each bucket, empty ones too; no rows without stamps.

    One pass counts by whole second, and everything else rests on those few rows; two values reach the driver.
    """
    spark = entries.sparkSession
    second = F.date_trunc("second", F.col(at)).cast("timestamp_ntz")
    seconds = saved(entries.where(F.col(at).isNotNull()).groupBy(second.alias("at")).agg(F.count("*").alias("n"), T.worst_level(F.col("level")).alias("level")))
    origin, high = seconds.agg(F.min("at"), F.max("at")).first()
    if origin is None:
        return spark.createDataFrame([], "bucket long, bucket_start timestamp_ntz, bucket_end timestamp_ntz, n long, worst_level string")
    span = int((high - origin).total_seconds())
    step = step_seconds(span, width)
    start = F.lit(str(origin)).cast("timestamp_ntz")
    bucket = F.floor((F.col("at") - start).cast("interval second").cast("decimal(20,6)") / step)
    counts = seconds.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), T.worst_level(F.col("level")).alias("worst_level"))
    grid = spark.range(span // step + 1).withColumnRenamed("id", "bucket")
    moved = lambda k: F.timestamp_add("SECOND", (F.col("bucket") + k) * step, start)
    return grid.join(counts, "bucket", "left").select("bucket", moved(0).alias("bucket_start"), moved(1).alias("bucket_end"), F.coalesce("n", F.lit(0)).alias("n"), "worst_level")


def totals(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.sum("n").alias("total"), F.max("n").alias("peak"))


def undated(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_if(F.col("ts").isNull()).alias("undated"))


def bucket_window(row) -> Window:
    """The window that drills into a bucket; both ends count, so neighbours share an edge."""
    return Window(row["bucket_start"], row["bucket_end"])


def captions(buckets: DataFrame) -> DataFrame:
    """One line for each bucket: its span, count and worst level; and its height of at most eight parts."""
    day = "yyyy-MM-dd HH:mm:ss"
    same = F.to_date("bucket_start") == F.to_date("bucket_end")
    span = F.concat(F.date_format("bucket_start", day), F.lit("–"), F.when(same, F.date_format("bucket_end", "HH:mm:ss")).otherwise(F.date_format("bucket_end", day)))
    many = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " event").otherwise(" events"), F.lit(" · "), F.coalesce("worst_level", F.lit("no level")))
    peak = buckets.agg(F.max("n").alias("peak"))
    out = buckets.crossJoin(F.broadcast(peak))  # one row
    return out.withColumn("caption", F.concat(span, F.lit(" · "), F.when(F.col("n") == 0, "no events").otherwise(many))).withColumn("height", F.when(F.col("n") == 0, 0).otherwise(F.ceil(F.col("n") * 8 / F.col("peak"))).cast("int"))
