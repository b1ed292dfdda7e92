"""Repeat clustering: rows of one shape whose gaps do not exceed the lookback."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import LOOKBACK
from ..plans.positions import saved


def with_clusters(entries: DataFrame, lookback: int = LOOKBACK, pos: str = "pos", segment: int = 1_000_000) -> DataFrame:
    """Adds shape and island; a cluster is (source, level, shape, island), an island the place of its first row.

    pos numbers the rows of the view, after filter and merge.  A row opens a cluster where its shape was last seen
    more than `lookback` rows before.  The fold runs inside segments of `segment` places, so that a shape that recurs
    in every line is not one task; only the last places of each segment and shape are folded further.
    """
    body = F.when(F.col("message") == "", F.col("raw")).otherwise(F.coalesce("message", "raw"))
    keys = ["source", "level", "shape"]
    inside = Window.partitionBy(*keys, "_segment").orderBy(pos)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_segment")
    far = lambda before: F.col(pos) - before > max(2, lookback)
    rows = entries.withColumn("shape", T.normalised(body)).withColumn("_segment", F.floor(F.col(pos) / segment))
    rows = saved(rows.withColumn("_before", F.lag(pos).over(inside)))  # shapes are dear, and read twice
    # a segment's first row of a shape is judged by the last place in the segments before it
    opens = F.when(far(F.col("_before")), F.col(pos))
    ends = rows.groupBy(*keys, "_segment").agg(F.min(pos).alias("_first"), F.max(pos).alias("_last"), F.max(opens).alias("_opened"))
    ends = ends.withColumn("_open", F.coalesce(F.col("_first") - F.lag("_last").over(across) > max(2, lookback), F.lit(True)))
    ends = ends.withColumn("_start", F.last(F.when(F.col("_open"), F.coalesce("_opened", "_first")).otherwise(F.col("_opened")), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_segment").alias("_of"), F.when(F.col("_open"), F.col("_first")).otherwise(F.col("_start")).alias("_start"))
    same = [F.col("_segment") == F.col("_of"), *(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)]
    out = rows.withColumn("_opened", F.last(opens, ignorenulls=True).over(so_far)).join(ends, same)
    return out.withColumn("island", F.coalesce("_opened", "_start")).drop("_segment", "_before", "_opened", "_of", "_start", *(f"_{k}" for k in keys))


def summaries(entries: DataFrame, lookback: int = LOOKBACK, pos: str = "pos") -> DataFrame:
    """One row for each cluster: count, first and last stamp in order, level, first line and its place."""
    stamped = F.when(F.col("ts").isNotNull(), F.col(pos))
    return with_clusters(entries, lookback, pos).groupBy("source", "level", "shape", "island").agg(
        F.count("*").alias("n"), F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.min_by("ts", stamped).alias("first_ts"), F.max_by("ts", stamped).alias("last_ts"),
        F.min_by("raw", pos).alias("raw"), F.min_by("message", pos).alias("message"), F.min_by("format_name", pos).alias("format_name")).withColumn("cluster_key", F.sha2(F.concat_ws("\0", "source", F.coalesce("level", F.lit("")), "shape", "raw"), 256))


def cluster_totals(clusters: DataFrame) -> DataFrame:
    """Lines, rows shown, and lines in clusters of two or more."""
    many = F.when(F.col("n") >= 2, F.col("n"))
    return clusters.agg(F.sum("n").alias("lines"), F.count("*").alias("rows"), F.coalesce(F.sum(many), F.lit(0)).alias("clustered_lines"), F.count(many).alias("clusters"))
