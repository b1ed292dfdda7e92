"""Global row numbers and running values without a window over the whole table."""

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; a folder of its own only on a local master where none is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint(eager=True)


def with_position(df: DataFrame, *order, name="pos") -> DataFrame:
    """df with the number of each row from 0 in the given total order.

    Rows are dealt out by range and numbered inside their range; only one count for each range is summed up.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = saved(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    numbered = numbered.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = numbered.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    out = numbered.join(F.broadcast(starts), "_part")  # as many rows as shuffle partitions
    return out.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_id", "_start")


def carried(df: DataFrame, values: dict, keys, order: str, segment: int = 1_000_000) -> DataFrame:
    """df with, for each name: Column in values, its last non-null value up to the row, by keys and order.

    The fold runs inside segments of `segment` places, so that one long source is not one task; each segment starts
    from the last values of the segments before it.
    """
    # read twice: written once, so that what df rests on (parsing, as a rule) is not worked out again
    df = saved(df.withColumns({f"_v_{n}": c for n, c in values.items()}).withColumn("_segment", F.floor(F.col(order) / segment)))
    inside = Window.partitionBy(*keys, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, "_segment").agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_e_{n}") for n in values))
    starts = ends.select(*keys, "_segment", *(F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_s_{n}") for n in values))
    out = df.withColumns({f"_c_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values}).join(starts, [*keys, "_segment"])
    out = out.withColumns({n: F.coalesce(f"_c_{n}", f"_s_{n}") for n in values})
    return out.drop("_segment", *(f"_{k}_{n}" for n in values for k in "vcs"))
