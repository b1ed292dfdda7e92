"""What a followed log needs for each batch: carried stamps, a stored table, and watch notifications."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.views import watch_hits
from ..plans.parse import carry_forward, parse_lines


def last_state(entries: DataFrame) -> DataFrame:
    """(source, epoch, ts, ts_offset_s, level): what the next line of each source would inherit."""
    known = F.col("format_name") != "raw"
    stamp = F.max_by(F.struct("ts", "ts_offset_s"), F.when(known & F.col("ts").isNotNull(), F.col("line_no")))
    level = F.max_by("level", F.when(known & F.col("level").isNotNull(), F.col("line_no")))
    return entries.groupBy("source", "epoch").agg(stamp.alias("s"), level.alias("level")).select("source", "epoch", "s.ts", "s.ts_offset_s", "level")


def continued(lines: DataFrame, state: DataFrame | None) -> DataFrame:
    """Entries of a batch of lines, inheriting from the state of the batches before."""
    entries = carry_forward(parse_lines(lines), keys=("source", "epoch"))
    if state is None:
        return entries
    old = state.select("source", "epoch", F.struct("ts", "ts_offset_s").alias("_old"), F.col("level").alias("_old_level"))
    out = entries.join(old, ["source", "epoch"], "left")
    raw = F.col("format_name") == "raw"
    heir = raw & (F.col("continuation") | F.col("_old.ts").isNotNull() | F.col("_old_level").isNotNull())
    bare = heir & F.col("ts").isNull()
    return out.withColumns({
        "continuation": heir, "level": F.when(heir, F.coalesce("level", "_old_level")).otherwise(F.col("level")),
        "ts_offset_s": F.when(bare, F.col("_old.ts_offset_s")).otherwise(F.col("ts_offset_s")), "ts": F.when(bare, F.col("_old.ts")).otherwise(F.col("ts")),
    }).drop("_old", "_old_level")


class Follower:
    """A foreachBatch sink: entries are appended to a table as Parquet, and watch hits of new lines counted by rule.

    Carried state lies beside the table, one folder for each batch, so a batch that is run again gives the same.
    """

    def __init__(self, path: str, rules=None):
        self.path, self.rules = path, rules or {}

    def __call__(self, lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        state = spark.read.parquet(f"{self.path}/state/{batch - 1}") if batch else None
        entries = watch_hits(continued(lines, state).withColumn("node", F.lit(None).cast("string")), self.rules).withColumn("batch", F.lit(batch))
        entries.write.mode("overwrite").parquet(f"{self.path}/entries/batch={batch}")
        done = spark.read.parquet(f"{self.path}/entries/batch={batch}")
        new = last_state(done)
        if state is not None:
            both = new.alias("n").join(state.alias("o"), ["source", "epoch"], "full")
            stamp = F.when(F.col("n.ts").isNotNull(), F.struct("n.ts", "n.ts_offset_s")).otherwise(F.struct("o.ts", "o.ts_offset_s"))
            new = both.select("source", "epoch", stamp.alias("s"), F.coalesce("n.level", "o.level").alias("level")).select("source", "epoch", "s.ts", "s.ts_offset_s", "level")
        new.write.mode("overwrite").parquet(f"{self.path}/state/{batch}")
        hits = done.select(F.explode("hits").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
        hits.write.mode("overwrite").parquet(f"{self.path}/hits/batch={batch}")


def windowed(entries: DataFrame, step: str, late: str) -> DataFrame:
    """A streaming timeline: counts and worst level by window of event time; rows later than `late` are dropped."""
    from ..functions.text import worst_level

    at = F.col("ts").cast("timestamp")
    return entries.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", step)).agg(F.count("*").alias("n"), worst_level(F.col("level")).alias("worst_level"))
