"""Ordered merge of many sources, with zones, skew and lines without a stamp."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.positions import carried, saved, with_position


def with_moment(entries: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Adds moment, the sort key; raw and ts stay as they are.

    If any stamp lacks an offset, wall clocks are compared; else instants.  With facts (source, node, zone_offset_s,
    skew_s, correct_skew) of two sources at least, whose zones are all known and differ, or of which one is corrected by
    a skew other than zero, every stamp becomes an instant: naive ones by their source's zone (UTC where none is known),
    all of them less the skew.
    """
    naive = entries.agg(F.coalesce(F.bool_or(F.col("ts").isNotNull() & F.col("ts_offset_s").isNull()), F.lit(False))).first()[0]
    if facts is not None:
        skew = F.col("correct_skew") & (F.coalesce("skew_s", F.lit(0.0)) != 0)
        members, known, zones, skewed = facts.agg(F.count("*"), F.count_if(F.col("zone_offset_s").isNull()) == 0, F.count_distinct("zone_offset_s"), F.coalesce(F.bool_or(skew), F.lit(False))).first()
        if members > 1 and (skewed or known and zones > 1):
            few = facts.select("source", "zone_offset_s", F.when(F.col("correct_skew"), F.col("skew_s")).otherwise(0.0).alias("_skew"))
            out = entries.join(few, "source", "left")
            seconds = (F.coalesce("ts_offset_s", "zone_offset_s", F.lit(0)) + F.coalesce("_skew", F.lit(0.0))).cast("decimal(18,6)")
            shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
            return out.withColumn("moment", F.col("ts") - shift).drop("zone_offset_s", "_skew")
    shift = F.lit(0) if naive else F.coalesce("ts_offset_s", F.lit(0))
    return entries.withColumn("moment", F.timestamp_add("SECOND", -shift, F.col("ts")))


def merged(entries: DataFrame, facts: DataFrame | None = None, name: str = "pos") -> DataFrame:
    """All rows with their place in the merge: by moment, then source and line.

    A row without a stamp stands at the last moment of its source before it, or in front where there is none.
    """
    stamped = with_moment(saved(entries), facts)  # read for the kind of its stamps first
    out = carried(stamped, {"_anchor": F.col("moment")}, ["source", "source_idx"], "line_no")
    out = out.withColumns({"rank": F.col("_anchor").isNotNull().cast("int"), "anchored": F.col("ts").isNull(), "moment": F.col("_anchor")}).drop("_anchor")
    return with_position(out, "rank", "moment", "source_idx", "line_no", name=name)


def skew_spread(facts: DataFrame) -> DataFrame:
    """The widest disagreement of the members' clocks; none for less than two."""
    return facts.agg(F.coalesce(F.max("skew_s") - F.min("skew_s"), F.lit(0.0)).alias("spread"))
