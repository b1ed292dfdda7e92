"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points are mapped through the cumulative targets, so any stretch of the schedule is mixed as the
whole is.  Slots are ranked per source.  Each source's documents are shuffled by a hash, laid end to end and cut
into blocks of equally many words; the slot of rank r takes block r modulo the number of blocks, at most twice.

A source's block is at most a 64th of the source, so that small sources are mixed like large ones.  Slots are counted
in words really taken: a source has as many as its blocks need to reach the target, the last one is cut to what is
left, slots beyond it take nothing, and slots that the points leave out follow after the schedule's end.  So every
source takes its target to the word, whatever the size of the corpus.

Ranks and places are two-level sums: within small groups first, then over the groups' totals.  So a source with a
third of all rows, or a third of the schedule, is never sorted in one task.  The driver sees one row per source.

Results by case: null and empty texts have size 0 and take nothing; a null source is a source of its own, last in
order; repeated rows are separate documents; a null id is kept; an empty table gives an empty result.  The order
depends only on ids, texts and the seed, so that reruns agree.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow_batches, checkpointed
from .kernels import give_back, slices, text_bytes, words

GOLDEN = 0.6180339887498949
GRID = 4096  # cells of the unit interval, at least, to look up a point's source by equality
GROUPS = 1024  # of a source's documents
TURN = 4096  # slots that are ranked together
SHARE = 64  # blocks of a source, at least, if it has as many words


def source_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Target of each source: `share` of all sizes by weight, none above `most` times its size.

    sizes: {source or None: size}.  Weights repeat over the sources by code point, None last.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, open_ = {}, share * sum(sizes.values()), list(order)
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not above:
            target.update({s: unit * weight[s] for s in open_})
            break
        for s in above:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ = [s for s in open_ if s not in target]
    return {s: float(target[s]) for s in order}


def count_words(text):
    def count(batches):
        for batch in batches:
            for part in slices(batch, text):
                _, _, first = words(*text_bytes(part.column(text)))
                rest = part.drop_columns([text]) if isinstance(part, pa.Table) else pa.Table.from_batches([part]).drop_columns([text])
                yield from rest.append_column("size", pa.array(np.diff(first))).to_batches()

    return count


def sized_documents(docs, key, source, text):
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("key", "text"))
    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(count_words("text"), f"key {kind}, source string, mark long, size long")


def named(source):
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def schedule(spark, targets, block):
    """(name, slot, rank) of each slot: golden-ratio points through the cumulative targets."""
    total = sum(targets.values())
    rows, low = [], 0.0
    for name, target in targets.items():
        if target > 0:
            rows.append((name, low / total, (low + target) / total))
            low += target
    slots = math.ceil(total / block) if total else 0
    grid = max(GRID, 4 * len(rows))
    cells = spark.createDataFrame(rows, "name string, low double, high double")
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * grid), F.least(F.floor(F.col("high") * grid), F.lit(grid - 1)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"pmod((id + 0.5D) * {GOLDEN}D, 1.0D)").alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * grid))
    met = points.join(cells, "cell").where("point >= low and point < high").select("name", "slot", F.expr(f"slot div {TURN}").alias("turn"))
    within = Window.partitionBy("name", "turn").orderBy("slot")
    before = Window.partitionBy("name").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    counts = met.groupBy("name", "turn").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = met.withColumn("within", F.row_number().over(within) - 1).join(counts, ["name", "turn"])
    return ranked.select("name", "slot", (F.col("before") + F.col("within")).alias("rank"))


def source_facts(sizes, targets, most, block):
    """(name, source_size, target, step, blocks, need, last, cut) of each source.

    step: words in a block; need: slots until the target is taken; last, cut: the block of the last slot and its words.
    """
    out = []
    for name, target in targets.items():
        size = sizes[name]
        step = max(1, min(block, size // SHARE))
        blocks = -(-size // step)
        passes, rest = divmod(int(min(math.floor(target + 0.5), most * size)), size) if size else (0, 0)
        tail = -(-rest // step)
        need = passes * blocks + tail
        out.append((name, size, target, step, blocks, need, (need - 1) % blocks if need else -1, rest - (tail - 1) * step if tail else step))
    return out


def mix(docs: DataFrame, weights=(5, 2, 1), share=1.5, most=2, block=None, seed=0, key="doc_id", source="source", text="text") -> DataFrame:
    """(key, source, mark, size, source_size, target, taken) for each row of docs.

    taken: words of the document that the mix takes, repeats counted, at most `most` times its size.
    block: words in a block, at most; by default as many as make about a million blocks, 16 at least.
    """
    spark = docs.sparkSession
    sized = checkpointed(sized_documents(docs, key, source, text)).withColumn("name", named(F.col("source")))
    totals = {r.name: r.total for r in sized.groupBy("name").agg(F.sum("size").alias("total")).collect()}
    plain = {(n[1:] if n[0] == "s" else None): v for n, v in totals.items()}
    targets = {"n" if s is None else "s" + s: t for s, t in source_targets(plain, weights, share, most).items()}
    block = block or max(16, math.ceil(sum(totals.values()) / (1 << 20)))

    facts = source_facts(totals, targets, most, block)
    slots = {f[0]: float(f[5]) for f in facts}
    facts = spark.createDataFrame(facts, "name string, source_size long, target double, step long, blocks long, need long, last long, cut long")
    facts = F.broadcast(facts) if len(targets) <= 1000 else facts
    shuffled = sized.withColumn("turned", F.xxhash64(F.lit(seed), "mark")).withColumn("part", F.pmod("turned", F.lit(GROUPS)))
    within = Window.partitionBy("name", "part").orderBy("turned", "key", "size")
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shuffled.groupBy("name", "part").agg(F.sum("size").alias("words"))
    offsets = offsets.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    placed = shuffled.withColumn("row", F.row_number().over(within)).withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(offsets, ["name", "part"]).withColumn("at", F.col("before") + F.col("upto") - F.col("size"))

    pieces = placed.join(facts.select("name", "step", "last", "cut"), "name")
    pieces = pieces.withColumn("block", F.explode_outer(F.expr("case when size > 0 then sequence(at div step, (at + size - 1) div step) end")))
    pieces = pieces.withColumn("low", F.expr("greatest(at, block * step)")).withColumn("high", F.expr("least(at + size, (block + 1) * step)"))
    met = schedule(spark, slots, 1).join(facts.select("name", "blocks", "need"), "name").where("rank < need").select("name", "rank", "blocks")
    counts = met.groupBy("name").agg(F.count("*").alias("met"))
    lacking = facts.join(counts, "name", "left").withColumn("met", F.coalesce("met", F.lit(0))).where("met < need")
    lacking = lacking.select("name", F.explode(F.expr("sequence(met, need - 1)")).alias("rank"), "blocks")
    turns = met.unionByName(lacking).groupBy("name", F.expr("rank % blocks").alias("block")).agg(F.count("*").alias("times"))
    joined = pieces.join(turns, ["name", "block"], "left")
    words = F.expr("coalesce((high - low) * times - if(block = last, greatest(0, high - greatest(low, block * step + cut)), 0), 0)")
    taken = joined.groupBy("name", "part", "row", "key", "source", "mark", "size").agg(F.sum(words).alias("taken"))
    out = taken.join(facts, "name")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "mark", "size", "source_size", "target", "taken")


def emit_texts(batches):
    """Rows (row, text) from (row, text, size, taken): whole turns, and the words of a last turn that is cut."""
    for batch in batches:
        for part in slices(batch, "text"):
            buf, off = text_bytes(part.column("text"))
            _, ends, first = words(buf, off)
            rows, texts = [], []
            for i, (size, taken) in enumerate(zip(part.column("size").to_pylist(), part.column("taken").to_pylist())):
                whole, rest = divmod(taken, size)
                own = buf[off[i] : off[i + 1]].tobytes()
                texts += [own] * whole + ([own[: ends[first[i] + rest - 1] - off[i]]] if rest else [])
                rows += [i] * (whole + (rest > 0))
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(rows, pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "text"])
        give_back()


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of docs: a document stands as often as the mix takes it.

    The turns of a source run through its blocks in order, so only the document in which its last turn ends is cut, behind
    the last word of the last block that the schedule takes.  What rows with one id and text take is dealt out among them.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    plan = mix(docs, **how).groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("of")).agg(F.first("size").alias("size"), F.sum("taken").alias("sum"), F.count("*").alias("n")).where("sum > 0")
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("key", "text"))
    met = rows.join(plan, rows["key"].eqNullSafe(plan["id"]) & (rows["mark"] == plan["of"]))
    number = F.row_number().over(Window.partitionBy("key", "mark").orderBy(F.xxhash64("row")))
    met = met.withColumn("number", F.when(F.col("n") > 1, number).otherwise(1))
    taken = F.expr("sum div n + if(number <= sum % n, 1, 0)").alias("taken")
    met = met.select("row", "text", "size", taken).where("taken > 0")
    out = met.mapInArrow(emit_texts, StructType([met.schema["row"], StructField("text", StringType())]))
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op3_mixing(spark, sf_dir):
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
