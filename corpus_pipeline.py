"""The corpus pipeline: quality rules, near-duplicate removal, redaction, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.

Results by case, in every stage: verdicts hold for rows, not for ids, so a null or repeated id changes nothing; null
texts count as empty, which the quality rules reject, redaction turns into empty texts and the mix leaves out; rows that
are alike in all columns get the same verdict, and near_dedup keeps one of them; ties go to the smaller id; long texts
are worked on whole; an empty table gives an empty table; further columns, whatever their names, are carried along.
"""

import uuid

from pyspark.sql import functions as F

from logweave.llm.mixing import mixed_texts
from logweave.llm.near_dedup import near_duplicates
from logweave.llm.packing import pack_documents
from logweave.llm.pii import redact_documents
from logweave.llm.quality_rules import assess


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and lie in their language's perplexity bands."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    mark = F.concat_ws(":", F.xxhash64(*own), F.xxhash64(F.lit(1), *own))
    rows = docs.select(F.struct(*own).alias("row"), mark.alias("mark"))
    kept = assess(rows.select("mark", "row.lang", "row.text"), key="mark").where("kept").select("mark").distinct()
    return rows.join(kept, "mark", "left_semi").select("row.*")


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates: the one with the smallest id."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("row"), F.xxhash64("doc_id", "text").alias("node"))
    verdicts = near_duplicates(rows.select("node", "row.text"), key="node").select("node", "component_id")
    # a node's id comes from the documents; null ones stand behind all others
    ids = rows.select("node", F.col("row.doc_id").alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")
    kept = verdicts.distinct().join(ids, "node").groupBy("component_id").agg(first).select("first.node")
    left = rows.join(kept, "node", "left_semi")
    again = verdicts.groupBy("node").count().where("count > 1").select("node")
    if not again.isEmpty():
        left = left.join(again, "node", "left_anti").unionByName(left.join(again, "node", "left_semi").dropDuplicates(["node"]))
    return left.select("row.*")


def pii(spark, docs, sf_dir):
    """Every document, with marks in place of personal data."""
    return redact_documents(docs)


def mixing(spark, docs, sf_dir):
    """Documents as often as the mix takes them; where a source's share ends within a document, its last turn is cut."""
    return mixed_texts(docs)


def packing(spark, docs, sf_dir):
    """The pieces of all documents, packed into sequences."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

# The model's perplexities, the forest's order of work and the tokenizer's ids are not for SQL; see tests/llm.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to documents, each written as Parquet below the checkpoint folder and read again."""
    from logweave.llm.common import work_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
