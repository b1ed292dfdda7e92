"""What the operators share on the driver: sizes, checkpoints, tables."""

import math
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def arrow_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows: with long texts the default of 10,000 rows is too much for a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def work_folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; one of its own only on a local master where none is set (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    work_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_size(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of a whole text column."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def power_of_two(x: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, x))))


def chunked(docs: DataFrame, key: str, text: str, size: int, chunk_bytes: int = 1 << 20) -> DataFrame:
    """(key, text, chunk): each chunk holds about `chunk_bytes` of text.  Texts are spread by key and text,
    so neither a hot source nor a null key fills a chunk.  Two plans over the result share one exchange."""
    spark = docs.sparkSession
    n = max(8, size // chunk_bytes + 1)  # by size alone: rows that chunks send to buckets must not grow with the cluster
    spread = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    spread = spread.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(n)))
    return spread.repartition(partitions(spark), "chunk")
