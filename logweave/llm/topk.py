"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are cut into ranges of `block` documents by id.  A block keeps the greatest and the smallest value of each term
(dimension) beside its forward index, the plain vectors.  For a query the sum over terms of the greatest
contribution bounds every score in the block.  A query takes the blocks in order of their bounds, scores whole blocks
through their forward indexes, and stops where the bound falls below its k-th best score.

The query set is dealt in groups of `query_group` against shards, which are ranges of ids too, so no task holds all
vectors or all queries; each shard answers with its best k for each query, and a last ranking merges them.  Rows that
share an id are dealt to as many shards as their number needs.

Results by case: vectors that are null or hold null or non-finite components take no part; those of other lengths
count as padded with zeros; rows with a query's own id are its own row and no candidates; repeated candidate rows
count each; a null id takes part as a candidate that loses ties; an empty table gives an empty result.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, partitions

LAST = np.iinfo(np.int64).max
ROWS = "ids binary, nulls binary, vectors binary, rows long, width long"


def pack_blocks(block, name):
    """Rows of up to `block` vectors by id: ids, which ids are null, and the vectors as doubles."""

    def pack(key, rows):
        rows = rows.sort_by("id").combine_chunks()
        ids, nulls = rows.column("id").fill_null(0).to_numpy(), rows.column("id").is_null().to_numpy()
        lists = rows.column("vector").chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.float64()))
        sizes, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
        until = np.concatenate(([0], np.cumsum(sizes)))
        out = []
        for a in range(0, rows.num_rows, block):
            b = min(a + block, rows.num_rows)
            size = sizes[a:b]
            dense = np.zeros((b - a, int(size.max())))
            line = np.repeat(np.arange(b - a), size)
            dense[line, np.arange(len(line)) - np.repeat(until[a:b] - until[a], size)] = values[until[a] : until[b]]
            out.append({name: key[0].as_py(), "ids": ids[a:b].astype("<i8").tobytes(), "nulls": nulls[a:b].tobytes(), "vectors": dense.astype("<f8").tobytes(), "rows": b - a, "width": dense.shape[1]})
        return pa.Table.from_pylist(out, pa.schema([(name, pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("vectors", pa.binary()), ("rows", pa.int64()), ("width", pa.int64())]))

    return pack


def unpack(rows, width):
    """Lists of ids, null marks and vectors, padded to a width."""
    out = []
    for r in rows.select(["ids", "nulls", "vectors", "rows", "width"]).to_pylist():
        dense = np.zeros((r["rows"], width))
        dense[:, : r["width"]] = np.frombuffer(r["vectors"], "<f8").reshape(r["rows"], r["width"])
        out.append((np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["nulls"], bool), dense))
    return out


def best(scores, ids, nulls, k):
    """Places of the k best: score, then smaller id, null ids last."""
    order = np.lexsort((ids, nulls, -scores))
    return order[:k]


def search(queries, blocks, k):
    """(query ids, per query ids, nulls and scores of the best k), from lists of (ids, nulls, vectors)."""
    qid, q = np.concatenate([x[0] for x in queries]), np.concatenate([x[2] for x in queries])
    high = np.array([b[2].max(axis=0) for b in blocks])
    low = np.array([b[2].min(axis=0) for b in blocks])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    turn = np.argsort(-bounds, axis=1, kind="stable")
    floor = np.full(len(q), -np.inf)
    found = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))] * len(q)
    live = np.arange(len(q))
    for step in range(len(blocks)):
        at = turn[live, step]
        # an equal bound may still win a tie by its id
        keep = bounds[live, at] >= floor[live]
        live, at = live[keep], at[keep]
        if len(live) == 0:
            break
        for b in np.unique(at):
            some = live[at == b]
            ids, nulls, vectors = blocks[b]
            scores = q[some] @ vectors.T
            for row, i in zip(scores, some):
                able = np.flatnonzero((row >= floor[i]) & ((ids != qid[i]) | nulls))
                if len(able) > k:
                    cut = np.partition(row[able], -k)[-k]
                    able = able[row[able] >= cut]
                s, d, n = (np.concatenate(x) for x in zip(found[i], (row[able], ids[able], nulls[able])))
                top = best(s, d, n, k)
                found[i] = (s[top], d[top], n[top])
                if len(top) == k:
                    floor[i] = s[top[-1]]
    return qid, found


def search_shard(k):
    def answer(key, queries, blocks):
        width = max([*queries.column("width").to_pylist(), *blocks.column("width").to_pylist(), 0])
        if queries.num_rows == 0 or blocks.num_rows == 0:
            qid, found = np.zeros(0, np.int64), []
        else:
            qid, found = search(unpack(queries, width), unpack(blocks, width), k)
        sizes = [len(f[0]) for f in found]
        join = lambda j, kind: np.concatenate([np.zeros(0, kind), *(f[j] for f in found)])
        ids, nulls = join(1, np.int64).astype(np.int64), join(2, bool).astype(bool)
        return pa.table({"query_id": np.repeat(qid, sizes).astype(np.int64), "vec_id": pa.array(ids, mask=nulls), "score": join(0, float)})

    return answer


def shard_of(bounds):
    """Numbers of ranges of ids; an id that is a bound itself is dealt by hash to the ranges that meet there."""
    bounds = np.sort(np.array(bounds, np.int64))

    def number(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(bounds, ids.to_numpy(), side) for side in ("left", "right"))
        return pd.Series(low + hashes.to_numpy() % (high - low + 1))

    return F.pandas_udf(number, "long")


def top_k(vectors: DataFrame, is_query, k=20, block=256, query_group=1024, shard_rows=16384, key="vec_id", vector="vector") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k greatest inner products of each query, ties to the smaller id.

    vectors: (key, vector array<double>); is_query: a condition on key.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    asked = rows.where(is_query(F.col("id")))
    n, n_asked = rows.count(), asked.count()
    shards, groups = max(1, -(-n // shard_rows), min(partitions(spark), -(-n // (4 * block)))), max(1, -(-n_asked // query_group))

    place, mark = F.coalesce("id", F.lit(LAST)), F.xxhash64("id", "vector")
    parts = [i / shards for i in range(1, shards)]
    bounds = rows.agg(F.percentile_approx(place, parts, max(10000, 8 * shards))).first()[0] if n and parts else []  # one number a shard

    def dealt(df, mark, name, others, other):
        packed = df.withColumn(name, mark).groupBy(name).applyInArrow(pack_blocks(block, name), f"{name} long, {ROWS}")
        return packed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)).cast("array<long>")))

    left = dealt(asked, F.pmod(mark, F.lit(groups)), "query_part", shards, "shard").groupBy("query_part", "shard")
    right = dealt(rows, shard_of(bounds)(place, mark), "shard", groups, "query_part").groupBy("query_part", "shard")
    found = left.cogroup(right).applyInArrow(search_shard(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = F.transform("embedding", lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(F.floor(x.cast("double") * 64)).cast("double"))
    found = top_k(rows.select("vec_id", whole.alias("vector")), lambda i: i % 20 == 0, k=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


ORACLE = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 64)) as v from embeddings
  where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score
  from whole q join whole d on q.vec_id % 20 = 0 and d.vec_id <> q.vec_id),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20
"""
