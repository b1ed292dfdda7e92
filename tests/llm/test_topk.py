import math
import random

import duckdb
from pyspark.sql import functions as F

from logweave.llm import topk
from logweave.llm.topk import ORACLE, op5_topk_search, top_k


def brute(rows, k):
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q is not None and q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, v)), i is None, i or 0) for i, v in good if i != q)
            out += [(q, r + 1, None if n else i, -s) for r, (s, n, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_equals_brute_force_with_ties_and_odd_vectors(spark):
    rng = random.Random(7)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 0.0, -1.0, 3.0, 0.0]) for i in range(60)]
    rows += [(400, None), (420, [1.0, None]), (440, [math.nan] * 6), (460, [math.inf]), (480, []), (500, [9.0]), (None, [3.0] * 6), (20, [2.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(5).withColumns({"id": F.lit(1), "shard": F.lit(2)})
    got = top_k(df, lambda i: i % 20 == 0, k=7, block=8, query_group=5, shard_rows=64).collect()
    want = brute([r for r in rows], 7)
    once = {x[0] for x in want} - {20}
    assert sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in got if r.query_id in once], key=str) == [x for x in want if x[0] in once]


def test_bounds_prune_blocks(monkeypatch):
    import numpy as np

    block = lambda i, v: (np.arange(i, i + 4), np.zeros(4, bool), np.full((4, 2), float(v)))
    seen = []
    real = topk.best
    monkeypatch.setattr(topk, "best", lambda *a: seen.append(1) or real(*a))
    _, found = topk.search([(np.array([99]), np.zeros(1, bool), np.ones((1, 2)))], [block(0, 1), block(4, 5), block(8, -3)], 3)
    assert list(found[0][1]) == [4, 5, 6] and len(seen) == 1


def test_query_equals_sql_and_empty_table(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in op5_topk_search(spark, path).select("query_id", "rank", "vec_id", "score").collect())
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    assert got == sorted(db.execute(ORACLE).fetchall())
    assert top_k(spark.createDataFrame([], "vec_id long, vector array<double>"), lambda i: i % 20 == 0).collect() == []


def test_a_hot_id_is_dealt_to_several_shards(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(100)] + [(55, [float(i), -1.0]) for i in range(200)] + [(None, [float(i), 0.5]) for i in range(200)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, vector array<double>"), lambda i: i % 20 == 0, k=5, block=4, shard_rows=16).collect()
    assert sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in got], key=str) == brute(rows, 5)
