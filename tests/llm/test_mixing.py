import random

from pyspark.sql import functions as F

from logweave.llm.mixing import mix, mixed_texts, op3_mixing, schedule, source_targets

from .util import WORD, corpus, documents, prose


def test_targets_stop_at_twice_the_size():
    t = source_targets({"a": 100, "b": 1000, "c": 10, None: 50})
    assert t["a"] == 200 and abs(sum(t.values()) - 1.5 * 1160) < 1e-6
    assert all(t[s] <= 2 * n for s, n in {"a": 100, "b": 1000, "c": 10, None: 50}.items())
    assert source_targets({"a": 0}) == {"a": 0.0}


def test_schedule_is_mixed_in_every_stretch(spark):
    rows = schedule(spark, {"x": 500.0, "y": 250.0, "z": 250.0}, 1).orderBy("slot").collect()
    assert len(rows) == 1000 and sorted(r["rank"] for r in rows if r.name == "x") == list(range(sum(r.name == "x" for r in rows)))
    for at in range(0, 1000, 100):
        assert abs(sum(r.name == "x" for r in rows[at : at + 100]) - 50) <= 3


def test_sources_come_near_their_targets_and_reruns_agree(spark, tmp_path):
    rng = random.Random(3)
    texts = corpus() + [prose(rng, 200) for _ in range(90)]
    documents(spark, texts, str(tmp_path))
    rows = op3_mixing(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    assert {r.doc_id: r["size"] for r in rows} == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.02 * target + 64
    again = op3_mixing(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}


def test_texts_follow_the_mix_and_edge_tables(spark):
    docs = documents(spark, corpus())
    plan = {r.doc_id: r.taken for r in mix(docs, block=4).collect()}
    got = {}
    out = mixed_texts(docs, block=4)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert got == {k: v for k, v in plan.items() if v}
    assert mix(docs.where("false")).collect() == []
    odd = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("source"), F.lit(1).alias("name"), F.lit(2).alias("size"))
    assert sum(r.taken for r in mix(odd).collect()) > 0


def test_sources_smaller_than_a_block_come_to_their_targets(spark):
    sizes = {"a": 1, "b": 20, "c": 50, "d": 150, "e": 3000, None: 33}
    rows = [(i, s, " ".join(f"w{j}" for j in range(n // 2 * k, n if k else n // 2))) for i, (s, n) in enumerate(sizes.items()) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {}
    for r in mix(docs, block=100).collect():
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"]
        got[r.source] = (r.target, got.get(r.source, (0, 0))[1] + r.taken)
    assert got.keys() == sizes.keys()
    assert all(abs(taken - target) <= 0.5 for target, taken in got.values()), got


def test_repeated_rows_share_what_they_take_and_names_may_clash(spark):
    rows = [(i % 3 if i < 60 else i, "a", " ".join(f"w{j}" for j in range(7 if i < 60 else 40))) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 mix_size", "2 taken", "3 `row`", "4 `a.b`")
    plan = mix(docs).collect()
    out = mixed_texts(docs)
    assert out.columns == docs.columns and sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in plan)
    assert mixed_texts(docs.where("false")).collect() == []
