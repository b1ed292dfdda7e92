import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_near_dedup import brute, near
from .test_packing import check
from .util import WORD, documents, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(20)
    texts = [prose(rng, rng.randrange(30, 300), 5000) for _ in range(60)]
    near_copy = near(rng, texts[0], 1)
    texts += [texts[3], near_copy, "too short", None, "", "x y z " * 40, texts[5] + " mail a.b@c.example now", prose(rng, 20_000, 9000)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    return path, texts, documents(spark, texts, path)


def test_stages_take_effect_on_all_that_is_left(spark, corpus):
    path, texts, docs = corpus
    good = corpus_pipeline.quality_rules(spark, docs, path)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and not kept & {62, 63, 64, 65} and len(kept) >= 60 and 67 in kept
    alone = corpus_pipeline.near_dedup(spark, docs, path)
    ids = {r.doc_id for r in alone.collect()}
    want = brute(texts, 5, 80, 100)
    assert alone.columns == docs.columns and ids == {i for i, (_, top) in want.items() if i == top}
    clean = corpus_pipeline.pii(spark, docs, path)
    assert clean.where("text like '%[EMAIL] now'").count() == 1 and clean.where("text like '%@%'").count() == 0
    mixed = corpus_pipeline.mixing(spark, alone, path)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= ids
    packed = corpus_pipeline.packing(spark, docs, path).collect()
    check(packed, texts)
    done = corpus_pipeline.run(spark, path)
    left = sorted(kept)
    want = {left[i] for i, (_, top) in brute([texts[i] for i in left], 5, 80, 100).items() if i == top}
    got = {r.doc_id for r in done.collect()}
    assert got <= want and len(got) > len(want) / 2 and "sequence_id" in done.columns


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_odd_tables(spark, corpus, name, stage):
    path, _, docs = corpus
    assert stage(spark, docs.where("false"), path).collect() == []
    some = docs.where("doc_id < 20")
    odd = some.selectExpr("cast(null as long) doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "n_chars", "1 mark", "2 `row`", "3 size", "4 `key`", "5 `a.b`")
    odd = odd.unionByName(odd.where("text is not null").limit(5)).unionByName(odd.limit(3).withColumn("text", F.lit(None).cast("string")))
    got = stage(spark, odd, path)
    rows = got.collect()
    if name == "packing":
        assert sum(r.length for r in rows if r.start == 0) > 0 and {r.doc_id for r in rows} == {None}
        return
    assert got.columns == odd.columns
    words = [len(WORD.findall(r.text or "")) for r in rows]
    if name == "quality_rules":
        assert all(n >= 20 for n in words) and len(rows) >= 18
    if name == "near_dedup":
        assert len(rows) == 20 + 1 and len({r.text for r in rows if r.text}) == 20
    if name == "pii":
        assert len(rows) == odd.count() and all(r.text is not None for r in rows)
    if name == "mixing":
        assert sum(words) > 0 and all(words)


def test_near_dedup_finds_copies_far_apart_in_a_large_region(spark, monkeypatch):
    from functools import partial

    import numpy as np
    import pyarrow as pa

    from logweave.llm.near_dedup import near_duplicates, shingle_sets, signatures

    # one order of two labels: a region holds hundreds of documents
    monkeypatch.setattr(corpus_pipeline, "near_duplicates", partial(near_duplicates, trees=1, labels=2))
    rng = random.Random(8)
    passage = prose(rng, 70, 900)
    texts = [f"{passage} {prose(rng, 30, 90_000)}" for _ in range(1300)]
    texts += [t.rsplit(" ", 1)[0] + " another" for t in texts[:30]]
    region, sizes = np.unique(signatures(shingle_sets(pa.array(texts), 5), 2), axis=0, return_inverse=True, return_counts=True)[1:]
    large = [i for i in range(30) if region[i] == region[1300 + i] and sizes[region[i]] > 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert len(large) > 5 and kept >= set(range(1300)) and not kept & {1300 + i for i in large}


def test_near_dedup_finds_copies_whose_labels_differ(spark, monkeypatch):
    from functools import partial

    import pyarrow as pa

    from logweave.llm.near_dedup import near_duplicates, shingle_sets, signatures

    # with so few labels many pairs over the similarity agree in less than 0.6 of them
    monkeypatch.setattr(corpus_pipeline, "near_duplicates", partial(near_duplicates, trees=1, labels=7))
    rng = random.Random(3)
    texts = [prose(rng, 100, 90_000).split() for _ in range(1000)]
    texts = [" ".join(t) for t in texts] + [" ".join([*t[:30], "a", *t[31:60], "b", *t[61:]]) for t in texts]
    marks = signatures(shingle_sets(pa.array(texts), 5), 7)
    agree = marks[:1000] == marks[1000:]
    odd = [i for i in range(1000) if agree[i, :2].all() and agree[i].sum() <= 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert len(odd) > 9 and kept >= set(range(1000)) and not kept & {1000 + i for i in odd}
