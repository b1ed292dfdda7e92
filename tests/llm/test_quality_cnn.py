import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm.quality_cnn import CHUNK, GAP, STRIDE, activations, features, fit, layout, quality_scores

from .util import documents, prose


def weights(seed=0):
    return fit([b"aa bb cc", b"%% ## @@"], [1, 0], epochs=1, seed=seed)


def test_chunks_cover_the_whole_text_and_documents_do_not_mix():
    w = weights()
    texts = [b"x" * 1000 + b"END", b"", b"short", bytes(range(256)) * 3]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    together = features(*layout(buf, off), w)
    for i, t in enumerate(texts):
        alone = features(*layout(np.frombuffer(t, np.uint8), np.array([0, len(t)])), w)
        assert np.allclose(alone[0], together[i], atol=1e-5)
    # brute force over chunks of two cells
    t = texts[3]
    codes, begin = layout(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    z = np.tanh(activations(codes, w))
    z[-GAP:] = -1
    most = [z[a * STRIDE : a * STRIDE + CHUNK].max(axis=0) for a in range(begin[-1])]
    assert len(z) == begin[-1] * STRIDE and np.allclose(together[3], np.concatenate((np.mean(most, axis=0), np.max(most, axis=0))), atol=1e-5)


def test_gradient_step_lowers_the_loss_and_reruns_agree():
    a, b = weights(1), weights(1)
    assert all(np.array_equal(a[k], b[k]) for k in a)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    good = [prose(rng, rng.randrange(5, 120)) for _ in range(80)]
    bad = [" ".join(rng.choice("#%&@") * 3 + str(rng.randrange(9)) for _ in range(rng.randrange(5, 120))) for _ in range(80)]
    texts = [x for pair in zip(good, bad) for x in pair] + ["", None, "é" * 5000]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(160)] + [(3, None), (None, 1)], "doc_id long, quality int")
    return documents(spark, texts), labels


def test_held_out_rows_are_told_apart(tables):
    docs, labels = tables
    rows = quality_scores(docs, labels, sample=100).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 160]
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in held) >= 0.95 * len(held)


def test_edge_tables(tables):
    docs, labels = tables
    assert quality_scores(docs.where("false"), labels, sample=20).collect() == []
    odd = docs.limit(3).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("key"), F.lit(2).alias("label"))
    assert [r.score for r in quality_scores(odd, labels.where("false")).collect()] == [0.5] * 3
