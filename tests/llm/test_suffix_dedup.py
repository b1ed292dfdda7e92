import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from logweave.llm.suffix_array import repeats, suffix_array
from logweave.llm.suffix_dedup import dedup_suffixes, op8_suffix_dedup

from .util import corpus, documents, prose


def test_suffix_array_and_repeats_equal_brute_force():
    rng = random.Random(1)
    for t in range(120):
        text = bytes(rng.choice(b"\x01ab\xff" if t % 2 else b"ab") for _ in range(rng.randrange(1, 150)))
        s = np.frombuffer(text + b"\0", np.uint8).astype(np.int64)
        for size in (3, 16, 250):
            order = suffix_array(s, size).tolist()
            assert sorted(order) == list(range(len(text)))
            heads = [text[i : i + size] for i in order]
            assert heads == sorted(heads)
            assert repeats(s, size).tolist() == [i for i in range(len(text) - size + 1) if text.find(text[i : i + size]) < i]


def brute(texts, size):
    seen, out = set(), {}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = True
            seen.add(w)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def odd_texts():
    rng = random.Random(17)
    line = prose(rng, 17, 900)[:80]
    texts = corpus(n=60) + ["x" * 400, "ab" * 300, "\0" * 150 + "é" * 120, "é" * 90]
    for _ in range(40):  # a passage just under the window in many contexts, and pieces of one long text
        texts.append(prose(rng, rng.randrange(30)) + " " + line + " " + prose(rng, rng.randrange(30)))
    long = prose(rng, 400, 900)
    for _ in range(30):
        a = rng.randrange(len(long) - 130)
        texts.append(prose(rng, rng.randrange(6), 900) + long[a : a + rng.randrange(95, 130)] + prose(rng, rng.randrange(6), 900))
    rng.shuffle(texts)
    return texts


def test_equals_brute_force(spark, tmp_path):
    texts = odd_texts()
    documents(spark, texts, str(tmp_path))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == brute(texts, 100) and sum(g[1] for g in got.values())


def test_small_windows_and_edge_tables(spark):
    texts = odd_texts()[:60]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(bytes(r.kept_bytes)).hexdigest()) for r in dedup_suffixes(documents(spark, texts), window=20, anchor=12).collect()}
    assert got == brute(texts, 20)
    same = documents(spark, ["q" * 5 + "abcdefghij" * 11] * 3).withColumns({"doc_id": F.lit(None).cast("long"), "chunk": F.lit(1), "key": F.lit(2), "kind": F.lit(3)})
    assert sorted(r.n_removed for r in dedup_suffixes(same).collect()) == [100, 115, 115]
    assert dedup_suffixes(same.where("false")).collect() == []


def test_one_of_rows_with_one_id_keeps_a_passage(spark):
    """Rows that share an id, or have none, lie in many chunks; a passage in all of them stays once."""
    rng = random.Random(5)
    passage = prose(rng, 60, 900)[:260]
    rows = [(k, f"{prose(rng, 12, 900)} {i} |{passage}| {prose(rng, 12, 900)} {i}") for k in (7, None) for i in range(60)]
    rows += [(3, f"{i}" * 5000) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = [dedup_suffixes(docs.repartition(n), chunk_bytes=2048).collect() for n in (3, 5)]
    assert sum(passage.encode() in r.kept_bytes for r in one[0]) == 1
    assert [r.n_removed for r in one[0] if r.doc_id == 3] == [4999] * 3  # the windows from byte 1 on repeat the first
    key = lambda r: (r.doc_id or 0, bytes(r.kept_bytes), r.n_removed)
    assert sorted(map(key, one[0])) == sorted(map(key, one[1]))


def test_repeats_are_sorted_where_they_differ_alone(monkeypatch):
    rng = np.random.default_rng(3)
    text = np.append(np.tile(np.append(rng.integers(2, 250, 4000), 1), 3), 0)
    sorted_rows, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or sort(keys))
    assert repeats(text, 100).tolist() == list(range(4001, len(text) - 100))
    assert sum(sorted_rows) < 2 * len(text)


def test_least_places_are_the_same_in_blocks(monkeypatch):
    from logweave.llm import suffix_dedup
    from logweave.llm.kernels import Powers, byte_prefix, span_hashes

    rng = np.random.default_rng(4)
    powers = Powers()
    prefix = byte_prefix(rng.integers(0, 3, 500).astype(np.uint8), powers)
    for block, window, anchor in ((1 << 15, 20, 12), (7, 20, 12), (64, 9, 9), (1, 30, 3)):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        places, hashes = suffix_dedup.least_places(prefix, powers, window, anchor)
        at = np.arange(500 - anchor + 1)
        want = span_hashes(prefix, at, at + anchor, powers)
        order = lambda i: (want[i] >> np.uint64(9), i)  # noqa: B023, E731
        assert (hashes == want).all() and places.tolist() == [min(range(i, i + window - anchor + 1), key=order) for i in range(500 - window + 1)]
