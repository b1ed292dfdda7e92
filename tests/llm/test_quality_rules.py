import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from logweave.llm import quality_rules
from logweave.llm.quality_rules import assess, discounts, op4_quality_rules, smoothed

from .test_near_dedup import thue_morse
from .util import WORD, corpus, documents, prose


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    inside = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w))


def test_base_statistics_equal_brute_force(spark, tmp_path):
    rng = random.Random(1)
    texts = corpus() + ["a#b |c\n" * 5 + prose(rng, 30), "x y\n\n \nx y\nx y\r\n", prose(rng, 40, 3), "\n", "q\n" + "é😀 " * 30]
    documents(spark, texts, str(tmp_path))
    rows = {r.doc_id: r for r in op4_quality_rules(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
        assert not (r.base_failed and r.kept)


def off(c, d):
    return 0.0 if c <= 0 else d[min(c, 3) - 1]


def brute_perplexity(texts, order=5):
    """Log perplexity of each text by plain dictionaries, each n-gram scored without its own occurrence."""
    grams = [[(b"\0" * (order - 1) + t.encode())[i : i + order] for i in range(len(t.encode()))] for t in texts]
    counts = [Counter(g for own in grams for g in own)]
    for _ in range(order - 1):
        counts.append(Counter(g[1:] for g in counts[-1]))
    ds = [discounts([sum(v == i for v in c.values()) for i in range(1, 5)]) for c in counts]
    after = []
    for c in counts:
        own = {}
        for g, n in c.items():
            own.setdefault(g[:-1], []).append(n)
        after.append(own)

    def p(level, g, without):
        if level == order:
            return 1 / 256
        c, d, others = counts[level][g], ds[level], list(after[level][g[:-1]])
        without = without and level < order - 2  # the two lowest orders are taken as they are
        if without:
            others.remove(c)
            others.append(c - 1)
        total = sum(others)
        lower = p(level + 1, g[1:], without and c == 1)
        return lower if total == 0 else (max(c - without - off(c - without, d), 0) + sum(off(n, d) for n in others) * lower) / total

    return [-sum(math.log(p(0, g, True)) for g in own) / max(1, len(WORD.findall(t))) for t, own in zip(texts, grams)]


def test_perplexities_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["", "a", "é😀 x", *(prose(rng, rng.randrange(1, 60), 300) for _ in range(40)), "qqqq zzzz", prose(rng, 400)]
    texts.append(texts[9])
    want = brute_perplexity(texts)
    for size, fan in ((2 << 20, 128), (300, 3)):
        monkeypatch.setattr(quality_rules, "CHUNK_BYTES", size)
        monkeypatch.setattr(quality_rules, "FAN_IN", fan)
        got = {r.doc_id: r for r in assess(documents(spark, texts)).collect()}
        assert all(abs(got[i].log_perplexity - w) < 2e-3 * max(1, w) for i, w in enumerate(want))
        fit = sorted(r.log_perplexity for r in got.values() if not r.base_failed)
        low, high = fit[max(0, math.ceil(len(fit) / 4) - 1)], fit[math.ceil(3 * len(fit) / 4) - 1]
        for r in got.values():
            assert r.kept == (not r.base_failed and low - 3 * (high - low) <= r.log_perplexity <= high + 5 * (high - low))


def test_smoothing_uses_the_shorter_context():
    lower = np.full(4, 0.25)
    assert np.allclose(smoothed(np.zeros(4), lower, [0.5, 1, 1.5]), lower)
    p = smoothed(np.array([[3.0, 1, 0, 2], [0, 0, 0, 0]]), lower[None, :], [0.5, 1, 1.5])
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()


def test_words_that_collide_in_polynomials_are_no_repeats(spark, tmp_path):
    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    documents(spark, [f"{a}\n{b}\n" + prose(random.Random(1), 30), " ".join([a] * 4 + [b] * 4 + [a] * 4)], str(tmp_path))
    rows = {r.doc_id: r for r in op4_quality_rules(spark, str(tmp_path)).collect()}
    assert rows[0].n_dup_lines == 0 and rows[1].n_repeat_words == 0


def test_bands_reject_odd_text_and_keep_prose(spark):
    rng = random.Random(4)
    good = [prose(rng, rng.randrange(40, 90)) for _ in range(120)]
    odd = ["".join(chr(rng.randrange(33, 127)) for _ in range(12)) + " " for _ in range(1)]
    odd = [" ".join("".join(chr(rng.randrange(33, 127)) for _ in range(25)) for _ in range(40))]
    rows = {r.doc_id: r for r in assess(documents(spark, good + odd)).collect()}
    assert sum(rows[i].kept for i in range(120)) >= 118 and not rows[120].kept and not rows[120].base_failed


def test_edge_tables(spark):
    docs = documents(spark, corpus())
    assert assess(docs.where("false")).collect() == []
    odd = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), F.lit(1).alias("key"), F.lit(2).alias("model"))
    assert assess(odd).count() == docs.count()
    many = docs.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id")))
    assert assess(many).count() == docs.count()


def test_every_language_has_its_own_model_and_bands(spark, monkeypatch):
    rng = random.Random(9)
    shift = lambda t, k: "".join(chr((ord(c) - 97 + k) % 26 + 97) if c.isascii() and c.islower() else c for c in t)
    texts = [(k, shift(prose(rng, rng.randrange(30, 60)), k)) for k in range(18) for _ in range(30 - k)]
    rows = [(i, None if k == 17 else f"l{k}", t) for i, (k, t) in enumerate(texts)] + [(len(texts), "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = {r.doc_id: r for r in assess(docs).collect()}
    assert len(want) == len(rows)
    alone = docs.where("lang = 'l3'")
    for r in assess(alone).collect():
        assert abs(r.log_perplexity - want[r.doc_id].log_perplexity) < 1e-9 and (r.low, r.high) == (want[r.doc_id].low, want[r.doc_id].high)
    monkeypatch.setattr(quality_rules, "CHUNK_BYTES", 2000)
    got = {r.doc_id: r for r in assess(docs).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        w = want[i]
        assert (r.kept, r.base_failed, r.n_words) == (w.kept, w.base_failed, w.n_words)
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-6) for a, b in ((r.log_perplexity, w.log_perplexity), (r.low, w.low), (r.high, w.high)))
