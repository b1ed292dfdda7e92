import collections
import hashlib

from logweave.llm.substring_dedup import dedup_substrings, op2_substring_dedup

from .test_near_dedup import thue_morse
from .util import WORD, corpus, documents


def brute(texts, size):
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = {}
    for k, w in enumerate(words):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_equals_brute_force(spark, tmp_path):
    texts = corpus()
    documents(spark, texts, str(tmp_path))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op2_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == brute(texts, 35)
    assert sum(x[1] for x in got.values())


def test_intervals_are_maximal_and_stay_in_their_document(spark):
    texts = ["a b c d x y", "a b c d", "c d", None]
    rows = {r.doc_id: r for r in dedup_substrings(documents(spark, texts), window=2).collect()}
    assert [(s.start, s.end) for s in rows[0].removed] == [(0, 4)] and rows[0].kept_text == "x y"
    assert [(s.start, s.end) for s in rows[1].removed] == [(0, 4)] and rows[1].kept_text == ""
    assert rows[2].n_removed == 2 and rows[3].n_words == 0


def test_empty_table_null_keys_clashing_columns(spark):
    df = documents(spark, ["p q r"] * 3).selectExpr("cast(null as long) doc_id", "text", "1 as chunk", "2 as bucket", "3 as key")
    assert [r.n_removed for r in dedup_substrings(df, window=3).collect()] == [3, 3, 3]
    assert dedup_substrings(df.where("false"), window=3).collect() == []


def test_words_that_collide_in_polynomials_are_different(spark):
    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    texts = [f"{a} x y", f"{b} x y", " ".join(thue_morse(128, "a", "b")), " ".join(thue_morse(128, "b", "a"))[: 2 * 64 - 1], "z" * 9000 + " x", "z" * 9000 + " x"]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_substrings(documents(spark, texts), window=2).collect()}
    assert got == brute(texts, 2) and got[0][1] == got[1][1] == 2
    long = [texts[2], texts[3], texts[2] + " " + "w " * 3000]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_substrings(documents(spark, long), window=35).collect()}
    assert got == brute(long, 35)
