import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logweave.llm import near_dedup
from logweave.llm.components import components, renamed
from logweave.llm.kernels import pack_sorted
from logweave.llm.near_dedup import near_duplicates, op7_near_dedup, shingle_sets, signatures

from .util import WORD, documents, prose


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(texts, size, num, den):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
    return " ".join(w)


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    texts = [None, "", " ", "a", "A", "a b", "a  B", "É x", "é x"]
    for _ in range(30):
        t = prose(rng, rng.randrange(3, 150), 900)
        texts += [t] + [near(rng, t, rng.randrange(0, 6)) for _ in range(rng.randrange(5))]
    base = prose(rng, 200, 900)
    texts += [near(rng, base, rng.randrange(1, 5)) for _ in range(60)] + [base, base.upper()]
    # a group in which many pairs stay just under the similarity
    base = prose(rng, 90, 900)
    texts += [near(rng, base, rng.randrange(1, 4)) for _ in range(120)]
    documents(spark, texts, str(tmp_path))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op7_near_dedup(spark, str(tmp_path)).collect()}
    assert got == brute(texts, 3, 85, 100)


def thue_morse(n, a, b):
    text = a
    while len(text) < n:
        text += "".join(b if c == a else a for c in text)
    return text


def test_long_texts_and_words_that_collide_in_polynomials(spark, tmp_path):
    rng = random.Random(4)
    long = prose(rng, 30_000, 20_000)
    texts = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"), "x" * 9000, "x" * 9000 + "y", long, near(rng, long, 500), "q" * 9000 + " " + long]
    documents(spark, texts, str(tmp_path))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op7_near_dedup(spark, str(tmp_path)).collect()}
    assert got == brute(texts, 3, 85, 100) and [got[i][1] for i in range(4)] == [0, 1, 2, 3] and got[5][1] == 4


def test_further_links_rename_components(spark):
    known = components(spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21)], "u long, v long"))
    links = spark.createDataFrame([(3, 11), (30, 31), (11, 40)], "u long, v long")
    got = {r.node: r.component for r in renamed(known, links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 40: 1, 20: 20, 21: 20, 30: 30, 31: 30}
    none = spark.createDataFrame([], "u long, v long")
    assert components(none).collect() == [] and len(renamed(known, none).collect()) == 7


def test_stars_across_tasks(spark, monkeypatch):
    monkeypatch.setattr("logweave.llm.components.ROWS", 40)
    path = [(i, i + 1) for i in range(1, 300)]
    random.Random(1).shuffle(path)
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "u long, v long").repartition(12)).collect()}
    assert got == {i: 1 for i in range(1, 301)}


def test_components_of_paths_stars_and_pairs(spark):
    path = [(i, i + 1) for i in range(1, 70)]
    star = [(500, 500 + i) for i in range(1, 200)] + [(7000, 600)]
    df = spark.createDataFrame(path + star + [(9, 9), (9002, 9001)], "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got[i] == 1 for i in range(1, 71)) and got[7000] == 500 and got[699] == 500 and got[9002] == got[9001] == 9001


def test_edge_tables(spark):
    docs = documents(spark, ["a b c d e f"] * 4 + [None, "x"]).withColumns({"key": F.lit(1), "labels": F.lit(2)})
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {0: (0, True), 1: (0, False), 2: (0, False), 3: (0, False), 4: (4, True), 5: (5, True)}
    nulls = near_duplicates(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(nulls) == 6 and all(r.kept and r.component_id is None for r in nulls)
    assert near_duplicates(docs.where("false")).collect() == []


def test_pairs_far_apart_in_a_large_region(spark):
    rng = random.Random(8)
    passage = prose(rng, 70, 900)
    texts = [f"{passage} {prose(rng, 30, 90_000)}" for _ in range(1300)]
    texts += [t.rsplit(" ", 1)[0] + " another" for t in texts[:30]]
    marks = signatures(shingle_sets(pa.array(texts), 3), 2)
    region, sizes = np.unique(marks, axis=0, return_inverse=True, return_counts=True)[1:]
    large = [i for i in range(30) if region[i] == region[1300 + i] and sizes[region[i]] > 400]
    assert len(large) > 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, size=3, similarity=(85, 100), trees=1, labels=2).collect()}
    assert all(got[1300 + i] == i for i in large) and all(got[i] == i for i in range(1300))


def test_shared_prefixes_lose_no_similar_pair(monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 300)
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 64, 3000, np.uint64)
    sets = []
    for _ in range(60):
        base = rng.choice(pool[:200] if rng.random() < 0.5 else pool, rng.integers(1, 120))
        sets += [np.unique(np.append(rng.permutation(base)[rng.integers(0, 1 + len(base) // 8) :], rng.choice(pool, rng.integers(0, 4)))) for _ in range(8)]
    sets.append(np.zeros(0, np.uint64))
    of = rng.integers(0, 60, len(sets))
    table = np.sort(pool[:200])
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(sets)), pa.int64()), "shingles": pa.array([pack_sorted(s) for s in sets], pa.binary()), "of": pa.array(of)})
    for similarity in ((85, 100), (80, 100), (1, 1)):
        num, den = similarity
        rows = pa.Table.from_batches(near_dedup.prefixes(similarity, table, np.full(200, 9, np.uint8))([batch])).sort_by("token")
        for few, cells in ((32, 1 << 21), (2, 100)):
            got = set()
            for out in near_dedup.sharing_pairs(similarity, few, cells)(rows.to_batches(max_chunksize=100)):
                got |= set(zip(out.column("u").to_pylist(), out.column("v").to_pylist()))
            wanted = set()
            for a, b in itertools.combinations(range(len(sets)), 2):
                both = len(np.intersect1d(sets[a], sets[b]))
                if both and of[a] != of[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    wanted.add((b, a))
            assert wanted and wanted <= got and all(of[u] != of[v] for u, v in got) and len(got) < 40 * len(wanted)


def test_links_in_one_task_take_few_jobs(spark):
    # the driver's memory goes by jobs and their tasks
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 100)], "u long, v long")
    spark.sparkContext.setJobGroup("links in one task", "")
    found = components(links)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("links in one task"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 4 and {r.node: r.component for r in found.collect()} == {i: 1 for i in range(1, 101)}
