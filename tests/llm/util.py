"""Small tables and brute-force helpers shared by the tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, path=None, **more):
    rows = [(i if not isinstance(x, tuple) else x[0], x if not isinstance(x, tuple) else x[1], "en", f"src{i % 3}" if i % 7 else None, 0) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if path:
        df.repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return df


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=5, n=40):
    """Texts with exact copies, shared passages, repeats, odd white space, empty and null texts."""
    rng = random.Random(seed)
    shared = prose(rng, 60, 500)
    texts = [None, "", " \n\t ", "one", "ünï cødé 😀 two\x0bthree\x0c", "a " * 90, ("b" * 300)]
    for i in range(n):
        t = prose(rng, rng.randrange(1, 120), 400)
        if i % 4 == 0:
            t += rng.choice([" ", "\n", "  "]) + shared + " " + prose(rng, rng.randrange(30), 400)
        if i % 9 == 0:
            texts.append(t)
        texts.append(t)
    return texts
