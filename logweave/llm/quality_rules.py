"""Quality rules: exact text statistics and the perplexity of a language model counted by Spark.

The model is an interpolated modified Kneser-Ney model of `order` bytes, one for each language, without classes or a
vocabulary: it has as many entries as the corpus has distinct n-grams.  They are sorted arrays of n-gram numbers with
counts, cut into shards by the two bytes before the last, so that an entry's lower orders down to three stand in its
shard; orders two and one are at most 65,536 numbers a language.

Documents are gathered in chunks of one language.  A chunk sends its distinct n-grams and counts to the shards; there
they are summed in steps of bounded width, and the log probabilities of a chunk's n-grams go back to it.  So neither
models nor documents are broadcast or held in one task, however many languages there are.

A document is scored as if each n-gram at hand had not been counted (leave one out), for the model has read it as well:
an n-gram met once falls back to lower orders.  Its verdict compares its log perplexity for each word with its
language's documents: the bands are the quartiles of all documents that pass the base rules, widened downwards by
`below` and upwards by `above` times the distance between them.  Odd characters lengthen words as well as surprising
the model, so that the sum over a word tells more than the mean over characters.

Results by case: null and empty texts have no words and fail the base rules; a null language is a language of its
own; a language whose documents all fail has no bands and rejects nothing more; repeated rows are scored alike; ties
with a band's end are kept; a very long text is scored in pieces, as a whole; a null id is kept; an empty table gives
an empty result; further columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, checkpointed, partitions, power_of_two, text_size
from .kernels import Powers, covered, give_back, mix64, pack_sorted, slices, span_codes, text_bytes, unpack_sorted, window_hashes, words

CHUNK_BYTES = 2 << 20  # of one language's text that is scored together
FAN_IN = 128  # chunks, or sums of them, that are summed together
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


# --- chunks ---------------------------------------------------------------------------------------------------------


def write_table(table):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def read_tables(blobs):
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])


def gather_chunks(batches):
    """Rows (language, chunk, docs): documents of one language in runs of about CHUNK_BYTES."""
    part, held = TaskContext.get().partitionId(), {}

    def send(language):
        docs = write_table(pa.Table.from_batches(held.pop(language)[1]).combine_chunks())
        # by content as well: a task that is run again with other rows makes other chunks, and old answers find none
        name = int.from_bytes(hashlib.blake2b(docs, digest_size=8, key=part.to_bytes(8, "big")).digest(), "big", signed=True)
        return pa.RecordBatch.from_pydict({"language": pa.array([language], pa.string()), "chunk": pa.array([name], pa.int64()), "docs": pa.array([docs], pa.binary())})

    for batch in batches:
        for language in batch.column("language").unique().to_pylist():
            own = batch.filter(pc.equal(batch.column("language"), language)).select(["key", "text"])
            for docs in slices(own, "text", CHUNK_BYTES):
                size, parts = held.setdefault(language, [0, []])
                parts.append(docs)
                held[language][0] = size + len(text_bytes(docs.column("text"))[0])
                if held[language][0] >= CHUNK_BYTES:
                    yield send(language)
        while sum(size for size, _ in held.values()) > 8 * CHUNK_BYTES:
            yield send(max(held, key=lambda name: held[name][0]))
    for language in list(held):
        yield send(language)


def pieces(buf, off, order, limit=1 << 20):
    """(n-gram numbers, document of each): one for each byte, with zeros before a document."""
    doc_of = lambda a, b: np.searchsorted(off, np.arange(a, b), "right") - 1
    for a in range(0, len(buf), limit):
        b = min(a + limit, len(buf))
        doc = doc_of(a, b)
        at, begin = np.arange(a, b), off[doc]
        number = np.zeros(b - a, np.uint64)
        for k in range(order - 1, -1, -1):
            byte = buf[np.maximum(at - k, 0)].astype(np.uint64)
            byte[at - k < begin] = 0
            number = (number << np.uint64(8)) | byte
        yield number, doc


def distinct_numbers(buf, off, order):
    """Ascending distinct n-gram numbers and their counts."""
    found = [np.unique(number, return_counts=True) for number, _ in pieces(buf, off, order)]
    return summed(*(np.concatenate([np.zeros(0, kind), *(f[i] for f in found)]) for i, kind in ((0, np.uint64), (1, np.int64))))


def summed(numbers, counts):
    keys, which = np.unique(numbers, return_inverse=True)
    return keys, np.bincount(which, counts, len(keys)).astype(np.int64)


def shard_of(numbers, shards):
    """By the two bytes before the last."""
    return (mix64((numbers >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64)


def send_numbers(order, shards):
    """Rows (language, shard, chunk, numbers, counts) of each chunk."""

    def run(batches):
        for batch in batches:
            for language, chunk, docs in zip(*(batch.column(c).to_pylist() for c in ("language", "chunk", "docs"))):
                keys, counts = distinct_numbers(*text_bytes(read_tables([docs]).column("text")), order)
                shard = shard_of(keys, shards)
                some = [(s, np.flatnonzero(shard == s)) for s in np.unique(shard).tolist()]
                yield pa.RecordBatch.from_pydict({
                    "language": pa.array([language] * len(some), pa.string()), "shard": pa.array([s for s, _ in some], pa.int64()), "chunk": pa.array([chunk] * len(some), pa.int64()),
                    "numbers": pa.array([pack_sorted(keys[i]) for _, i in some], pa.binary()), "counts": pa.array([counts[i].astype("<i8").tobytes() for _, i in some], pa.binary())})
        give_back()

    return run


# --- the model ------------------------------------------------------------------------------------------------------


def sum_rows(key, rows):
    """One row (language, shard, fold, numbers, counts) from several."""
    numbers, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for blob, own in zip(rows.column("numbers"), rows.column("counts")):
        numbers = np.concatenate((numbers, unpack_sorted(blob.as_py())))
        counts = np.concatenate((counts, np.frombuffer(own.as_py(), "<i8")))
        if len(numbers) > 4_000_000:
            numbers, counts = summed(numbers, counts)
    numbers, counts = summed(numbers, counts)
    return pa.table({"language": pa.array([key[0].as_py()], pa.string()), "shard": [key[1].as_py()], "fold": [key[2].as_py()],
                     "numbers": pa.array([pack_sorted(numbers)], pa.binary()), "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary())})


def lower_types(numbers, counts, order):
    """From the highest order down to three: (number, count, place of each entry's suffix in the next order).

    A lower order counts the distinct longer n-grams that end with it.
    """
    out, keys, times = [], numbers, counts
    for n in range(order, 2, -1):
        suffix, which, more = np.unique(keys & np.uint64((1 << (8 * (n - 1))) - 1), return_inverse=True, return_counts=True)
        out.append((keys, times, which))
        keys, times = suffix, more
    return out, keys, times  # the last ones are of order two


def count_of_counts(counts):
    return [int((counts == i).sum()) for i in range(1, 5)]


def discounts(n):
    """D1, D2 and D3+ of modified Kneser-Ney, from the counts of counts."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else y for i in range(3)]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def tell_shards(order):
    """Rows (language, tallies, pairs, types): counts of counts of each order above two, and the types of order two."""

    def run(batches):
        for batch in batches:
            for language, numbers, counts in zip(*(batch.column(c).to_pylist() for c in ("language", "numbers", "counts"))):
                levels, pairs, types = lower_types(unpack_sorted(numbers), np.frombuffer(counts, "<i8"), order)
                tallies = [n for _, times, _ in levels for n in count_of_counts(times)]
                yield pa.RecordBatch.from_pydict({
                    "language": pa.array([language], pa.string()), "tallies": pa.array([tallies], pa.list_(pa.int64())),
                    "pairs": pa.array([pairs.astype("<i4").tobytes()], pa.binary()), "types": pa.array([types.astype("<i8").tobytes()], pa.binary())})

    return run


def smoothed(counts, lower, d):
    """Interpolated probabilities along the last axis; lower: those of the shorter context."""
    off = np.select([counts == 0, counts == 1, counts == 2], [0.0, d[0], d[1]], d[2])
    total = counts.sum(axis=-1, keepdims=True)
    safe = np.maximum(total, 1)
    return np.where(total > 0, (counts - off) / safe + off.sum(axis=-1, keepdims=True) / safe * lower, lower)


def language_base(key, rows):
    """One row (language, discounts, base): D1 to D3+ of each order above two, and the probabilities of order two."""
    tallies = np.array(rows.column("tallies").to_pylist()).sum(axis=0)
    c2 = np.zeros(1 << 16)
    for pairs, types in zip(rows.column("pairs").to_pylist(), rows.column("types").to_pylist()):
        np.add.at(c2, np.frombuffer(pairs, "<i4"), np.frombuffer(types, "<i8"))
    c2 = c2.reshape(256, 256)
    c1 = (c2 > 0).sum(axis=0).astype(float)
    p1 = smoothed(c1, np.full(256, 1 / 256), discounts(count_of_counts(c1)))
    p2 = smoothed(c2, p1[None, :], discounts(count_of_counts(c2)))
    own = [d for i in range(0, len(tallies), 4) for d in discounts(tallies[i : i + 4].tolist())]
    return pa.table({"language": pa.array([key[0].as_py()], pa.string()), "discounts": pa.array([own], pa.list_(pa.float64())), "base": pa.array([p2.astype("<f4").tobytes()], pa.binary())})


def one_order(numbers, counts, lower, lower_without, d):
    """Probabilities of an order's entries, and those without the one occurrence (or type) that stands in the text."""
    _, context = np.unique(numbers >> np.uint64(8), return_inverse=True)
    amount = np.array([0.0, *d])
    kind = np.minimum(counts, 3)
    mass, total = np.bincount(context, amount[kind]), np.bincount(context, counts)
    full = (counts - amount[kind] + mass[context] * lower) / total[context]
    left, rest = counts - 1, total[context] - 1
    new_kind = np.minimum(left, 3)
    new_mass = mass[context] - amount[kind] + amount[new_kind]
    below = np.where(counts == 1, lower_without, lower)
    without = np.where(rest > 0, (np.maximum(left - amount[new_kind], 0) + new_mass * below) / np.maximum(rest, 1), below)
    return full, without


def log_probabilities(numbers, counts, order, d, base):
    """Log probability of each entry of a shard, the occurrence at hand left out."""
    levels, pairs, _ = lower_types(numbers, counts, order)
    lower = without = base[pairs.astype(np.int64)].astype(float)
    for i in range(len(levels) - 1, -1, -1):
        keys, times, which = levels[i]
        lower, without = one_order(keys, times, lower[which], without[which], d[3 * i : 3 * i + 3])
    return np.log(np.maximum(without, 1e-12))


def fit_shards(order):
    """Rows (language, shard, numbers, logs) from those of counts with the base of their language."""

    def run(batches):
        for batch in batches:
            for language, shard, numbers, counts, d, base in zip(*(batch.column(c).to_pylist() for c in ("language", "shard", "numbers", "counts", "discounts", "base"))):
                logs = log_probabilities(unpack_sorted(numbers), np.frombuffer(counts, "<i8"), order, d, np.frombuffer(base, "<f4"))
                yield pa.RecordBatch.from_pydict({"language": pa.array([language], pa.string()), "shard": pa.array([shard], pa.int64()), "numbers": pa.array([numbers], pa.binary()), "logs": pa.array([logs.astype("<f2").tobytes()], pa.binary())})

    return run


def answer(key, asked, model):
    """Rows (language, chunk, shard, logs): of each chunk's numbers in their order."""
    if not model.num_rows or not asked.num_rows:
        return pa.table({"language": pa.array([], pa.string()), "chunk": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "logs": pa.array([], pa.binary())})
    keys, logs = unpack_sorted(model.column("numbers")[0].as_py()), np.frombuffer(model.column("logs")[0].as_py(), "<f2")
    out = [logs[np.searchsorted(keys, unpack_sorted(b.as_py()))].tobytes() for b in asked.column("numbers")]
    return pa.table({"language": asked.column("language"), "chunk": asked.column("chunk"), "shard": asked.column("shard"), "logs": pa.array(out, pa.binary())})


# --- documents ------------------------------------------------------------------------------------------------------


def statistics(buf, off, window=8):
    """Per document: words, word characters, symbols, repeated lines, words in repeated windows."""
    powers, n = Powers(), len(off) - 1
    starts, ends, first = words(buf, off)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[off])
    solid = np.ones(256, bool)
    solid[[9, 10, 11, 12, 13, 32]] = False
    solid[128:192] = False
    breaks = np.flatnonzero(buf == 10)
    lines = np.sort(np.concatenate((off[:-1], breaks + 1)))
    stops = np.sort(np.concatenate((breaks, off[1:])))
    of = np.repeat(np.arange(n), total(buf == 10) + 1)
    worded = np.searchsorted(starts, lines) < np.searchsorted(starts, stops)
    marks = mix64(span_codes(buf, lines[worded], stops[worded]) + of[worded].astype(np.uint64))
    _, at = np.unique(marks, return_index=True)
    repeated = np.bincount(of[worded], minlength=n) - np.bincount(of[worded][at], minlength=n)
    at, marks = window_hashes(span_codes(buf, starts, ends), first, window, powers)
    of = np.repeat(np.arange(n), np.diff(first))
    _, inverse, times = np.unique(mix64(marks + of[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    inside = np.concatenate(([0], np.cumsum(covered(at[times[inverse] > 1], window, len(starts)))))
    return {"n_words": np.diff(first), "word_chars": total(solid[buf]), "n_symbols": total(SYMBOLS[buf]), "n_dup_lines": repeated, "n_repeat_words": inside[first[1:]] - inside[first[:-1]]}


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored_schema(key):
    return pa.schema([("key", key), ("model", pa.string()), *((k, pa.int64()) for k in STATISTICS), ("log_perplexity", pa.float64())])


def score_chunk(order, shards):
    """The documents of a chunk with their statistics and log perplexity."""

    def run(key, rows, answers):
        docs = read_tables(rows.column("docs").to_pylist()).combine_chunks()
        buf, off = text_bytes(docs.column("text"))
        keys, _ = distinct_numbers(buf, off, order)
        shard, logs = shard_of(keys, shards), np.zeros(len(keys), np.float32)
        got = dict(zip(answers.column("shard").to_pylist(), answers.column("logs").to_pylist()))
        for s in np.unique(shard).tolist():
            logs[shard == s] = np.frombuffer(got[s], "<f2")
        sums = np.zeros(len(off) - 1)
        for number, doc in pieces(buf, off, order):
            low = doc[0]
            part = np.bincount(doc - low, logs[np.searchsorted(keys, number)])
            sums[low : low + len(part)] += part
        out = []
        for at in slices(docs.to_batches()[0], "text"):
            out.append(statistics(*text_bytes(at.column("text"))))
        stats = {k: np.concatenate([o[k] for o in out]).astype(np.int64) for k in STATISTICS}
        name = pa.array([key[0].as_py()] * len(sums), pa.string())
        columns = [docs.column("key").combine_chunks(), name, *(pa.array(stats[k]) for k in STATISTICS), pa.array(-sums / np.maximum(stats["n_words"], 1))]
        give_back()
        return pa.Table.from_arrays(columns, schema=scored_schema(columns[0].type))

    return run


def score_documents(rows, order, size):
    """(key, model, statistics, log_perplexity) of rows (key, language, text) with `size` bytes of text."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["key"]
    # an entry of a shard is a few bytes; the number of distinct n-grams grows far more slowly than the text
    shards = min(1024, max(4, power_of_two(size / (64 << 20))))
    folds = max(1, -(-size // (CHUNK_BYTES * FAN_IN)))
    chunks = rows.mapInArrow(gather_chunks, "language string, chunk long, docs binary").repartition(partitions(spark), "language", "chunk")
    asked = chunks.mapInArrow(send_numbers(order, shards), "language string, shard long, chunk long, numbers binary, counts binary")
    asked = asked.withColumn("fold", F.pmod("chunk", F.lit(folds)))
    sums, left = asked, folds
    while True:
        sums = sums.groupBy("language", "shard", "fold").applyInArrow(sum_rows, "language string, shard long, fold long, numbers binary, counts binary")
        if left == 1:
            break
        left = -(-left // FAN_IN)
        sums = sums.withColumn("fold", F.pmod("fold", F.lit(left)))
    sums = checkpointed(sums.drop("fold"))
    told = sums.mapInArrow(tell_shards(order), "language string, tallies array<long>, pairs binary, types binary")
    base = told.groupBy("language").applyInArrow(language_base, "language string, discounts array<double>, base binary")
    model = sums.join(base, "language").mapInArrow(fit_shards(order), "language string, shard long, numbers binary, logs binary")
    model = checkpointed(model).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
    by = ("language", "shard", "fold")
    answers = asked.groupBy(*by).cogroup(model.groupBy(*by)).applyInArrow(answer, "language string, chunk long, shard long, logs binary")
    schema = f"key {kind}, model string, {', '.join(k + ' long' for k in STATISTICS)}, log_perplexity double"
    return chunks.groupBy("language", "chunk").cogroup(answers.groupBy("language", "chunk")).applyInArrow(score_chunk(order, shards), schema)


def assess(docs: DataFrame, below=3.0, above=5.0, least_words=20, most_repeated=30, order=5, most_broadcast=10_000, key="doc_id", language="lang", text="text") -> DataFrame:
    """Statistics, log_perplexity, its language's band (low, high), base_failed and kept for each row of docs.

    order: bytes of an n-gram, 3 to 7.  most_broadcast: as many languages' bands, two numbers each, are broadcast.
    """
    arrow_batches(docs.sparkSession)
    name = F.coalesce(F.concat(F.lit("s"), F.col(language).cast("string")), F.lit("n"))
    rows = docs.select(F.col(key).alias("key"), name.alias("language"), F.col(text).cast("string").alias("text"))
    base_failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    scored = checkpointed(score_documents(rows, order, text_size(docs, text)).withColumn("base_failed", base_failed))
    bands = scored.where("not base_failed").groupBy("model").agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 1000).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    bands = checkpointed(bands.select("model", (low - below * (high - low)).alias("low"), (high + above * (high - low)).alias("high")))
    # more languages than that meet their documents by a join that may split the frequent ones
    out = scored.join(F.broadcast(bands) if bands.count() <= most_broadcast else bands, "model", "left")
    fits = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & fits).drop("model").withColumnRenamed("key", key)


def op4_quality_rules(spark, sf_dir):
    out = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
