"""Substring deduplication by word windows.

Every window of `window` words gets a Rabin-Karp hash; Spark counts the hashes; windows found twice or more
merge into maximal intervals, which are removed.

Texts are dealt out in chunks of about 1 MB.  A chunk hashes all its windows, and sends its distinct hashes,
sorted and as differences, to buckets by leading bits: a window that a third of the documents share crosses the
network once for each chunk.  A bucket answers each chunk with those hashes that other chunks hold as well; what
repeats inside a chunk is seen there.  The exchange that deals out texts serves both passes.

Hashes have 64 bits after a final mixing, so with N windows a window is removed wrongly with probability N / 2**64.

Results by case: null and empty texts have no words; texts under `window` words lose none; repeated rows are
separate documents, so each is a copy of the other and both lose the shared windows; a null id is kept as it is;
an empty table gives an empty result; further columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, chunked, power_of_two, text_size
from .kernels import (Powers, covered, in_sorted, pack_sorted, runs, slices, span_codes, text_bytes,
                      unpack_sorted, window_hashes, words)

RESULT = "key {kind}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"


def hash_windows(buf, off, window, powers):
    starts, ends, first = words(buf, off)
    codes = span_codes(buf, starts, ends)
    return starts, ends, first, *window_hashes(codes, first, window, powers)


def by_bucket(chunk, hashes, bits):
    """Rows (bucket, chunk, hashes) for ascending distinct hashes."""
    low = np.uint64((1 << (64 - bits)) - 1)
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    blobs = [pack_sorted(x & low) for x in np.split(hashes, at[1:])] if len(hashes) else []
    return pa.table({"bucket": bucket[at], "chunk": np.full(len(at), chunk, np.int64), "hashes": pa.array(blobs, pa.binary())})


def chunk_windows(window, bits):
    def send(key, rows):
        powers, found = Powers(), []
        for part in slices(rows, "text"):
            found.append(np.unique(hash_windows(*text_bytes(part.column("text")), window, powers)[-1]))
        return by_bucket(key[0].as_py(), np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64), bits)

    return send


def count_bucket(bits):
    """Tells each chunk which of its hashes stand in another chunk too."""

    def count(key, rows):
        chunks = rows.column("chunk").to_numpy()
        lists = [unpack_sorted(x.as_py()) for x in rows.column("hashes")]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        hashes = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        same = hashes[1:] == hashes[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(hashes) else np.zeros(0, bool)
        hashes, owner = hashes[shared], owner[shared]
        order = np.argsort(owner, kind="stable")
        who, at = np.unique(owner[order], return_index=True)
        high = np.uint64(key[0].as_py() << (64 - bits) if bits else 0)
        blobs = [pack_sorted(x | high) for x in np.split(hashes[order], at[1:])] if len(who) else []
        return pa.table({"chunk": chunks[who], "hashes": pa.array(blobs, pa.binary())})

    return count


def remove_repeats(window, kind):
    def remove(key, rows, answers):
        powers = Powers()
        told = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(x.as_py()) for x in answers.column("hashes"))]))
        parts = list(slices(rows, "text"))
        own = [np.zeros(0, np.uint64)]
        for part in parts:
            own.append(hash_windows(*text_bytes(part.column("text")), window, powers)[-1])
        own, times = np.unique(np.concatenate(own), return_counts=True)
        repeated = np.union1d(told, own[times > 1])
        out = []
        for part in parts:
            buf, off = text_bytes(part.column("text"))
            starts, ends, first, at, hashes = hash_windows(buf, off, window, powers)
            gone = covered(at[in_sorted(hashes, repeated)], window, len(starts))
            total = np.concatenate(([0], np.cumsum(gone)))
            keep = np.zeros(len(buf) + 1, np.int8)
            np.add.at(keep, starts[~gone], 1)
            np.add.at(keep, ends[~gone], -1)
            keep = np.cumsum(keep[:-1], dtype=np.int8) > 0
            # the separator behind a kept word, unless its document ends there
            after = ends[~gone]
            bound = np.repeat(off[1:], np.diff(first))[~gone]
            keep[after[after < bound]] = True
            clean = buf.copy()
            clean[after[after < bound]] = 32
            size = np.concatenate(([0], np.cumsum(keep)))[off]
            clean = clean[keep].tobytes()
            texts = [clean[a:b].rstrip(b" ") for a, b in zip(size[:-1], size[1:])]
            spans = []
            a, b = runs(gone)
            # a run of removed words never crosses a document
            cut = np.unique(np.concatenate((first, a, b)))
            a, b = cut[:-1], cut[1:]
            real = gone[a] if len(gone) else np.zeros(0, bool)
            a, b = a[real], b[real]
            for lo, hi in zip(first[:-1], first[1:]):
                i, j = np.searchsorted(a, lo), np.searchsorted(a, hi)
                spans.append([{"start": int(x - lo), "end": int(y - lo)} for x, y in zip(a[i:j], b[i:j])])
            out.append(pa.table({
                "key": part.column("key"), "n_words": np.diff(first), "n_removed": total[first[1:]] - total[first[:-1]],
                "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
            }))
        return pa.concat_tables(out) if out else pa.table({
            "key": rows.column("key").slice(0, 0), "n_words": np.zeros(0, np.int64), "n_removed": np.zeros(0, np.int64),
            "removed": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_text": pa.array([], pa.string())})

    return remove


def dedup_substrings(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, removed, kept_text) for each row of docs.

    removed: maximal intervals of removed words, as word numbers, end exclusive.  kept_text: the other words,
    one space between them.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    size = text_size(docs, text)
    bits = max(4, (power_of_two(size / (4 << 20)) - 1).bit_length())
    chunks = chunked(docs, key, text, size)
    kind = dict(chunks.dtypes)["key"]
    sent = chunks.groupBy("chunk").applyInArrow(chunk_windows(window, bits), "bucket long, chunk long, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(count_bucket(bits), "chunk long, hashes binary")
    done = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(remove_repeats(window, kind), RESULT.format(kind=kind))
    return done.withColumnRenamed("key", key)


def op2_substring_dedup(spark, sf_dir):
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
