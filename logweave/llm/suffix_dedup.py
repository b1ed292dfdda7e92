"""Substring deduplication by bytes: every byte in a 100-byte string that also starts earlier is removed.

Texts are dealt out in chunks by id; an order over all texts is never built.  Each chunk sorts the suffixes of what
may repeat (see suffix_array) and finds there what repeats inside it.  What repeats across chunks is found in three
steps, all of them lossless:

1. A window of `window` bytes is named by its anchor, the run of `anchor` bytes in it with the least hash, so equal
   windows have equal anchors.  Chunks send their distinct anchors; only those that occur twice matter from here.
2. Consecutive windows with one anchor are a block.  Chunks send (block, smallest id).  Wherever a block is not the
   first of its kind, all its windows start earlier as well.  Interiors of copies are settled by this.  Beside that
   they send (anchor, its block), or a mark where they know several, which tells whose anchors have several blocks.
3. Where an anchor has several blocks, as at the ends of copies, the first holder of each block sends its windows'
   hashes with ids, and learns which of them a smaller id holds too.

Buckets get sorted hashes of chunks, not rows of windows, and one entry for each chunk however often a string, a block
or an anchor occurs: an anchor with a block in every text meets its chunks in a task, not its blocks.
Inside a chunk matches are exact; across chunks they rest on 64-bit hashes.

Results by case: null and empty texts have nothing to remove; texts under `window` bytes lose nothing; rows without an
id come last; rows that share an id (or have none) are texts of their own, in order of chunk and text, so that identical
rows lose all but the first and no id fills a chunk; very long texts are worked on whole; bytes that are left need not
be valid UTF-8, so they are binary; an empty table gives an empty result; further columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, partitions, power_of_two, text_size
from .kernels import BASE, Powers, byte_prefix, covered, in_sorted, mix64, pack_sorted, runs, span_hashes, text_bytes, unpack_sorted
from .substring_dedup import by_bucket, count_bucket
from .suffix_array import repeats

LAST = np.iinfo(np.int64).max
BLOCK = 1 << 15  # places that are hashed at a time, so that what is worked on stays in a core's cache
SEVERAL = np.uint64(0)  # stands for two or more blocks; a block whose hash it is only sends its windows as well


def distinct(values):
    """Ascending distinct values; np.unique hashes them first, which takes several times as long."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def repeated(values):
    """Which values stand twice or more among them."""
    order = np.sort(values)
    return in_sorted(values, distinct(order[1:][order[1:] == order[:-1]]))


def least_places(prefix, powers, window, anchor):
    """For each window of the whole buffer the place of the run of `anchor` bytes in it with the least hash, and the
    hash of the run at each place; ties go to the leftmost place."""
    n, width = len(prefix) - window, window - anchor + 1  # windows; runs in each
    bits = np.uint64(max(1, (len(prefix) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    down, extra = powers.upto(len(prefix))[1], np.uint64(anchor * BASE % (1 << 64))
    hashes, places = np.empty(n + width - 1, np.uint64), np.empty(n, np.int64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK) + width - 1
        raw = prefix[lo + anchor : hi + anchor] - prefix[lo:hi]
        raw *= down[lo:hi]
        raw += extra
        hashes[lo:hi] = raw = mix64(raw)
        least = (raw & ~low) | np.arange(lo, hi, dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: reach - width], least[width - reach :])
        places[lo : hi - width + 1] = least & low
    return places, hashes


class Chunk:
    """A chunk's texts in order, its windows and the blocks that they form."""

    def __init__(self, rows, window, anchor):
        self.rows = rows = rows.sort_by([("key", "ascending"), ("text", "ascending")]).combine_chunks()
        self.buf, self.off = buf, off = text_bytes(rows.column("text"))
        self.ids = rows.column("key").fill_null(LAST).to_numpy()
        self.window, n = window, np.diff(off)
        counts = np.maximum(n - window + 1, 0)
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), counts)
        edge = np.zeros(len(buf) + 1, np.int8)
        begin = off[:-1][counts > 0]
        edge[begin] = 1
        edge[begin + counts[counts > 0]] = -1
        inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        self.starts = np.flatnonzero(inside)
        self.powers = Powers()
        self.prefix = byte_prefix(buf, self.powers)
        if not len(self.starts):
            self.first = self.last = np.zeros(0, np.int64)
            self.anchors = self.blocks = np.zeros(0, np.uint64)
            return
        place, hashes = least_places(self.prefix, self.powers, window, anchor)
        place = place[inside[: len(place)]]
        fresh = np.append(True, place[1:] != place[:-1])
        fresh[(np.cumsum(counts) - counts)[counts > 0]] = True
        edge = np.flatnonzero(fresh)
        self.first, self.last = edge, np.append(edge[1:], len(place)) - 1  # numbers of each block's windows
        self.anchors = mix64(hashes[place[edge]])  # least hashes are all small; mixed one to one, they fill all buckets
        self.blocks = span_hashes(self.prefix, self.starts[self.first], self.starts[self.last] + window, self.powers)

    def windows_of(self, mask):
        """Numbers of the windows in the blocks of a mask."""
        size = (self.last - self.first + 1)[mask]
        return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[mask], size)

    def window_hashes(self, numbers):
        at = self.starts[numbers]
        return span_hashes(self.prefix, at, at + self.window, self.powers)

    def open_blocks(self, answers):
        """Which blocks are the first of their kind and share their anchor with others."""
        return in_sorted(self.anchors, told(answers, "shared")) & ~in_sorted(self.blocks, told(answers, "later"))

    def local_repeats(self):
        """Numbers of the windows that also start earlier in this chunk, from the suffixes of blocks whose anchor
        occurs twice in it."""
        able = np.zeros(len(self.starts), bool)
        able[self.windows_of(repeated(self.anchors))] = True
        # texts of runs of such windows, each closed by a byte that UTF-8 never has
        a, b = runs(able)
        cut = np.unique(np.concatenate((a, b, np.flatnonzero(np.diff(self.doc)) + 1)))
        a = cut[np.append(able, False)[cut]]
        if not len(a):
            return a
        b = np.minimum(np.append(cut, len(able))[np.searchsorted(cut, a, "right")], len(able))
        low, size = self.starts[a], b - a + self.window - 1
        begin = np.cumsum(size + 1) - size - 1
        s = np.full(begin[-1] + size[-1] + 2, 255, np.int64)
        number = np.full(len(s), -1, np.int64)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        s[inside + np.repeat(begin, size)] = self.buf[inside + np.repeat(low, size)].astype(np.int64) + 1
        s[-1] = 0
        inside = np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        number[inside + np.repeat(begin, b - a)] = inside + np.repeat(a, b - a)
        found = number[repeats(s, self.window)]
        return found[found >= 0]


def send_anchors(window, anchor, bits):
    return lambda key, rows: by_bucket(key[0].as_py(), distinct(Chunk(rows, window, anchor).anchors), bits)


def told(answers, kind):
    blobs = [unpack_sorted(h.as_py()) for h, k in zip(answers.column("hashes"), answers.column("kind")) if k.as_py() == kind]
    return distinct(np.concatenate(blobs)) if blobs else np.zeros(0, np.uint64)


def entries_by_bucket(chunk, hashes, values, bits, above=0):
    """Rows (bucket, chunk, hashes, values) for hashes in ascending order; buckets are numbered from `above`."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) + above
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    cut = lambda x: np.split(x, at[1:]) if len(x) else []
    raw = lambda x: pa.array([np.ascontiguousarray(p.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for p in cut(x.view(np.int64))], pa.binary())
    return pa.table({"bucket": bucket[at], "chunk": np.full(len(at), chunk, np.int64), "hashes": pa.array([pack_sorted(p) for p in cut(hashes)], pa.binary()), "values": raw(values)})


def planes(blob):
    """Numbers that were sent as planes of bytes, which compress."""
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def send_blocks(window, anchor, bits):
    def send(key, rows, answers):
        c = Chunk(rows, window, anchor)
        elsewhere = told(answers, "a")
        some = np.flatnonzero(in_sorted(c.anchors, elsewhere) | repeated(c.anchors))
        # the first of each block in the chunk's order, which is that of ids
        order = some[np.lexsort((some, c.blocks[some]))]
        order = order[np.diff(c.blocks[order], prepend=~c.blocks[order[:1]]) != 0]
        firsts = entries_by_bucket(key[0].as_py(), c.blocks[order], c.ids[c.doc[c.first[order]]], bits)
        # each anchor with its block, or SEVERAL
        order = order[np.lexsort((c.blocks[order], c.anchors[order]))]
        head = np.flatnonzero(np.diff(c.anchors[order], prepend=~c.anchors[order[:1]]) != 0)
        single = np.diff(np.append(head, len(order))) == 1
        only = np.where(single, c.blocks[order][head], SEVERAL)
        return pa.concat_tables([firsts, entries_by_bucket(key[0].as_py(), c.anchors[order][head], only, bits, 1 << bits)])

    return send


def gathered(rows):
    """(chunks, numbers of the chunks by entry, hashes, values) of the rows of a bucket."""
    lists = [unpack_sorted(x.as_py()) for x in rows.column("hashes")]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values = np.concatenate([np.zeros(0, np.int64), *(planes(x.as_py()) for x in rows.column("values"))])
    return rows.column("chunk").to_numpy(), owner, np.concatenate([np.zeros(0, np.uint64), *lists]), values


def answered(chunks, owner, values, kind):
    """Rows (chunk, kind, hashes) from values and the numbers of the chunks that they go to."""
    order = np.lexsort((values, owner))
    who, at = np.unique(owner[order], return_index=True)
    blobs = [pack_sorted(distinct(x)) for x in np.split(values[order], at[1:])] if len(who) else []
    return pa.table({"chunk": chunks[who].astype(np.int64), "kind": pa.array([kind] * len(who), pa.string()), "hashes": pa.array(blobs, pa.binary())})


def not_first(chunks, owner, hashes, ids):
    """(owner, hash) of the entries that are not the first of their hash by id, then by chunk."""
    order = np.lexsort((chunks[owner], ids, hashes))
    owner, hashes = owner[order], hashes[order]
    later = np.zeros(len(order), bool)
    later[1:] = hashes[1:] == hashes[:-1]
    return owner[later], hashes[later]


def judge_blocks(bits):
    def judge(key, rows):
        """Tells chunks which blocks are not the first of their kind; in the upper buckets, which anchors have several."""
        chunks, owner, hashes, values = gathered(rows)
        if key[0].as_py() < 1 << bits:
            return answered(chunks, *not_first(chunks, owner, hashes, values), "later")
        order = np.lexsort((values, hashes))
        owner, hashes, values = owner[order], hashes[order], values.view(np.uint64)[order]
        head = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]) != 0)
        end = np.append(head[1:], len(hashes)) - 1
        many = (values[head] != values[end]) | (values[head] == SEVERAL)  # SEVERAL is the least value
        many = np.repeat(many, end - head + 1)
        return answered(chunks, owner[many], hashes[many], "shared")

    return judge


def send_windows(window, anchor, bits):
    def send(key, rows, answers):
        c = Chunk(rows, window, anchor)
        numbers = c.windows_of(c.open_blocks(answers))
        hashes, at = np.unique(c.window_hashes(numbers), return_index=True)
        ids = c.ids[c.doc[numbers[at]]]
        return entries_by_bucket(key[0].as_py(), hashes, ids, bits)

    return send


def judge_windows(key, rows):
    """Tells chunks which of their windows a smaller id holds in another chunk."""
    chunks, owner, hashes, ids = gathered(rows)
    return answered(chunks, *not_first(chunks, owner, hashes, ids), "window")


def remove(window, anchor):
    def run(key, rows, answers):
        c = Chunk(rows, window, anchor)
        gone = np.zeros(len(c.starts), bool)
        gone[c.windows_of(in_sorted(c.blocks, told(answers, "later")))] = True
        shared = c.windows_of(c.open_blocks(answers))
        gone[shared[in_sorted(c.window_hashes(shared), told(answers, "window"))]] = True
        gone[c.local_repeats()] = True
        cover = covered(c.starts[gone], window, len(c.buf))
        total = np.concatenate(([0], np.cumsum(cover)))
        a, b = runs(cover)
        cut = np.unique(np.concatenate((a, b, c.off)))
        a, b = cut[:-1], cut[1:]
        real = cover[a] if len(cover) else np.zeros(0, bool)
        a, b = a[real], b[real]
        left, kept = c.buf[~cover].tobytes(), c.off - total[c.off]
        at = np.searchsorted(a, c.off)
        spans = [[{"start": int(x - o), "end": int(y - o)} for x, y in zip(a[i:j], b[i:j])] for o, i, j in zip(c.off[:-1], at[:-1], at[1:])]
        return pa.table({
            "key": c.rows.column("key"), "n_bytes": np.diff(c.off), "n_removed": total[c.off[1:]] - total[c.off[:-1]],
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_bytes": pa.array([left[x:y] for x, y in zip(kept[:-1], kept[1:])], pa.binary())})

    return run


def dedup_suffixes(docs: DataFrame, window: int = 100, anchor: int = 76, key: str = "doc_id", text: str = "text", chunk_bytes: int = 1 << 20) -> DataFrame:
    """(key, n_bytes, n_removed, removed, kept_bytes) for each row of docs; the key is an integer.

    removed: maximal intervals of removed bytes, end exclusive.  kept_bytes: the other bytes.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    size = text_size(docs, text)
    bits = max(4, (power_of_two(size / (16 << 20)) - 1).bit_length())
    chunks = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chunks = chunks.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(max(8, size // chunk_bytes + 1)))).repartition(partitions(spark), "chunk")
    by_chunk = lambda answers: chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    entry = "bucket long, chunk long, hashes binary, values binary"
    answer = "chunk long, kind string, hashes binary"

    anchors = chunks.groupBy("chunk").applyInArrow(send_anchors(window, anchor, bits), "bucket long, chunk long, hashes binary")
    twice = anchors.groupBy("bucket").applyInArrow(count_bucket(bits), "chunk long, hashes binary").select("chunk", F.lit("a").alias("kind"), "hashes")
    blocks = by_chunk(twice).applyInArrow(send_blocks(window, anchor, bits), entry)
    judged = blocks.groupBy("bucket").applyInArrow(judge_blocks(bits), answer)
    windows = by_chunk(judged).applyInArrow(send_windows(window, anchor, bits), entry)
    later = windows.groupBy("bucket").applyInArrow(judge_windows, answer)
    done = by_chunk(judged.unionByName(later)).applyInArrow(remove(window, anchor), "key long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept_bytes binary")
    return done.withColumnRenamed("key", key)


def op8_suffix_dedup(spark, sf_dir):
    out = dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
