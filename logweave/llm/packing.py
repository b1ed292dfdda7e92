"""Packing token streams into fixed-length sequences by first-fit decreasing.

Documents are tokenised where they are read; a document longer than a sequence is cut into full sequences and a
remainder.  Remainders are packed in randomised groups of about `group_rows` documents, apart from each other:
longest first, each into the leftmost open sequence with room, found by a tournament tree over the sequences'
free space.  Only lengths and check sums are shuffled, never texts or ids.

Words are cut where the tokenizer's own rules cut for certain, and a task tokenises each distinct part once; the ids
are gathered from there, which changes none of them: no rule looks across those places.

Results by case: null and empty texts are the end id alone; repeated rows are separate documents (their pieces are
alike but lie in different places); a null id is kept; an empty table gives an empty result.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .kernels import IS_SPACE, LOWER, give_back, in_sorted, slices, span_codes, text_bytes, words, worker_state

def tokenizer_path(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_kinds():
    """0 white space, 1 ASCII letter, 2 digit, 3 other ASCII, 4 the rest."""
    out = np.full(256, 3, np.int8)
    out[IS_SPACE] = 0
    out[65:91] = out[97:123] = 1
    out[48:58] = 2
    out[128:] = 4
    return out


KIND = byte_kinds()
WHOLE = np.zeros(256, bool)
WHOLE[[39, 60]] = True  # an apostrophe may begin an ending, a smaller-than sign a special token


def units(buf, off):
    """(bytes in lower case, starts, ends, first unit of each document): parts of words that are tokenised apart.

    The tokenizer cuts between ASCII letters, each digit and runs of other ASCII marks, and lowers letters.  No cut
    is made beside a byte beyond ASCII, and words with a byte of WHOLE stay as they are.
    """
    starts, ends, first = words(buf, off)
    special = np.concatenate(([0], np.cumsum(WHOLE[buf])))
    whole = special[ends] > special[starts]
    frozen = np.zeros(len(buf) + 1, np.int8)
    frozen[starts[whole]] += 1
    frozen[ends[whole]] -= 1
    frozen = np.cumsum(frozen[:-1], dtype=np.int8) > 0
    lowered = np.where(frozen, buf, LOWER[buf])
    if len(buf) == 0:
        return lowered, starts, ends, first
    k = KIND[buf]
    left, right = k[:-1], k[1:]
    cut = (left > 0) & (right > 0) & (left < 4) & (right < 4) & ((left != right) | (left == 2)) & ~frozen[1:]
    inner = np.flatnonzero(cut) + 1
    inner = inner[~np.isin(inner, starts, assume_unique=True)]
    starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
    return lowered, starts, ends, np.searchsorted(starts, off)


class Known:
    """Ids of the units that a worker has met, by hash; forgotten when there are more than `most`."""

    def __init__(self, tokenizer, most=400_000):
        self.tokenizer, self.most = tokenizer, most
        self.clear()

    def clear(self):
        self.hashes, self.begin, self.sizes, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, hashes, texts):
        """hashes: ascending and new."""
        if len(self.hashes) + len(hashes) > self.most:
            return
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(ids) for ids in coded], np.int64)
        pool = np.fromiter((i for ids in coded for i in ids), np.uint32, int(sizes.sum()))
        place = np.searchsorted(self.hashes, hashes)
        self.begin = np.insert(self.begin, place, np.cumsum(sizes) - sizes + len(self.pool))
        self.sizes = np.insert(self.sizes, place, sizes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.pool = np.concatenate((self.pool, pool))


def tokenise(buf, off, known, end_id):
    """All ids, one end id behind each document, and the offsets of the documents."""
    buf, starts, ends, first = units(buf, off)
    distinct, at, which = np.unique(span_codes(buf, starts, ends), return_index=True, return_inverse=True)
    new = ~in_sorted(distinct, known.hashes)
    if len(known.hashes) + new.sum() > known.most:
        known.clear()
        known.most = max(known.most, len(distinct))
        new[:] = True
    raw = buf.tobytes()
    known.learn(distinct[new], [raw[a:b].decode() for a, b in zip(starts[at[new]], ends[at[new]])])
    own = np.searchsorted(known.hashes, distinct)
    # the units of all documents, and after each document one more entry that stands for the end id
    pool = np.append(known.pool, np.uint32(end_id))
    sizes, begin = np.append(known.sizes[own], 1), np.append(known.begin[own], len(pool) - 1)
    entries = np.insert(which, first[1:], len(sizes) - 1)
    length = sizes[entries]
    until = np.cumsum(length)
    place = np.arange(until[-1] if len(until) else 0) - np.repeat(until - length, length) + np.repeat(begin[entries], length)
    ends_at = first[1:] + np.arange(len(off) - 1)
    return pool[place], np.concatenate(([0], until[ends_at]))


def cut_documents(path, end_id, size):
    def cut(batches):
        import tokenizers

        # one tokenizer for each worker process and not for each task: a worker's freed ones still take memory
        place = path or tokenizer_path()
        kept = worker_state("packing")
        if place not in kept:
            kept[place] = Known(tokenizers.Tokenizer.from_file(place))
        known = kept[place]
        for batch in batches:
            for part in slices(batch, "text"):
                ids, off = tokenise(*text_bytes(part.column("text")), known, end_id)
                rows, start, length, crc = [], [], [], []
                for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    for a in range(lo, hi, size):
                        b = min(a + size, hi)
                        rows.append(i)
                        start.append(a - lo)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].astype("<u4").tobytes()))
                rows = np.array(rows, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "key": part.column("key").take(pa.array(rows)), "mark": part.column("mark").take(pa.array(rows)), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(np.diff(off)[rows], pa.int64())})
        give_back()

    return cut


def first_fit(lengths, size):
    """Sequence and offset of each length in the given order: the leftmost sequence with room, by a tournament tree.

    A node of the tree holds the most free space below it; a descent finds the leftmost leaf with enough.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    free = [size] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < n:
                node += 1
        bins.append(node - leaves)
        offsets.append(size - free[node])
        free[node] -= n
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


def pack_group(size):
    def pack(key, rows):
        order = np.lexsort((rows.column("start").to_numpy(), rows.column("mark").to_numpy(), -rows.column("length").to_numpy()))
        rows = rows.take(pa.array(order))
        bins, offsets = first_fit(rows.column("length").to_pylist(), size)
        return pa.table({**{c: rows.column(c) for c in ("key", "start", "length", "ids_crc32", "doc_tokens")},
                         "sequence_id": pa.array(key[0].as_py() * (1 << 32) + np.array(bins, np.int64)), "offset": pa.array(offsets, pa.int64())})

    return pack


def pack_documents(docs: DataFrame, size=4096, end_id=2, group_rows=8192, tokenizer=None, seed=0, key="doc_id", text="text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece.

    tokenizer: path of a tokenizer file that executors can read; by default the public word_bpe_49k.json.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    groups = max(1, -(-docs.count() // group_rows))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("mark", F.xxhash64(F.lit(seed), "key", "text"))
    kind = dict(rows.dtypes)["key"]
    pieces = rows.mapInArrow(cut_documents(tokenizer, end_id, size), f"key {kind}, mark long, start long, length long, ids_crc32 long, doc_tokens long")
    # identical rows differ in nothing, so the group also takes the piece's place
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("mark", "start"), F.lit(groups)))
    out = pieces.groupBy("group").applyInArrow(pack_group(size), f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)


def op6_packing(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
