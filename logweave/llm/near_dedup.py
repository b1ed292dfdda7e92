"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set holds the hashes of its distinct runs of `size` words, lower-cased.  Documents with equal sets form a
class; the rest works on one representative of each class, so thousands of copies are one row.

The signature has `labels` MinHash labels.  Each of `trees` orders sorts all representatives, by range, by their labels
from a starting place of its own on and around, so that a region of like documents is spread over as many tasks as it
needs.  The first two labels make a region.  A region's depth is adaptive: a document is compared with all that share as
many further labels with it as leave at most `few` documents, and with its two neighbours, which share the longest prefix.
A pair with similarity 0.8 shares the first two labels of none of 12 orders with probability 5e-6, with 0.85 2e-7.

The documents in regions of more than `few` are joined exactly, by prefixes of their whole sets: shingles have an order
in which frequent ones come last, and similar sets share one of their first.  Of the documents that share such a shingle,
all pairs of different components whose sizes, places and odd shingles allow the similarity are confirmed.  Groups that
were found before are one component by then, so that members of one group make no pairs.  No pair is left out whatever
the size of a region or of a shingle's documents; many distinct documents that are nearly as similar as a link, and have
none, are the case in which the number of pairs grows with the square of theirs.

Labels only order the documents and make regions: no candidate is dropped by what they estimate, each one is confirmed on
the whole sets.

Results by case: null and empty texts have an empty set and stay alone; texts under `size` words are one run; rows that
share an id are one document in the graph; rows with a null id stay alone, keep a null component and are kept; ties
between equally ranked shingles go by their hashes and change no component; very long texts are
hashed whole; an empty table gives an empty result; further columns are ignored.
"""

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, checkpointed, partitions
from .components import components, renamed
from .kernels import BASE, LOWER, give_back, in_sorted, mix64, pack_sorted, slices, span_codes, text_bytes, unpack_sorted, words

REGION = 8  # bytes that stand for the labels of a region
BLOCK_ROWS = 1 << 17  # rows of an order that a task holds at a time
RANKED = 1 << 18  # shingles that have a rank
SAMPLES = 20_000  # rows that bound the ranges of the orders, about: the driver gets three times as many


def shingle_sets(column, size):
    """Ascending distinct shingle hashes of each document."""
    buf, off = text_bytes(column)
    buf = LOWER[buf]
    starts, ends, first = words(buf, off)
    codes = span_codes(buf, starts, ends)
    n = max(0, len(codes) - size + 1)
    hashes = codes[:n]
    for k in range(1, size):
        hashes = mix64((hashes + np.uint64(k)) * np.uint64(BASE) ^ codes[k : n + k])
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if 0 < hi - lo < size:
            whole = mix64(np.array([hi - lo], np.uint64))
            for code in codes[lo:hi]:
                whole = mix64(whole * np.uint64(BASE) ^ code)
            out.append(whole)
        else:
            out.append(np.unique(hashes[lo : max(lo, hi - size + 1)]))
    return out


def signatures(sets, count):
    """(documents, count) 32-bit MinHash labels of non-empty sets."""
    seeds = mix64(np.arange(1, count + 1, dtype=np.uint64)), mix64(np.arange(1001, count + 1001, dtype=np.uint64)) | np.uint64(1)
    flat = np.concatenate(sets)
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), count), np.uint32)
    for i in range(count):
        out[:, i] = mix64(np.minimum.reduceat((flat ^ seeds[0][i]) * seeds[1][i], begin)).astype(np.uint32)
    return out


def sign(size, trees, labels):
    """Rows (key, n_shingles, print1, print2, regions, sketch): a region of 8 bytes for each tree, and a byte of each label."""

    def run(batches):
        step, salts = labels // trees, mix64(np.array([1, 2], np.uint64))
        total = lambda s, k: int(mix64(s ^ salts[k]).sum(dtype=np.uint64).astype(np.int64))
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"), size)
                some = [s for s in sets if len(s)]
                regions, sketches = iter(()), iter(())
                if some:
                    marks = signatures(some, labels)
                    starts = np.arange(trees) * step
                    region = (marks[:, starts].astype(np.uint64) << np.uint64(32)) | marks[:, starts + 1]
                    regions = iter([x.tobytes() for x in region.astype(">u8")])
                    sketches = iter([x.tobytes() for x in marks.astype(np.uint8)])
                yield pa.RecordBatch.from_pydict({
                    "key": part.column("key"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "print1": pa.array([total(s, 0) for s in sets], pa.int64()), "print2": pa.array([total(s, 1) for s in sets], pa.int64()),
                    "regions": pa.array([next(regions) if len(s) else None for s in sets], pa.binary()),
                    "sketch": pa.array([next(sketches) if len(s) else None for s in sets], pa.binary())})
        give_back()

    return run


def orders(classes, trees, labels):
    """(tree, label, doc): for each tree the region and the other labels from its place on and around."""
    step = labels // trees
    rows = classes.select("doc", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "regions", "sketch")
    at = f"tree * {step} + 2"
    label = f"concat(substring(regions, tree * {REGION} + 1, {REGION}), substring(sketch, {at} + 1), substring(sketch, 1, {at}))"
    return rows.select("tree", F.expr(label).alias("label"), "doc")


class Block:
    """Rows of an order, some of them seen before, with the ends of each row's region."""

    def __init__(self, columns):
        self.tree, self.label, self.doc = columns[:3]
        self.more = columns[3:]
        n = len(self.doc)
        region = np.ascontiguousarray(self.label[:, :REGION]).view(">u8").ravel()
        self.sketch = self.label[:, REGION:]
        self.fresh = np.ones(n, bool)  # begins a region
        self.fresh[1:] = (region[1:] != region[:-1]) | (self.tree[1:] != self.tree[:-1])
        self.begin, self.end = run_ends(self.fresh)


def run_ends(fresh):
    """For each row the first row of its run and the first behind it."""
    at = np.flatnonzero(fresh)
    which = np.cumsum(fresh) - 1
    return at[which], np.append(at[1:], len(fresh))[which]


def blocks(batches, names, carry):
    """The rows of a partition in blocks; each holds up to `carry` rows of the one before, whose number is given too."""
    held, rows = [], 0

    def block():
        table = pa.Table.from_batches(held).combine_chunks()
        label = table.column("label").chunk(0)
        off = np.frombuffer(label.buffers()[1], np.int32)[label.offset : label.offset + len(label) + 1]
        flat = np.frombuffer(label.buffers()[2], np.uint8)[off[0] : off[-1]]
        return Block([table.column("tree").to_numpy(), flat.reshape(len(label), -1), *(table.column(c).to_numpy() for c in names)])

    before = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows - before >= BLOCK_ROWS:
            yield block(), before
            tail = pa.Table.from_batches(held).slice(max(0, rows - carry)).combine_chunks().to_batches()
            held, before = tail, sum(b.num_rows for b in tail)
            rows = before
    if rows > before:
        yield block(), before


PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def pair_batch(doc, a, b):
    u, v = np.maximum(doc[a], doc[b]), np.minimum(doc[a], doc[b])
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=PAIRS)


def first_pairs(few):
    """Candidate pairs (u, v) of a sorted range, and the documents (u, null) of regions that may be larger than `few`."""

    def run(batches):
        for block, old in blocks(batches, ["doc"], few):
            n = len(block.doc)
            # how many leading labels a row shares with the one before: -1 in another region
            lead = np.full(n, -1)
            near = np.flatnonzero(~block.fresh)
            differs = block.sketch[near] != block.sketch[near - 1]
            lead[near] = np.where(differs.any(axis=1), differs.argmax(axis=1), block.sketch.shape[1])
            # the least depth at which a row's region has at most `few` rows
            stop, start, settled = np.arange(n) + 1, np.arange(n), np.zeros(n, bool)
            depth = 0
            while not settled.all() and depth <= block.sketch.shape[1]:
                begin, end = run_ends(lead < depth)
                now = ~settled & (end - begin <= few)
                stop[now], start[now] = end[now], begin[now]
                settled |= now
                depth += 1
            a, b = [], []
            for d in range(1, few):
                i = np.arange(max(0, old - d), n - d)
                i = i[(i + d < stop[i]) | (start[i + d] <= i) | ((d == 1) & (lead[i + 1] >= 0))]
                i = i[(i + d >= old)]
                a.append(i)
                b.append(i + d)
            a, b = np.concatenate(a), np.concatenate(b)
            yield pair_batch(block.doc, a, b)
            # regions cut by the end of a block may go on
            large = (block.end - block.begin > few) | (block.begin == 0) | (block.end == n)
            large[:old] = False
            at = np.flatnonzero(large)
            yield pa.RecordBatch.from_arrays([pa.array(block.doc[at]), pa.nulls(len(at), pa.int64())], schema=PAIRS)

    return run


TOKEN_ROWS = ["token", "doc", "of", "size", "place", "odd1", "odd2"]


def batches_of_sets(batches, most=1 << 20):
    """The rows of a partition in runs of about `most` shingles: the rows, all their shingles, how many each row has."""
    for batch in batches:
        held, total, start = [], 0, 0
        for i, blob in enumerate(batch.column("shingles")):
            held.append(unpack_sorted(blob.as_py()))
            total += len(held[-1])
            if total >= most or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start), np.concatenate(held), np.array([len(s) for s in held])
                held, total, start = [], 0, i + 1


def often(least=4, most=1 << 21):
    """(token, times) of the shingles that stand in `least` sets of a partition at least."""

    def added(parts):
        token, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        return token, np.bincount(at, np.concatenate([n for _, n in parts]), len(token)).astype(np.int64)

    def counted(flat):
        token, times = np.unique(np.concatenate(flat), return_counts=True)
        return token[times > 1], times[times > 1]

    def run(batches):
        parts, flat, rows = [], [], 0
        for _, shingles, _ in batches_of_sets(batches):
            flat.append(shingles)
            rows += len(shingles)
            if rows >= most:
                parts, flat, rows = [added([*parts, counted(flat)])], [], 0
        if flat:
            parts = [added([*parts, counted(flat)])]
        for token, times in parts:
            token, times = token[times >= least], times[times >= least]
            for i in range(0, len(token), 10_000):
                yield pa.RecordBatch.from_pydict({"token": pa.array(token[i : i + 10_000].view(np.int64)), "times": pa.array(times[i : i + 10_000])})
        give_back()

    return run


def ranked(sets):
    """The shingles that stand in most sets, ascending, and a rank of each that grows with that number; all others have rank 0.

    The ranks only order the shingles: any order gives the same pairs in the end, a better one makes fewer candidates.
    So counts by partition suffice, and as many levels of them as hold RANKED shingles.
    """
    counts = sets.mapInArrow(often(), "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    counts = checkpointed(counts.select("token", F.floor(4 * F.log2("times")).cast("int").alias("rank")))
    total, least = 0, None
    for level, n in sorted(((r["rank"], r["count"]) for r in counts.groupBy("rank").count().collect()), reverse=True):
        total += n
        if total > RANKED:
            break
        least = level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    top = counts.where(F.col("rank") >= least).toArrow()
    token, rank = top.column("token").to_numpy().view(np.uint64), top.column("rank").to_numpy().astype(np.uint8)
    order = np.argsort(token)
    return token[order], rank[order]


def prefixes(similarity, table, ranks):
    """Rows (token, doc, of, size, place, odd1, odd2): of a set of n shingles, those by ascending rank that two sets must
    share one of.  odd1 and odd2 tell for each of 128 values of a shingle's leading bits whether it comes an odd number of times."""
    num, den = similarity

    def run(batches):
        for part, flat, size in batches_of_sets(batches):
            rank = np.zeros(len(flat), np.uint8)
            if len(table):
                at = np.minimum(np.searchsorted(table, flat), len(table) - 1)
                rank = np.where(table[at] == flat, ranks[at], 0)
            which = np.repeat(np.arange(len(size)), size)
            odd = np.bincount(which * 128 + (flat >> np.uint64(57)).astype(np.int64), minlength=128 * len(size)).reshape(-1, 128) & 1
            odd = np.packbits(odd.astype(bool), axis=1).view(np.int64)
            flat = flat[np.lexsort((flat, rank, which))]
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            keep = place <= (size + (-num * size) // den)[which]
            which, doc, of = which[keep], part.column("doc").to_numpy(), part.column("of").to_numpy()
            columns = [flat[keep].view(np.int64), doc[which], of[which], size[which].astype(np.int32), place[keep].astype(np.int32), odd[which, 0], odd[which, 1]]
            for i in range(0, len(which), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 10_000]) for c in columns], names=TOKEN_ROWS)
        give_back()

    return run


def sharing_pairs(similarity, few=32, cells=1 << 21):
    """Of each token's rows all pairs (u, v) of different components that may be as similar.

    A pair's first common shingle has the rest of both sets behind it, so that what is left of the shorter rest bounds
    what they share; pairs for which the bound is too low here have an earlier one or are no link.  Sets differ in as
    many shingles at least as their odd values do.
    """
    num, den = similarity

    def fit(rows, a, b):
        _, _, of, size, place, odd1, odd2 = rows
        both = size[a] + size[b]
        least = -((-num * both) // (num + den))
        fits = np.flatnonzero((of[a] != of[b]) & (np.minimum(size[a] - place[a], size[b] - place[b]) >= least))
        a, b = a[fits], b[fits]
        differ = sum(np.bitwise_count((odd[a] ^ odd[b]).view(np.uint64)).astype(np.int64) for odd in (odd1, odd2))
        fits = differ <= (both - 2 * least)[fits]
        return a[fits], b[fits]

    def pairs(rows):
        token, _, of = rows[:3]
        fresh = np.append(True, token[1:] != token[:-1])
        begin = np.flatnonzero(fresh)
        mixed = np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin)
        length = np.diff(np.append(begin, len(token)))
        some = mixed & (length <= few)
        stop = np.repeat(np.where(some, begin + length, 0), length)
        i = np.flatnonzero(np.repeat(some, length))
        for d in range(1, few):
            i = i[i + d < stop[i]]
            yield fit(rows, i, i + d)
        for lo, n in zip(begin[mixed & ~some].tolist(), length[mixed & ~some].tolist()):
            # members of the largest component pair with those outside it alone
            _, which, times = np.unique(of[lo : lo + n], return_inverse=True, return_counts=True)
            outer, inner = np.flatnonzero(which != times.argmax()) + lo, np.flatnonzero(which == times.argmax()) + lo
            after = np.concatenate((outer, inner))
            step = max(1, cells // n)
            for k in range(0, len(outer), step):
                a = np.repeat(outer[k : k + step], len(after) - k)
                b = np.tile(after[k:], len(outer[k : k + step]))
                yield fit(rows, a, b)

    def run(batches):
        for rows in token_blocks(batches):
            seen, total = [], 0
            for a, b in pairs(rows):
                if len(a):
                    doc = rows[1]
                    seen.append(np.stack((np.maximum(doc[a], doc[b]), np.minimum(doc[a], doc[b]))))
                    total += len(a)
                if total > cells:
                    seen = [np.unique(np.concatenate(seen, axis=1), axis=1)]
                    yield from pair_batches(seen)
                    seen, total = [], 0
            if seen:
                yield from pair_batches([np.unique(np.concatenate(seen, axis=1), axis=1)])
        give_back()

    return run


def token_blocks(batches):
    """The columns of a sorted partition in blocks that end with a token's last row."""
    held, rows = [], 0

    def columns(table):
        return [table.column(c).to_numpy().astype(np.int64, copy=False) for c in TOKEN_ROWS]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= BLOCK_ROWS and batch.num_rows and held[0].column("token")[0] != batch.column("token")[-1]:
            table = pa.Table.from_batches(held)
            token = table.column("token").to_numpy()
            cut = int(np.searchsorted(token, token[-1]))
            yield columns(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            rows -= cut
    if rows:
        yield columns(pa.Table.from_batches(held))


def pair_batches(seen):
    for u, v in seen:
        for i in range(0, len(u), 10_000):
            yield pa.RecordBatch.from_pydict({"u": pa.array(u[i : i + 10_000]), "v": pa.array(v[i : i + 10_000])})


def write_sets(size):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_pydict({"doc": part.column("doc"), "shingles": pa.array([pack_sorted(s) for s in sets], pa.binary())})
        give_back()

    return run


def confirm(numerator, denominator):
    """Keeps pairs with denominator * intersection >= numerator * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("shingles_u"), batch.column("shingles_v")):
                a, b = unpack_sorted(a.as_py()), unpack_sorted(b.as_py())
                both = int(in_sorted(a, b).sum())
                keep.append(denominator * both >= numerator * (len(a) + len(b) - both) and both > 0)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs, sets, similarity):
    left, right = sets.select(F.col("doc").alias("u"), F.col("shingles").alias("shingles_u")), sets.select(F.col("doc").alias("v"), F.col("shingles").alias("shingles_v"))
    return checkpointed(pairs.join(left, "u").join(right, "v").select("u", "v", "shingles_u", "shingles_v").mapInArrow(confirm(*similarity), "u long, v long"))


@contextlib.contextmanager
def sampled(spark):
    """Plans that run herein sample SAMPLES rows for their ranges, however many partitions there are."""
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(int(before), SAMPLES // partitions(spark)))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_duplicates(docs: DataFrame, size=5, similarity=(80, 100), trees=12, labels=96, few=8, key="doc_id", text="text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of docs; the key is an integer.

    similarity: (numerator, denominator) of the least Jaccard similarity of a link.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    whole = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    rows = checkpointed(whole.mapInArrow(sign(size, trees, labels), "key long, n_shingles long, print1 long, print2 long, regions binary, sketch binary"))
    classes = rows.where("n_shingles > 0 and key is not null").groupBy("print1", "print2", "n_shingles")
    classes = checkpointed(classes.agg(F.min("key").alias("doc"), F.min("regions").alias("regions"), F.min("sketch").alias("sketch")))

    spread = orders(classes, trees, labels)
    with sampled(spark):
        spread = spread.repartitionByRange(partitions(spark), "tree", "label", "doc").sortWithinPartitions("tree", "label", "doc")
        found = checkpointed(spread.mapInArrow(first_pairs(few), "u long, v long"))
    large, pairs = found.where("v is null").select(F.col("u").alias("doc")).distinct(), found.where("v is not null").distinct()
    needed = found.select(F.explode(F.array("u", "v")).alias("doc")).where("doc is not null").distinct()
    sets = checkpointed(whole.withColumnRenamed("key", "doc").join(needed, "doc", "left_semi").mapInArrow(write_sets(size), "doc long, shingles binary"))
    # an id that several rows share stands for all their sets: its class's own one is among them
    known = checkpointed(components(confirmed(pairs, sets, similarity)))
    members = large.join(known.select(F.col("node").alias("doc"), F.col("component").alias("of")), "doc", "left").select("doc", F.coalesce("of", "doc").alias("of"))
    rest = sets.join(members, "doc").mapInArrow(prefixes(similarity, *ranked(sets)), "token long, doc long, of long, size int, place int, odd1 long, odd2 long")
    rest = rest.repartition(partitions(spark), "token").sortWithinPartitions("token")
    rest = checkpointed(rest.mapInArrow(sharing_pairs(similarity), "u long, v long").distinct())
    known = renamed(known, confirmed(rest, sets, similarity))

    # only classes of several rows and linked ones have a name other than their own document's
    named = classes.select("print1", "print2", "n_shingles", "doc").join(known.withColumnRenamed("node", "doc"), "doc", "left")
    named = named.select("print1", "print2", F.col("n_shingles").alias("n"), F.coalesce("component", "doc").alias("component"))
    spread = F.when((F.col("n_shingles") > 0) & F.col("key").isNotNull(), F.col("print1"))
    out = rows.select("key", "n_shingles", "print2", spread.alias("print1"))
    lone, rest = out.where("print1 is null"), out.where("print1 is not null")
    rest = rest.join(named, (rest["print1"] == named["print1"]) & (rest["print2"] == named["print2"]) & (rest["n_shingles"] == named["n"]), "left")
    out = rest.select("key", "n_shingles", F.coalesce("component", "key").alias("component_id")).unionByName(lone.select("key", "n_shingles", F.col("key").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True))).withColumnRenamed("key", key)


def op7_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, similarity=(85, 100))
