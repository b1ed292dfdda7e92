"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a small embedding; filters of a few bytes run over every place of the text.  Overlapping chunks cover
the whole document; each chunk keeps every filter's greatest activation, a document the mean and the greatest over
its chunks, and one hidden layer turns those into one probability.

The network is fitted on the driver on a bounded sample of labelled rows, `sample` at most (the smallest hashes, so
that a rerun takes the same), each with its whole text; everything else covers all rows.  The weights are about ten
thousand numbers, so they travel with the function.

Results by case: null and empty texts are scored as one blank chunk; repeated rows score alike; several labels for
one id each count; null labels are left out; a null id counts as the text "" for the fold; without any usable label
every score is 0.5; an empty table gives an empty result.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches
from .kernels import slices, text_bytes

EMBED, WIDTH, FILTERS, HIDDEN = 6, 6, 32, 24
CHUNK, STRIDE = 256, 128  # places of a chunk, and from one chunk to the next
GAP = WIDTH - 1  # blanks behind a text, so that no filter looks into the next one


def layout(buf, off):
    """Texts with a gap behind each, the stride-long cells of each, and for each cell its document.

    Each text is padded to whole cells with GAP blanks at least; a chunk is a cell and, within the document, the
    next one.  The last GAP places of a document, all blank, do not count: filters there look into the next text.
    """
    n = np.diff(off)
    cells = -(-(n + GAP) // STRIDE)
    begin = np.concatenate(([0], np.cumsum(cells)))
    codes = np.full(begin[-1] * STRIDE + GAP, 32, np.uint8)
    shift = np.repeat(begin[:-1] * STRIDE - off[:-1], n)
    codes[np.arange(len(buf)) + shift] = buf
    return codes, begin


def activations(codes, weights):
    """Filter values at each place: (places, FILTERS)."""
    x = weights["embed"][codes]
    rows = len(codes) - GAP
    windows = np.lib.stride_tricks.as_strided(x, (rows, WIDTH * EMBED), (x.strides[0], x.strides[1]))
    return windows @ weights["conv"] + weights["conv_bias"]


def chunk_maxima(cell, begin):
    """Greatest of each cell and the next one in its document, and from which cell it came."""
    follows = np.ones(len(cell), bool)
    follows[begin[1:] - 1] = False
    after = np.concatenate((cell[1:], cell[-1:]))
    take = follows[:, None] & (after > cell)
    return np.where(take, after, cell), take


def features(codes, begin, weights, back=False, block=2048):
    """(documents, 2 * FILTERS) features; with back, also what the gradient needs."""
    parts, where = [], []
    for a in range(0, begin[-1], block):
        b = min(a + block, begin[-1])
        z = activations(codes[a * STRIDE : b * STRIDE + GAP], weights).reshape(b - a, STRIDE, FILTERS)
        last = begin[1:] - 1 - a
        z[last[(last >= 0) & (last < b - a)], STRIDE - GAP :] = -np.inf
        if back:
            at = z.argmax(axis=1)
            parts.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
            where.append(at + (np.arange(a, b) * STRIDE)[:, None])
        else:
            parts.append(z.max(axis=1))
    cell = np.concatenate(parts)
    chunk, take = chunk_maxima(cell, begin)
    value = np.tanh(chunk)
    count = np.diff(begin)[:, None]
    mean = np.add.reduceat(value, begin[:-1], axis=0) / count
    most = np.maximum.reduceat(value, begin[:-1], axis=0)
    out = np.concatenate((mean, most), axis=1).astype(np.float32)
    return (out, value, take, np.concatenate(where), most) if back else out


def combine(x, weights):
    hidden = np.tanh(((x - weights["mean"]) / weights["std"]) @ weights["dense"] + weights["dense_bias"])
    return hidden, 1 / (1 + np.exp(-np.clip(hidden @ weights["out"] + weights["out_bias"], -30, 30)))


def fit(texts, labels, epochs=8, batch=32, rate=0.01, seed=0):
    """Weights of the network by Adam on the logistic loss; the two labels weigh alike."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    w = {"embed": draw(256, EMBED) * 8, "conv": draw(WIDTH * EMBED, FILTERS), "conv_bias": np.zeros(FILTERS, np.float32), "dense": draw(2 * FILTERS, HIDDEN),
         "dense_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN), "out_bias": np.float32(0), "mean": np.zeros(2 * FILTERS, np.float32), "std": np.ones(2 * FILTERS, np.float32)}
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        return w | {"out": w["out"] * 0}
    laid = [layout(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    first = np.concatenate([features(c, b, w) for c, b in laid])
    w["mean"], w["std"] = first.mean(axis=0), first.std(axis=0) + 0.05
    trained = ["embed", "conv", "conv_bias", "dense", "dense_bias", "out", "out_bias"]
    m, v = ({k: np.zeros_like(w[k]) for k in trained} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            codes = np.concatenate([laid[i][0][:-GAP] for i in some] + [np.full(GAP, 32, np.uint8)])
            begin = np.concatenate(([0], np.cumsum([laid[i][1][-1] for i in some])))
            x, value, take, where, most = features(codes, begin, w, back=True)
            hidden, p = combine(x, w)
            g = {}
            d = (p - labels[some]) * weight[some] / len(some)
            g["out"], g["out_bias"] = hidden.T @ d, d.sum()
            dh = np.outer(d, w["out"]) * (1 - hidden**2)
            g["dense"], g["dense_bias"] = ((x - w["mean"]) / w["std"]).T @ dh, dh.sum(axis=0)
            dx = dh @ w["dense"].T / w["std"]
            doc = np.repeat(np.arange(len(some)), np.diff(begin))
            dv = dx[doc, :FILTERS] / np.diff(begin)[doc][:, None]
            hit = value == most[doc]
            dv += hit * dx[doc, FILTERS:] / np.add.reduceat(hit, begin[:-1], axis=0)[doc]
            dv *= 1 - value**2
            # a chunk's gradient goes to the place where its greatest value stood, in its cell or in the next one
            place = np.where(take, np.concatenate((where[1:], where[-1:])), where)
            g["conv_bias"] = dv.sum(axis=0)
            g["conv"], g["embed"] = np.zeros_like(w["conv"]), np.zeros_like(w["embed"])
            bytes_ = codes[place[:, :, None] + np.arange(WIDTH)].astype(np.int64)  # chunks, filters, width
            seen = w["embed"][bytes_].reshape(*place.shape, WIDTH * EMBED)
            g["conv"] = np.einsum("cf,cfk->kf", dv, seen)
            # per place of a filter and dimension of the embedding, the gradient summed by byte
            slope = w["conv"].reshape(WIDTH, EMBED, FILTERS)
            for j in range(WIDTH):
                by_filter = np.bincount((bytes_[:, :, j] + 256 * np.arange(FILTERS)).ravel(), dv.ravel(), 256 * FILTERS).reshape(FILTERS, 256)
                g["embed"] += (slope[j] @ by_filter).T.astype(np.float32)
            step += 1
            for k in trained:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return w


def score_texts(weights, held_out_fold):
    def score(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                buf, off = text_bytes(part.column("text"))
                _, p = combine(features(*layout(buf, off), weights), weights)
                fold = [zlib.crc32(("" if k is None else str(k)).encode()) % 4 == held_out_fold for k in part.column("key").to_pylist()]
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "held_out": pa.array(fold, pa.bool_()), "score": pa.array(p.astype(np.float64))})

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, sample=2000, held_out_fold=2, cut=0.7, seed=0, key="doc_id", label="quality", text="text") -> DataFrame:
    """(key, held_out, score, predicted) for each row of docs.

    labels: (key, label).  Rows with crc32(key as text) mod 4 equal to held_out_fold are never learned from.
    sample: the greatest number of labelled rows that are learned from, half of them of each label.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and key is not null")
    known = known.where(F.crc32(F.col("key").cast("string").cast("binary")) % 4 != held_out_fold)
    chosen = [known.where(F.col("label") == x).orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(sample // 2) for x in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # `sample` rows at most
    got = rows.join(chosen, "key").select("key", "label", F.col("text").cast("binary").alias("text")).orderBy("key", "label", "text").collect()
    weights = fit([bytes(r.text or b"") for r in got], [r.label for r in got], seed=seed)
    out = rows.mapInArrow(score_texts(weights, held_out_fold), f"key {dict(rows.dtypes)['key']}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int")).withColumnRenamed("key", key)


def op10_quality_cnn(spark, sf_dir):
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
