"""Vectorised kernels over the buffers of Arrow string columns.

Everything works on whole texts as UTF-8 bytes.  A batch is cut into slices of a few MB, so that
memory stays bounded whatever the size of a partition; one document is never cut.
"""

import ctypes
import hashlib
import sys
import types

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
LONG = 4096  # bytes of a span that is hashed by itself


def mix64(x):
    """A bijective 64-bit finaliser; vectorised, wraps."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


class Powers:
    """BASE**i and BASE**-i modulo 2**64 for every i below n."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            out = []
            for base in (BASE, BASE_INV):
                x = np.full(size, base, dtype=np.uint64)
                x[0] = 1
                out.append(np.multiply.accumulate(x))
            self.up, self.down = out
        return self.up, self.down


def text_bytes(column):
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch, column, limit=SLICE_BYTES):
    """The rows of a batch in runs of about `limit` bytes of text, at least one row each."""
    if batch.num_rows == 0:
        return
    _, off = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def words(buf, off):
    """Start and end of each word, and for each document the first word (one entry more than documents).

    A word is a run without the bytes 0x20 and 0x09-0x0D; documents bound words.
    """
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = np.empty(len(buf) + 1, bool)
    solid[:-1] = ~IS_SPACE[buf]
    solid[-1] = False
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    before = np.empty(len(buf) + 1, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first))
    ends = np.flatnonzero(before & (~solid | first))
    return starts, ends, np.searchsorted(starts, off)


def byte_prefix(buf, powers):
    up, _ = powers.upto(len(buf) + 1)
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_CODES[buf] * up[: len(buf)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(prefix, starts, ends, powers):
    """Hash of the bytes of each span, wherever it stands."""
    _, down = powers.upto(len(prefix))
    raw = (prefix[ends] - prefix[starts]) * down[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(BASE))


def span_codes(buf, starts, ends):
    """Hash of the bytes of each span, eight bytes at a time through a mixing that is no polynomial, so that no family of
    texts (such as Thue-Morse words, for hashes modulo a power of two) is bound to collide."""
    size = (ends - starts).astype(np.int64)
    out = mix64(size.astype(np.uint64) + np.uint64(BASE))
    if not len(out):
        return out
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    todo, at, left = np.arange(len(out)), starts.astype(np.int64), size
    for i in np.flatnonzero(size > LONG):  # by their length alone, whatever stands beside them
        digest = hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = mix64(out[i : i + 1] ^ np.frombuffer(digest, "<u8"))[0]
    some = (left > 0) & (left <= LONG)
    while some.any():
        todo, at, left = todo[some], at[some], left[some]
        word = eight[at] & WORD_MASKS[np.minimum(left, 8)]
        out[todo] = mix64((out[todo] ^ word) * np.uint64(BASE) + np.uint64(1))
        at, left = at + 8, left - 8
        some = left > 0
    return out


def window_hashes(codes, first, size, powers):
    """Rabin-Karp hash of each run of `size` codes within one document; also where each run starts."""
    if len(codes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers.upto(len(codes) + 1)
    prefix = np.empty(len(codes) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(codes * up[: len(codes)], dtype=np.uint64, out=prefix[1:])
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(codes)) + size <= last)
    return at, mix64((prefix[at + size] - prefix[at]) * down[at])


def covered(at, size, n):
    """Which of n places lie in one of the runs of `size` that start at `at`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1) if len(at) < 64 else edge.__iadd__(np.bincount(at, minlength=n + 1))
    edge -= np.bincount(at + size, minlength=n + 1)[: n + 1] if len(at) else 0
    return np.cumsum(edge[:-1]) > 0


def runs(mask):
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pack_sorted(values):
    """Ascending uint64 values as differences of a fixed width; unpack_sorted is exact."""
    if len(values) == 0:
        return b""
    step = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(blob):
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    step = np.zeros((len(raw), 8), np.uint8)
    step[:, :width] = raw
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64)


def in_sorted(values, table):
    """Which values stand in an ascending table."""
    if len(table) == 0:
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def give_back():
    """Returns freed memory to the system: workers are used again, and their allocators keep what a task has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_state(name):
    """A dictionary that lives as long as the worker process.  Functions reach workers by value, so that globals of their
    modules last for one task only."""
    holder = sys.modules.setdefault("logweave_worker_state", types.ModuleType("logweave_worker_state"))
    return vars(holder).setdefault(name, {})
