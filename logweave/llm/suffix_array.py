"""Suffix arrays by induced sorting, vectorised over numpy, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next one.  The leftmost S suffixes are sorted eight bytes
at a time, recursing into groups that are still tied, up to `depth` bytes; L and S suffixes are then induced from them
bucket by bucket, a whole wave of suffixes in one step, so the work is linear in the text.  Order beyond `depth` bytes
is not needed by the callers and may be arbitrary.
"""

import numpy as np


def classify(s):
    """True where a suffix is smaller than the next; the last one, a unique least sentinel, is."""
    step = np.sign(np.diff(s.astype(np.int32)))
    places = np.where(step != 0, np.arange(len(step)), len(step))
    decides = np.minimum.accumulate(places[::-1])[::-1]  # where the run of equal symbols ends
    return np.append(np.append(step, 1)[decides] > 0, True)


def sort_substrings(words, at, depth):
    """Places `at` sorted by `depth` bytes of text; ties stay in order of place."""
    groups = np.zeros(len(at), np.int64)
    order = at.copy()
    todo = np.arange(len(at))  # ranks whose group is still tied
    last = len(words) - 1
    for offset in range(0, depth, 8):
        if len(todo) < 2:
            break
        key, group = words[np.minimum(order[todo] + offset, last)], groups[todo]
        fresh = np.append(True, group[1:] != group[:-1])
        unlike = np.append(False, key[1:] != key[:-1]) & ~fresh
        if not unlike.any():
            continue
        # repeats go on alike for long: only groups that differ here are sorted
        name = np.cumsum(fresh) - 1
        mixed = np.zeros(name[-1] + 1, bool)
        mixed[name[unlike]] = True
        some = np.flatnonzero(mixed[name])
        by = some[np.lexsort((key[some], group[some]))]
        order[todo[some]], key[some] = order[todo[by]], key[by]
        fresh[1:] |= key[1:] != key[:-1]
        begin, name = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        groups[todo] = todo[begin][name]
        todo = todo[np.diff(np.append(begin, len(todo)))[name] > 1]
    return order


def text_words(s):
    """For each place the next eight symbols (bytes) as one number; past the end they are 0."""
    padded = np.concatenate((s.astype(np.uint8), np.zeros(8, np.uint8)))
    out = np.zeros(len(s), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(s)].astype(np.uint64)
    return out


def append_by_symbol(lists, s, places):
    symbols = s[places]
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    cuts = np.flatnonzero(np.diff(symbols, prepend=-1))
    for part, c in zip(np.split(places[order], cuts[1:]), symbols[cuts]):
        lists[c].append(part)


def induce(s, smaller, seeds):
    """The suffix array from sorted leftmost-smaller suffixes."""
    size = int(s.max()) + 1
    none = np.zeros(0, np.int64)
    large, small = [[] for _ in range(size)], [[] for _ in range(size)]
    of = s[seeds]
    bounds = np.searchsorted(of, np.arange(size + 1))

    def wave(places, lists, kind):
        before = places[places > 0] - 1
        before = before[smaller[before] == kind]
        if len(before):
            append_by_symbol(lists, s, before)

    for c in range(size):
        done = 0
        while done < len(large[c]):
            batch = large[c][done:]
            done = len(large[c])
            wave(np.concatenate(batch), large, False)
        wave(seeds[bounds[c] : bounds[c + 1]], large, False)
    large = [np.concatenate(x) if x else none for x in large]
    for c in range(size - 1, -1, -1):
        done = 0
        while done < len(small[c]):
            batch = small[c][done:]
            done = len(small[c])
            wave(np.concatenate(batch), small, True)
        wave(large[c][::-1], small, True)
    out = []
    for c in range(size):
        out += [large[c], np.concatenate(small[c])[::-1] if small[c] else none]
    return np.concatenate(out)


def suffix_array(s, depth):
    """Suffixes of s by their first `depth` symbols; s: symbols 1 to 255 and a single 0 at its end.  Leaves out the
    sentinel's own suffix."""
    smaller = classify(s)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return induce(s, smaller, sort_substrings(text_words(s), leftmost, depth + 8))


def common_prefixes(s, order, size):
    """For each place of the text, whether it shares `size` symbols with the suffix before it in the array."""
    words = text_words(s)
    before = np.full(len(s), -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    at = at[(at + size < len(s)) & (before[at] + size < len(s))]
    for offset in range(0, size, 8):
        left = min(8, size - offset)
        a, b = words[at + offset], words[before[at] + offset]
        if left < 8:
            a, b = a >> np.uint64(8 * (8 - left)), b >> np.uint64(8 * (8 - left))
        at = at[a == b]
    out = np.zeros(len(s), bool)
    out[at] = True
    return out


def repeats(s, size):
    """Places whose `size` symbols also start at an earlier place of s."""
    order = suffix_array(s, size)
    if not len(order):
        return np.zeros(0, np.int64)
    same = common_prefixes(s, order, size)[order]
    begin = np.flatnonzero(~same)
    least = np.minimum.reduceat(order, begin)
    group = np.cumsum(~same) - 1
    return np.sort(order[order > least[group]])
