"""Suffix arrays by induced sorting, and permuted common prefixes, with numpy.

Suffixes are classified as smaller or larger than their right neighbour. The leftmost smaller
ones (LMS) cut the string into substrings; these are sorted by induction and named by their
ranks, the string of names is sorted by recursion, and from its order all suffixes are induced:
first the larger ones, from the buckets of small characters to those of great ones, then the
smaller ones the other way round. A bucket (all suffixes with one first character) is induced in
bulk: what it puts into later buckets keeps its order, and what it puts into itself (runs of one
character) follows in rounds. Where buckets are thin, as in a string of nearly distinct names,
bulk does not pay; such a string is ranked by doubling, ties only.
"""

import numpy as np

#: Characters a bucket holds on average below which a string is ranked by doubling; this changes the speed only.
THIN = 48


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the one after it; t ends with a character less than all others, which counts as smaller."""
    differs = t[:-1] != t[1:]
    rises = t[:-1][differs] < t[1:][differs]
    out = np.ones(len(t), bool)
    # Equal neighbours decide as the next place where neighbours differ.
    out[:-1] = rises[np.cumsum(differs) - differs]
    return out


class _Buckets:
    """Suffixes in order of arrival, bucket by bucket."""

    def __init__(self, counts: np.ndarray):
        self.free = np.cumsum(counts) - counts
        self.start = self.free.copy()
        self.rows = np.empty(int(counts.sum()), np.int32)

    def put(self, suffixes: np.ndarray, characters: np.ndarray) -> None:
        order = np.argsort(characters, kind="stable")
        ch = characters[order]
        opens = np.flatnonzero(np.append(True, ch[1:] != ch[:-1]))
        size = np.diff(np.append(opens, len(ch)))
        own = ch[opens]
        self.rows[np.repeat(self.free[own] - opens, size) + np.arange(len(ch))] = suffixes[order]
        self.free[own] += size


def induced(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes from the LMS suffixes in order (at least of their first characters)."""
    n = len(t)
    large, small = np.bincount(t[~smaller], minlength=sigma), np.bincount(t[smaller], minlength=sigma)
    up, down = _Buckets(large), _Buckets(small)
    edge = np.searchsorted(t[lms], np.arange(sigma + 1))

    def spread(into: _Buckets, some: np.ndarray, wanted: bool) -> None:
        before = some - 1
        before = before[before >= 0]
        before = before[smaller[before] == wanted]
        if len(before):
            into.put(before, t[before])

    used = np.flatnonzero(large + small).tolist()
    for c in used:
        at = up.start[c]
        while at < up.free[c]:
            at, some = up.free[c], up.rows[at : up.free[c]]
            spread(up, some, False)
        if edge[c] < edge[c + 1]:
            spread(up, lms[edge[c] : edge[c + 1]], False)
    # Nothing comes before the last suffix, so it is put in place by hand.
    down.put(np.array([n - 1], np.int32), t[-1:])
    for c in reversed(used):
        at = down.start[c]
        while at < down.free[c]:
            at, some = down.free[c], down.rows[at : down.free[c]]
            spread(down, some, True)
        if up.start[c] < up.free[c]:
            spread(down, up.rows[up.start[c] : up.free[c]][::-1], True)
    first = np.cumsum(large + small) - large - small
    out = np.empty(n, np.int32)
    out[np.repeat(first - up.start, large) + np.arange(len(up.rows))] = up.rows
    # The smaller suffixes came in falling order.
    out[np.repeat(first + large + small - 1 + down.start, small) - np.arange(len(down.rows))] = down.rows
    return out


def names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The rank of each LMS substring (from one LMS place to the next, that included), in the order of lms; equal ones share it."""
    follows = np.append(lms[1:], lms[-1])
    place = np.searchsorted(lms, ordered)
    size = follows[place] - ordered + 1
    same = np.zeros(len(ordered), bool)
    alike = np.flatnonzero(size[1:] == size[:-1])
    length = size[alike].astype(np.int64)
    begin = np.cumsum(length) - length
    step = np.arange(int(length.sum())) - np.repeat(begin, length)
    equal = t[np.repeat(ordered[alike], length) + step] == t[np.repeat(ordered[alike + 1], length) + step]
    if len(alike):
        same[alike + 1] = np.logical_and.reduceat(equal, begin)
    out = np.empty(len(lms), np.int32)
    out[place] = np.cumsum(~same) - 1
    return out


def doubled(t: np.ndarray) -> np.ndarray:
    """The order of suffixes by doubling: tied ones are told apart by the rank of the suffix as far on as they are known to agree."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    rank = np.empty(n, np.int64)
    tied, key, reach = np.arange(n), t[order], 0
    while True:
        opens = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(opens, len(key)))
        rank[order[tied]] = np.repeat(tied[opens], size)
        tied = tied[np.repeat(size > 1, size)]
        if not len(tied):
            return order
        reach = 2 * reach or 1
        at = order[tied]
        key = rank[at] * n + rank[at + reach]
        by = np.argsort(key, kind="stable")
        order[tied], key = at[by], key[by]


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """The order of the suffixes of t, whose characters are under sigma; the last one is less than all others."""
    if len(t) < 2 or sigma * THIN > len(t):
        return doubled(t)
    smaller = smaller_than_next(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + np.int32(1)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    rough = induced(t, smaller, lms[np.argsort(t[lms], kind="stable")], sigma)
    name = names(t, lms, rough[is_lms[rough]])
    return induced(t, smaller, lms[suffix_array(name, int(name.max()) + 1)], sigma)


_STEPS = np.array([1 << (8 * k) for k in range(1, 8)], np.uint64)


def permuted_prefixes(t: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of t (bytes), the suffix before its own in order (-1: none) and the length of their common prefix.

    Where the characters to the left of both agree, the length is one less than at the place
    before; it is measured only where they don't.
    """
    n = len(t)
    left = np.empty(n, np.int32)
    left[order[0]], left[order[1:]] = -1, order[:-1]
    words = np.zeros(n, np.uint64)
    padded = np.append(t, np.zeros(8, np.uint8))
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + n]
    apart = left <= 0
    apart[0] = True
    apart[1:] |= t[:-1] != t[np.maximum(left[1:] - 1, 0)]
    common = np.zeros(n, np.int32)
    at = np.flatnonzero(apart & (left >= 0))
    while len(at):
        x = words[at + common[at]] ^ words[left[at] + common[at]]
        common[at] += np.where(x == 0, 8, 7 - np.searchsorted(_STEPS, x, "right")).astype(np.int32)
        at = at[x == 0]
    place = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(apart, place, 0))
    return left, common[last] - (place - last)
