"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour;
the substrings between leftmost S positions are sorted and named, the string of
names is sorted recursively, and two scans induce the rest. A scan runs over
character buckets in blocks: consecutive buckets of which none induces entries of
another one of the block are read in one numpy step. So a scan's steps follow from
how the characters stand next to each other and not from their number: an alphabet
with as many letters as the string has places takes about the root of them.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the end of the string counts as smaller than all, so the last suffix is L."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    at = np.searchsorted(differs, np.arange(n))
    out = np.zeros(n, bool)
    ok = at < len(differs)
    p = differs[at[ok]]
    out[ok] = text[p] < text[p + 1]
    return out


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The integers of all ranges low[k] to high[k] - 1, one range after the other."""
    size = high - low
    return np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)


def blocks(text: np.ndarray, is_s: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """For each letter, where a block that begins with it ends: the first letter above it, and the last below it, that the block's own letters induce."""
    before, after = text[:-1], text[1:]
    above = np.full(letters, letters, np.int64)
    up = ~is_s[:-1] & (before > after)
    np.minimum.at(above, after[up], before[up])
    below = np.full(letters, -1, np.int64)
    down = is_s[:-1] & (before < after)
    np.maximum.at(below, after[down], before[down])
    return np.minimum.accumulate(above[::-1])[::-1], np.maximum.accumulate(below)


def induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix order induced by seeds, the leftmost S positions in their order; starts are the buckets' bounds."""
    n, letters = len(text), len(starts) - 1
    order = np.full(n, -1, np.int64)
    head, tail = starts[:-1].copy(), starts[1:].copy()
    grouped = seeds[np.argsort(text[seeds], kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(text[seeds], minlength=letters))])
    above, below = blocks(text, is_s, letters)

    def place(found: np.ndarray) -> None:
        """Append suffixes to the heads of their buckets."""
        letter = text[found]
        sort = np.argsort(letter, kind="stable")
        edge = np.flatnonzero(np.diff(letter[sort], prepend=-1))
        used, count = letter[sort[edge]], np.diff(np.append(edge, len(sort)))
        order[ranges(head[used], head[used] + count)] = found[sort]
        head[used] += count

    def place_back(found: np.ndarray) -> None:
        """Prepend suffixes to the tails of their buckets, the first found furthest right."""
        found = found[::-1]
        letter = text[found]
        sort = np.argsort(letter, kind="stable")
        edge = np.flatnonzero(np.diff(letter[sort], prepend=-1))
        used, count = letter[sort[edge]], np.diff(np.append(edge, len(sort)))
        order[ranges(tail[used] - count, tail[used])] = found[sort]
        tail[used] -= count

    def left_of(entries: np.ndarray, want_s: bool) -> np.ndarray:
        before = entries[entries > 0] - 1
        return before[is_s[before] == want_s]

    def own(entries: np.ndarray, want_s: bool) -> np.ndarray:
        """What entries induce in their own buckets."""
        before = entries[entries > 0] - 1
        return before[(is_s[before] == want_s) & (text[before] == text[before + 1])]

    if not is_s[n - 1]:
        place(np.array([n - 1]))
    low = 0
    while low < letters:
        high = int(above[low])
        block = np.arange(low, high)
        done = starts[block]
        while (wave := ranges(done, head[block])).size:
            done = head[block].copy()
            if (found := own(order[wave], False)).size:
                place(found)
        larger, several = order[ranges(starts[block], head[block])], high - low > 1
        read = np.concatenate([larger, grouped[first[low] : first[high]]])
        if several:
            read = read[np.argsort(text[read], kind="stable")]
        found = left_of(read, False)
        if (found := found[text[found] >= high]).size:
            place(found)
        low = high
    high = letters - 1
    while high >= 0:
        low = int(below[high]) + 1
        block = np.arange(low, high + 1)
        done = starts[block + 1]
        while (wave := ranges(tail[block], done)).size:
            done = tail[block].copy()
            if (found := own(order[wave][::-1], True)).size:
                place_back(found)
        # Of each bucket the S entries, which lie right, are read before the L entries, all from the right.
        found = left_of(order[ranges(np.stack([starts[block], tail[block]], 1).ravel(), np.stack([head[block], starts[block + 1]], 1).ravel())][::-1], True)
        if (found := found[text[found] < low]).size:
            place_back(found)
        high = low - 1
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The start positions of all suffixes, in order. text holds integers; a suffix precedes its extensions."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = np.unique(text, return_inverse=True)[1].astype(np.int64)
    is_s = smaller_than_next(text)
    starts = np.concatenate([[0], np.cumsum(np.bincount(text))])
    seeds = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(seeds) > 1:
        order = induce(text, is_s, seeds, starts)
        mark = np.zeros(n, bool)
        mark[seeds] = True
        ranked = order[mark[order]]
        names, distinct = name_substrings(text, seeds, ranked)
        inner = suffix_array(names) if distinct < len(seeds) else np.argsort(names)
        seeds = seeds[inner]
    return induce(text, is_s, seeds, starts)


def name_substrings(text: np.ndarray, seeds: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """A name for each leftmost S substring, in text order; equal substrings share a name, and names follow their order."""
    n = len(text)
    stop = np.full(n, n, np.int64)
    stop[seeds[:-1]] = seeds[1:]
    size = stop[ranked] - ranked + 1
    a, b = ranked[:-1], ranked[1:]
    new = size[:-1] != size[1:]
    new |= (stop[a] == n) | (stop[b] == n)
    open_pairs = np.flatnonzero(~new)
    k = 0
    while open_pairs.size:
        open_pairs = open_pairs[k < size[open_pairs]]
        unequal = text[a[open_pairs] + k] != text[b[open_pairs] + k]
        new[open_pairs[unequal]] = True
        open_pairs = open_pairs[~unequal]
        k += 1
    name = np.concatenate([[0], np.cumsum(new)])
    of = np.empty(n, np.int64)
    of[ranked] = name
    return of[seeds], int(name[-1]) + 1


def common_prefixes(text: np.ndarray, order: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each rank, the common prefix with the rank before, within left[i] characters of each suffix.

    Permuted: values are found in text order, where a value whose preceding characters agree is one less
    than the value before it, so only the others are compared, eight characters at a time.
    text holds bytes; left[i] is how far suffix i may be read (to the end of its piece).
    """
    n = len(text)
    above = np.full(n, -1, np.int64)
    above[order[1:]] = order[:-1]
    at = np.arange(n)
    has = above >= 0
    fresh = ~has
    inner = has & (at > 0) & (above > 0)
    fresh |= has & ~inner
    where = np.flatnonzero(inner)
    fresh[where] = (text[where - 1] != text[above[where] - 1]) | (left[where - 1] <= 1) | (above[where - 1] != above[where] - 1)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)[: n + 1]
    value = np.zeros(n, np.int64)
    todo = np.flatnonzero(fresh & has)
    most = np.minimum(left[todo], left[above[todo]])
    length = np.zeros(len(todo), np.int64)
    live = np.arange(len(todo))
    while live.size:
        i, j = todo[live] + length[live], above[todo[live]] + length[live]
        differ = words[np.minimum(i, n)] != words[np.minimum(j, n)]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        length[live] += same
        live = live[(same == 8) & (length[live] < most[live])]
    value[todo] = np.minimum(length, most)
    last = np.maximum.accumulate(np.where(fresh, at, 0))
    value = np.maximum(np.where(fresh, value, value[last] - (at - last)), 0)
    return value[order]
