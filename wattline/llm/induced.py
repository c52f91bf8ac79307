"""Suffix arrays by induced sorting, in blocks of numpy operations.

An entry of the array fixes the place of the suffix one symbol to its left. A block of
entries may be induced at once as long as none of them lands inside the block; the first
landing ends the block. So the work stays linear and the number of numpy calls is small.
"""

from __future__ import annotations

import numpy as np

_SCALAR = 16  # entries a step must yield, else the next ones are induced one by one


def _kinds(s: np.ndarray) -> np.ndarray:
    """True for the suffixes that are smaller than the one to their right; the sentinel is."""
    n = len(s)
    up = np.empty(n, np.int8)
    up[-1] = 1
    if n > 1:
        up[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
        at = np.where(up != 0, np.arange(n), n)
        up = up[np.minimum.accumulate(at[::-1])[::-1]]  # equal neighbours follow the next change
    return up > 0


def _deal(symbols: np.ndarray, free: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each symbol lands in order: (landing, distinct symbols, how many of each)."""
    sort = np.argsort(symbols, kind="stable")
    ordered = symbols[sort]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.empty_like(first)
    counts[:-1] = first[1:] - first[:-1]
    counts[-1] = len(ordered) - first[-1]
    rank = np.empty(len(symbols), np.int64)
    rank[sort] = np.arange(len(ordered)) - np.repeat(first, counts)
    return free[symbols] + step * rank, ordered[first], counts


def _induce(sa: np.ndarray, s: np.ndarray, small: np.ndarray, free: np.ndarray, step: int) -> None:
    """One pass over ``sa``: rightwards (step 1) for the larger kind, leftwards (-1) for the smaller."""
    n, at, block = len(sa), 0 if step > 0 else len(sa) - 1, 256
    want = step < 0
    while 0 <= at < n:
        stop = min(n, at + block) if want is False else max(-1, at - block)
        held = sa[at:stop] if step > 0 else sa[at : stop if stop >= 0 else None : -1]
        where = np.flatnonzero(held > 0)
        left = held[where] - 1
        fits = small[left] == want
        where, left = where[fits], left[fits]
        if not len(left):
            at += step * len(held)
            block = min(block * 2, 1 << 16)
            continue
        landing, distinct, counts = _deal(s[left], free, step)
        reach = int((landing.min() - at) if step > 0 else (at - landing.max()))
        if reach >= len(held):
            sa[landing] = left
            free[distinct] += step * counts
            at += step * len(held)
            block = min(block * 2, 1 << 16)
            continue
        block = max(64, 2 * reach)
        if reach >= _SCALAR:
            cut = int(np.searchsorted(where, reach))
            if cut:
                landing, distinct, counts = _deal(s[left[:cut]], free, step)
                sa[landing] = left[:cut]
                free[distinct] += step * counts
            at += step * reach
            continue
        for _ in range(200):  # entries that land right behind themselves, as in runs
            if not 0 <= at < n:
                break
            p = int(sa[at]) - 1
            if p >= 0 and small[p] == want:
                c = s[p]
                sa[free[c]] = p
                free[c] += step
            at += step


def _edges(s: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """First place of each symbol's bucket, and last."""
    ends = np.cumsum(np.bincount(s, minlength=symbols))
    return np.concatenate(([0], ends[:-1])), ends - 1


def _sorted_from(leftmost: np.ndarray, s: np.ndarray, small: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """All suffixes induced from leftmost-smaller ones given in order."""
    sa = np.full(len(s), -1, np.int64)
    free = tails.copy()
    backwards = leftmost[::-1]
    landing, _, _ = _deal(s[backwards], free, -1)
    sa[landing] = backwards
    _induce(sa, s, small, heads.copy(), 1)
    fixed = sa[0]  # the sentinel's suffix
    sa[(sa >= 0) & small[np.maximum(sa, 0)]] = -1
    sa[0] = fixed
    _induce(sa, s, small, tails.copy(), -1)
    return sa


def _names(order: np.ndarray, s: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings in ``order`` (positions), equal ones alike."""
    size = np.zeros(len(s), np.int64)
    size[starts] = lengths
    a, b = order[:-1], order[1:]
    differs = size[a] != size[b]
    open_ = np.flatnonzero(~differs)
    k = 0
    while len(open_):
        same = s[a[open_] + k] == s[b[open_] + k]
        differs[open_[~same]] = True
        open_ = open_[same]
        k += 1
        open_ = open_[size[a[open_]] > k]
    return np.concatenate(([0], np.cumsum(differs)))


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array of ``s``: integers below ``symbols`` that end with the only 0."""
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    small = _kinds(s)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    heads, tails = _edges(s, symbols)
    rough = _sorted_from(starts, s, small, heads, tails)
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    order = rough[is_start[rough]]
    lengths = np.diff(np.append(starts, n - 1)) + 1
    ranks = _names(order, s, starts, lengths)
    if ranks[-1] + 1 < len(order):
        name = np.empty(n, np.int64)
        name[order] = ranks
        order = starts[suffix_array(name[starts], int(ranks[-1]) + 1)]
    return _sorted_from(order, s, small, heads, tails)


def _words(s: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer, for symbols below 256.

    The end of the text is followed by zeros; the sentinel is the only 0 in the text, so two
    different suffixes always differ at or before it.
    """
    padded = np.zeros(len(s) + 8, np.uint64)
    padded[: len(s)] = s
    out = padded[:-8].copy()
    for k in range(1, 8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(s)]
    return np.append(out, np.zeros(8, np.uint64))


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, plcp) by text position: the suffix just before in the array, and their common prefix.

    Only irreducible values, where the symbols to the left differ, are compared; the value of
    any other position is one less than that of the position to its left. Symbols are bytes.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    reducible = (before > 0) & (at > 0)
    reducible[reducible] = s[at[reducible] - 1] == s[before[reducible] - 1]
    starts = np.flatnonzero(~reducible)
    plcp = np.zeros(n, np.int64)
    words = _words(s)
    open_ = starts[before[starts] >= 0]
    k = 0
    while len(open_):  # eight symbols at a time while they agree
        differ = words[open_ + k] ^ words[before[open_] + k]
        done = differ != 0
        first = (differ[done].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        plcp[open_[done]] = k + first
        open_ = open_[~done]
        k += 8
    last = np.maximum.accumulate(np.where(reducible, -1, at))
    return before, np.maximum(plcp[last] - (at - last), 0)
