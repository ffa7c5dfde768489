"""Suffix arrays by induced sorting.

Suffixes are S (smaller than the next) or L; a leftmost S suffix after an L is a leftmost-smaller one. Their substrings are sorted by
inducing, named, and the string of names is sorted recursively; the whole array then follows by inducing twice more. Byte strings
are induced bucket by bucket in waves of numpy operations (a wave is what the last one put into its own bucket); strings of names, whose
buckets are tiny, element by element. Both are linear.
"""

from __future__ import annotations

import numpy as np


def _smaller_types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; the empty suffix after the end is the least."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = -1
    here = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(here[::-1])[::-1]] > 0


def _induce(s: np.ndarray, small: np.ndarray, sizes: np.ndarray, leftmost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Array of all suffixes from the leftmost-smaller ones in the order given, and where each bucket's S part begins."""
    n, k = len(s), len(sizes)
    start = np.cumsum(sizes) - sizes
    end = start + sizes
    out = np.full(n, -1, np.int64)
    seeds = s[leftmost]
    order = np.argsort(seeds, kind="stable")
    seeds, bound = leftmost[order], np.searchsorted(seeds[order], np.arange(k + 1))
    head = start.copy()
    used = np.flatnonzero(sizes)

    def before(found: np.ndarray, is_small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        j = found[found > 0] - 1
        j = j[small[j] == is_small]
        c = s[j]
        by = np.argsort(c, kind="stable")
        j, c = j[by], c[by]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(c)])
        return j, c[first], count, np.arange(len(c)) - np.repeat(first, count)

    def ahead(found: np.ndarray) -> None:
        j, c, count, rank = before(found, False)
        out[np.repeat(head[c], count) + rank] = j
        head[c] += count

    out[head[s[n - 1]]] = n - 1
    head[s[n - 1]] += 1
    for c in used:
        at = start[c]
        while at < head[c]:
            at, wave = head[c], out[at : head[c]]
            ahead(wave)
        if bound[c] < bound[c + 1]:
            ahead(seeds[bound[c] : bound[c + 1]])
    tail = end.copy()

    def behind(found: np.ndarray) -> None:
        j, c, count, rank = before(found, True)
        out[np.repeat(tail[c], count) - 1 - rank] = j
        tail[c] -= count

    for c in used[::-1]:
        at = end[c]
        while at > tail[c]:
            at, wave = tail[c], out[tail[c] : at][::-1]
            behind(wave)
        if start[c] < head[c]:
            behind(out[start[c] : head[c]][::-1])
    return out, tail


def _names(s: np.ndarray, leftmost: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in text order, equal for equal substrings, and how many there are."""
    size = np.zeros(len(s), np.int64)
    size[leftmost[:-1]] = np.diff(leftmost) + 1
    n = size[ordered]
    alike = np.flatnonzero((n[1:] == n[:-1]) & (n[1:] > 0))
    new = np.ones(len(ordered), np.int64)
    if len(alike):
        length = n[alike + 1]
        first = np.cumsum(length) - length
        offset = np.arange(int(length.sum())) - np.repeat(first, length)
        same = s[np.repeat(ordered[alike], length) + offset] == s[np.repeat(ordered[alike + 1], length) + offset]
        new[alike[np.logical_and.reduceat(same, first)] + 1] = 0
    name = np.empty(len(s), np.int64)
    name[ordered] = np.cumsum(new) - 1
    return name[leftmost], int(new.sum())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of small non-negative integers (bytes)."""
    if len(s) < 2:
        return np.arange(len(s))
    s = s.astype(np.uint16)
    small = _smaller_types(s)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(s)
    if len(leftmost) > 1:
        found, tail = _induce(s, small, sizes, leftmost)
        is_leftmost = np.zeros(len(s), bool)
        is_leftmost[leftmost] = True
        ordered = found[is_leftmost[found]]
        names, k = _names(s, leftmost, ordered)
        leftmost = ordered if k == len(ordered) else leftmost[np.array(_sorted_names(names.tolist(), k))]
    return _induce(s, small, sizes, leftmost)[0]


def _sorted_names(s: list[int], k: int) -> list[int]:
    """Suffix array of a string over 0..k-1, element by element."""
    n = len(s)
    if n < 2:
        return list(range(n))
    small = bytearray(n)
    for i in range(n - 2, -1, -1):
        a, b = s[i], s[i + 1]
        small[i] = a < b or (a == b and small[i + 1])
    start = [0] * (k + 1)
    for c in s:
        start[c + 1] += 1
    for c in range(k):
        start[c + 1] += start[c]

    def induce(seeds: list[int]) -> list[int]:
        out = [-1] * n
        tail = start[1:]
        for i in reversed(seeds):
            c = s[i]
            tail[c] -= 1
            out[tail[c]] = i
        head = start[:-1]
        c = s[n - 1]
        out[head[c]] = n - 1
        head[c] += 1
        for at in range(n):
            i = out[at] - 1
            if i >= 0 and not small[i]:
                c = s[i]
                out[head[c]] = i
                head[c] += 1
        tail = start[1:]
        for at in range(n - 1, -1, -1):
            i = out[at] - 1
            if i >= 0 and small[i]:
                c = s[i]
                tail[c] -= 1
                out[tail[c]] = i
        return out

    leftmost = [i for i in range(1, n) if small[i] and not small[i - 1]]
    if len(leftmost) > 1:
        is_leftmost = bytearray(n)
        for i in leftmost:
            is_leftmost[i] = 1
        ordered = [i for i in induce(leftmost) if is_leftmost[i]]
        after = dict(zip(leftmost, leftmost[1:], strict=False))
        name, last, names = -1, None, {}
        for i in ordered:
            this = s[i : after[i] + 1] if i in after else None
            if this is None or this != last:
                name += 1
            last, names[i] = this, name
        leftmost = ordered if name + 1 == len(ordered) else [leftmost[j] for j in _sorted_names([names[i] for i in leftmost], name + 1)]
    return induce(leftmost)


def permuted_reach(text: np.ndarray, array: np.ndarray, length: int) -> np.ndarray:
    """In text order: whether the common prefix of a suffix with the one before it in the array has `length` bytes or more.

    Compared eight bytes at a time from both ends of the prefix inwards, on the suffixes still undecided.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    word = np.ndarray(n, "<u8", padded, strides=(1,))
    at = np.flatnonzero((before >= 0) & (np.arange(n) + length <= n) & (before + length <= n))
    offsets = [*range(0, length - 7, 8)]
    if length % 8 or not offsets:
        offsets.append(max(0, length - 8))
    offsets.sort(key=lambda o: -abs(o - length / 2))
    for o in offsets:
        at = at[word[at + o] == word[before[at] + o]]
    out = np.zeros(n, bool)
    out[at] = True
    return out
