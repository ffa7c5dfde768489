"""Longest common subsequences of many patterns with all windows of one sequence, in one pass over pattern x sequence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Sequences up to this length are aligned side by side, longer ones by themselves; and pairs x length that are worked on at a time.
SHORT = 64
BLOCK = 1 << 19


def window_table(sequence: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """h[p, j], from which the score of any window follows: the common subsequence of pattern p and sequence[i:k] is as long as there are j
    in i..k-1 with h[p, j] <= i (all-substring alignment: Alves, Caceres and Song, "An all-substrings common subsequence algorithm", 2008).

    sequence: n numbers; patterns: one a row, filled up with numbers that the sequence lacks. Cells of an antidiagonal do not depend on
    each other, so a step is a few array operations over all patterns.
    """
    (p, m), n = patterns.shape, len(sequence)
    h = np.tile(np.arange(1, n + 1, dtype=np.int64), (p, 1))
    v = np.zeros((p, m), np.int64)
    for d in range(n + m - 1):
        lo, hi = max(0, d - n + 1), min(m - 1, d)
        down, right = slice(lo, hi + 1), slice(d - hi, d - lo + 1)
        above, before = h[:, right][:, ::-1], v[:, down]
        same = patterns[:, down] == sequence[right][::-1]
        across, below = np.where(same, before, np.maximum(before, above)), np.where(same, above, np.minimum(before, above))
        h[:, right], v[:, down] = across[:, ::-1], below
    return h


def window_lengths(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each window [start, end) the longest common subsequence with any of the patterns of h."""
    return np.array([np.count_nonzero(h[:, a:b] <= a, axis=1).max(initial=0) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def best_lengths(sequence: list[str], patterns: list[list[str]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for lists of tokens; 0 without patterns."""
    patterns = [p for p in patterns if p]
    if not patterns or not sequence:
        return np.zeros(len(starts), np.int64)
    number: dict[str, int] = {}
    tokens = np.array([number.setdefault(t, len(number)) for t in sequence])
    table = np.full((len(patterns), max(map(len, patterns))), -1)
    for row, p in zip(table, patterns, strict=True):
        row[: len(p)] = [number.get(t, -1) for t in p]
    return window_lengths(window_table(tokens, table), starts, ends)


@dataclass(frozen=True)
class Lists:
    """Lists of numbers end to end: list k is values[offsets[k]:offsets[k + 1]]."""

    values: np.ndarray
    offsets: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def padded(self, which: np.ndarray, width: int, fill: int) -> np.ndarray:
        """width x len(which): the lists of which side by side, filled up."""
        at = self.offsets[which] + np.arange(width)[:, None]
        return np.where(at < self.offsets[which + 1], self.values[np.minimum(at, len(self.values) - 1)], fill)


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges [start, start + size) all numbers, and the number of the range of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes), owner


def _tables(sequences: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """window_table() of each column of sequences (n x pairs) with the same column of patterns (m x pairs)."""
    (n, p), m = sequences.shape, len(patterns)
    h = np.repeat(np.arange(1, n + 1, dtype=np.int32)[:, None], p, axis=1)
    for i in range(m):
        before = np.zeros(p, np.int32)
        for j in range(n):
            above, same = h[j], sequences[j] == patterns[i]
            h[j], before = np.where(same, before, np.maximum(before, above)), np.where(same, above, np.minimum(before, above))
    return h


def batch_lengths(sequences: Lists, patterns: Lists, windows: Lists, ends: np.ndarray, firsts: np.ndarray, counts: np.ndarray, once: np.ndarray | None = None) -> np.ndarray:
    """Of every window of every sequence the longest common subsequence with one of the sequence's patterns firsts[k] .. firsts[k] + counts[k] - 1; 0 without one.

    windows: the starts of each sequence's windows, ends beside its values. once: patterns (true) that are not met by a sequence equal to them. Short pairs of
    about the same lengths are aligned side by side, in blocks; a long sequence or pattern takes the way of window_table().
    """
    best = np.zeros(len(ends), np.int64)
    n, m, asked = sequences.sizes, patterns.sizes, windows.sizes
    busy = (n > 0) & (asked > 0)
    longest = np.zeros(len(n), np.int64)
    inner, owner = spread(firsts, counts)
    np.maximum.at(longest, owner, m[inner])
    long = busy & ((n > SHORT) | (longest > SHORT))
    for k in np.flatnonzero(long & (counts > 0)).tolist():
        own = sequences.values[sequences.offsets[k] : sequences.offsets[k + 1]]
        mine = [(j, patterns.values[patterns.offsets[j] : patterns.offsets[j + 1]]) for j in range(firsts[k], firsts[k] + counts[k])]
        mine = [p for j, p in mine if len(p) and not (once is not None and once[j] and np.array_equal(p, own))]
        if mine:
            table = np.full((len(mine), max(map(len, mine))), -1)
            for row, p in zip(table, mine, strict=True):
                row[: len(p)] = p
            at = slice(windows.offsets[k], windows.offsets[k + 1])
            best[at] = window_lengths(window_table(own, table), windows.values[at], ends[at])
    short = (busy & ~long)[owner] & (m[inner] > 0)
    inner, owner = inner[short], owner[short]
    order = np.argsort((n[owner] * (SHORT + 1) + m[inner]).astype(np.int16), kind="stable")
    inner, owner = inner[order], owner[order]
    # Pairs are sorted by both lengths; a block ends where the sequences get longer or the patterns more than a quarter longer than its first one.
    kind = n[owner] * (SHORT + 1) + np.ceil(np.log(np.maximum(m[inner], 1)) / np.log(1.25)).astype(np.int64)
    cuts = [*np.flatnonzero(np.diff(kind, prepend=-1)).tolist(), len(kind)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        width = int(n[owner[lo]])
        step = max(1, BLOCK // (width * (2 + int(asked[owner[lo:hi]].max()))))
        for at in range(lo, hi, step):
            p, q = inner[at : min(hi, at + step)], owner[at : min(hi, at + step)]
            a, b = sequences.padded(q, width, -2).astype(np.int32), patterns.padded(p, int(m[p].max()), -1).astype(np.int32)
            h = _tables(a, b)
            if once is not None:
                k = min(len(a), len(b))
                h[:, once[p] & (m[p] == n[q]) & ((a[:k] == b[:k]).sum(axis=0) == n[q])] = width + 1
            w, pair = spread(windows.offsets[q], asked[q])
            start, size = windows.values[w], ends[w] - windows.values[w]
            found = np.zeros(len(w), np.int64)
            for j in range(int(size.max(initial=0))):
                found += (j < size) & (h[np.minimum(start + j, width - 1), pair] <= start)
            np.maximum.at(best, w, found)
    return best
