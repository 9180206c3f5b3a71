"""Subsets that add up to a target within a tolerance, by meeting in the middle.

Members are cut into two halves, all sums of each half are formed (2 ** (n / 2) rows of a matrix), and sums of
one half look up those of the other between bounds in sorted order. So 30 members take some ten thousand rows a half,
where all their subsets are a thousand million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of half sums that are looked at together.
PAIRS = 2_000_000


def half_sums(values: np.ndarray) -> np.ndarray:
    """Sums of all subsets of the rows; bit i of a subset's number stands for row i."""
    out = np.zeros((1, values.shape[1]))
    for row in values:
        out = np.concatenate([out, out + row])
    return out


def _meet(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) whose sum lies between low and high in every column."""
    order = np.argsort(b[:, 0], kind="stable")
    first = b[order, 0]
    start, stop = np.searchsorted(first, low[0] - a[:, 0], "left"), np.searchsorted(first, high[0] - a[:, 0], "right")
    size = np.maximum(stop - start, 0)
    ends, at = np.cumsum(size), 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)))
        n = size[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = order[np.repeat(start[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        for c in range(1, a.shape[1]):
            s = a[i, c] + b[j, c]
            keep = (s >= low[c]) & (s <= high[c])
            i, j = i[keep], j[keep]
        if len(i):
            yield i, j
        at = to


def matching_subsets(values: np.ndarray, target: np.ndarray, tolerance: float, misses: int, least: int = 2) -> list[tuple[int, ...]]:
    """Subsets of at least `least` rows whose sum is the target, but for at most `misses` columns, within the tolerance.

    Columns go in misses + 1 groups that share none: a subset that fails in no more than misses columns holds
    in all columns of some group, so one search a group finds every subset. Only subsets that hold no
    smaller one are returned. With fewer columns than groups, single columns that a group lacks don't bind it.
    """
    n, m = values.shape
    width = tolerance * np.abs(target)
    low, high = target - width, target + width
    # where nothing is negative, a row over the target in too many columns is in no such subset
    possible = np.flatnonzero((values > high).sum(axis=1) <= misses) if (values >= 0).all() else np.arange(n)
    if len(possible) < least or not m:
        return []
    part = values[possible]
    half = len(possible) // 2
    a, b = half_sums(part[:half]), half_sums(part[half:])
    count = np.array([bin(x).count("1") for x in range(max(len(a), len(b)))])
    groups = [g for g in np.array_split(np.arange(m), misses + 1) if len(g)]
    found: set[int] = set()
    for g in groups:
        # the widest-spread columns come first, as they leave the fewest pairs
        g = g[np.argsort(width[g] / np.maximum(part[:, g].sum(axis=0), 1e-300))]
        for i, j in _meet(a[:, g], b[:, g], low[g], high[g]):
            some = count[i] + count[j] >= least
            i, j = i[some], j[some]
            s = a[i] + b[j]
            fine = ((s < low) | (s > high)).sum(axis=1) <= misses
            found.update((i[fine].astype(object) + (j[fine].astype(object) << half)).tolist())
    minimal = []
    for x in sorted(found, key=lambda x: (bin(x).count("1"), x)):
        if not any(x & y == y for y in minimal):
            minimal.append(x)
    return [tuple(int(possible[k]) for k in range(len(possible)) if x >> k & 1) for x in minimal]


def first_subset(values: list[float], low: float, high: float, least: int = 2) -> tuple[int, ...] | None:
    """The smallest subset of at least `least` values with its sum between low and high, of those the first in order; None if there is none."""

    def halves(rest: list[float]) -> list[list[np.ndarray]]:
        out = []
        for part in (rest[: len(rest) // 2], rest[len(rest) // 2 :]):
            sums = half_sums(np.array(part, float).reshape(-1, 1))[:, 0]
            count = np.array([bin(x).count("1") for x in range(len(sums))])
            out.append([np.sort(sums[count == k]) for k in range(len(part) + 1)])
        return out

    def sizes(rest: list[float], lo: float, hi: float) -> set[int]:
        a, b = halves(rest)
        return {i + j for i, x in enumerate(a) for j, y in enumerate(b) if (np.searchsorted(y, hi - x, "right") > np.searchsorted(y, lo - x, "left")).any()}

    fit = [k for k in sorted(sizes(values, low, high)) if k >= least]
    if not fit:
        return None
    size, chosen, done = fit[0], [], 0.0
    for i, v in enumerate(values):  # a value is taken if the rest of its size can follow
        left = size - len(chosen) - 1
        if left < 0:
            break
        if left in sizes(values[i + 1 :], low - done - v, high - done - v):
            chosen.append(i)
            done += v
    return tuple(chosen)
