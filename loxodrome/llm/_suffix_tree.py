"""Suffix trees over words, held as sorted suffixes and the common prefixes of neighbours.

An internal node is a span of at least two neighbours in the order that agree over
its depth, and neither over more nor beyond its ends: first leaf, last leaf, depth.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of words, equals as they come; and how many first words each shares with the one before it."""
    n, depth = words.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(words, return_inverse=True)[1].reshape(n, depth).astype(">u4")
    order = np.argsort(np.ascontiguousarray(rank).view(f"S{4 * depth}").ravel(), kind="stable")
    same = rank[order[1:]] == rank[order[:-1]]
    common = np.where(same.all(axis=1), depth, np.argmin(same, axis=1))
    return order, np.concatenate(([0], common))


def highest_nodes(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last leaf of the nodes at least ``least`` deep that lie in no other such node."""
    deep = np.concatenate((common >= least, [False]))
    edge = np.flatnonzero(np.diff(deep.astype(np.int8)))
    return edge[::2], edge[1::2]


def internal_nodes(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first leaf, last leaf, depth) of every node at least ``least`` deep."""
    out, open_at = [], []
    for i, c in enumerate([*common.tolist(), 0]):
        begin = i - 1
        while open_at and open_at[-1][1] > c:
            begin, depth = open_at.pop()
            out.append((begin, i - 1, depth))
        if c >= least and (not open_at or open_at[-1][1] < c):
            open_at.append((begin, c))
    return out


def maximal_repeats(texts: list[np.ndarray], least: int) -> dict[tuple[int, ...], list[tuple[int, int]]]:
    """Word sequences of ``least`` words or more that stand in two places and can be lengthened on neither side in all of them: their places (text, word).

    One tree of all suffixes; a node is maximal if its leaves differ in the word before.
    """
    known, dense = np.unique(np.concatenate([*texts, np.zeros(0, np.uint64)]), return_inverse=True)
    ranked = np.split(dense.astype(np.uint64), np.cumsum([len(x) for x in texts]))
    longest = max(map(len, texts), default=0)
    places = [(t, i) for t, x in enumerate(texts) for i in range(len(x) - least + 1)]
    words = np.zeros((len(places), longest + 1), np.uint64)
    for k, (t, i) in enumerate(places):
        rest = ranked[t][i:]
        words[k, : len(rest)] = rest
        words[k, len(rest) :] = len(known) + k  # ends differ from words and from each other
    order, common = sorted_suffixes(words)
    out = {}
    for first, last, depth in internal_nodes(common, least):
        own = [places[k] for k in order[first : last + 1]]
        before = {int(texts[t][i - 1]) if i else (t,) for t, i in own}
        if len(before) > 1:
            t, i = own[0]
            out[tuple(texts[t][i : i + depth].tolist())] = sorted(own)
    return out
