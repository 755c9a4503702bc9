"""Content-defined anchors: which windows of a corpus can occur twice at all.

Every window of ``window`` elements (bytes, words) chooses the least of its hashed
grams of ``gram`` elements, the leftmost of equals.  Neighbouring windows mostly
choose the same one, so the windows of a text fall into runs, each with one anchor.
Equal windows choose the same gram at the same place, hence a window can only recur
among the windows whose anchors have the same hash.  An anchor's *context* is the
text its run of windows covers; equal contexts have equal windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from loxodrome.llm import _textkit as tk

POSITION_BITS = 28


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """min(keys[i:i+width]) for every i, by doubling."""
    if len(keys) < width:
        return keys[:0]
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[: len(keys) - size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


@dataclass
class Anchors:
    """Runs of window starts lo..hi (inclusive) in text doc; at: where the anchor gram begins."""

    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray


def find_anchors(grams: np.ndarray, doc: np.ndarray, window: int, gram: int) -> Anchors:
    """grams: a hash for each start of ``gram`` elements (whatever text they end in); doc: the text of each element."""
    if len(doc) >> POSITION_BITS:
        raise ValueError(f"a text of more than 2^{POSITION_BITS} elements")
    starts = len(doc) - window + 1
    if starts <= 0:
        e = np.zeros(0, np.int64)
        return Anchors(e, e, e, e)
    pos = np.arange(len(grams), dtype=np.uint64)
    keys = (grams >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | pos
    chosen = (sliding_least(keys, window - gram + 1)[:starts] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    inside = np.flatnonzero(doc[:starts] == doc[window - 1 :])
    at = chosen[inside]
    d = doc[inside]
    if not len(inside):
        return Anchors(inside, inside, inside, inside)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (d[1:] != d[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(inside)])) - 1
    return Anchors(d[first], inside[first], inside[last], at[first])
