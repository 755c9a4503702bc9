"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, search in sorted windows."""

from __future__ import annotations

import numpy as np

from loxodrome.llm._textkit import Rolling

_BITS = 21
#: So many elements at most in one array: two ranks and a position share 64 bits.
MAX_ELEMENTS = (1 << _BITS) - 2
_MASK = np.uint64((1 << _BITS) - 1)


def _regroup(keys: np.ndarray, slots: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Puts sorted (key, position) values into their slots; a group's rank is its first slot. Returns the slots still shared."""
    pos = (keys & _MASK).astype(np.int64)
    order[slots] = pos
    group = keys >> np.uint64(_BITS)
    new = np.concatenate(([True], group[1:] != group[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
    rank[pos] = slots[head]
    alone = new & np.concatenate((new[1:], [True]))
    return slots[~alone]


def suffix_array(values: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by their first ``depth`` elements or more, equals by position; and each suffix's slot.

    values: bytes, or integers under 2^21.  Each round sorts the groups that are
    still shared by the rank ``h`` further on, which doubles the sorted depth.
    """
    n = len(values)
    order, rank = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    at = np.arange(n, dtype=np.uint64)
    if values.dtype == np.uint8:
        h = 5
        padded = np.concatenate([values, np.zeros(h, np.uint8)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for i in range(h):
            key = (key << np.uint64(8)) | padded[i : i + n]
    else:
        h, key = 1, values.astype(np.uint64)
    shared = _regroup(np.sort((key << np.uint64(_BITS)) | at), np.arange(n), order, rank)
    rank[:n] += 1  # 0: past the end
    while h < depth and len(shared):
        pos = order[shared]
        ahead = rank[np.minimum(pos + h, n)].astype(np.uint64)
        keys = np.sort((rank[pos].astype(np.uint64) << np.uint64(2 * _BITS)) | (ahead << np.uint64(_BITS)) | pos.astype(np.uint64))
        rank[:n] -= 1
        shared = _regroup(keys, shared, order, rank)
        rank[:n] += 1
        h *= 2
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    return order, slot


def common_prefixes(values: np.ndarray, order: np.ndarray, slot: np.ndarray, begin: np.ndarray, count: np.ndarray, end: np.ndarray, cap: int, ordered: np.ndarray | None = None) -> np.ndarray:
    """Kasai: for the first ``count`` suffixes of each text, the common prefix with the suffix before it in the order.

    Texts are begin..end in values; a prefix ends with its text and at ``cap``.
    All texts advance together: step t handles the t-th suffix of each, and keeps of
    the length found at t-1 all but one.  ordered: which suffixes the order holds, if
    not all; behind one whose next is left out, nothing is kept.
    """
    n = len(values)
    lcp = np.zeros(n, np.int32)
    text_end = np.zeros(n, np.int64)
    text_end[begin] = end
    text_end = np.maximum.accumulate(text_end)
    wide = values.dtype == np.uint8
    if wide:
        eight = np.lib.stride_tricks.as_strided(np.concatenate([values, np.zeros(8, np.uint8)]), (n + 1, 8), (1, 1)).copy().view(np.uint64).ravel()
        low = [np.uint64((1 << (8 * k)) - 1) for k in range(1, 9)]
    by_count = np.argsort(-count, kind="stable")
    begin, count = begin[by_count], count[by_count]
    h = np.zeros(len(begin), np.int64)
    for t in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -t, "left"))
        i = begin[:live] + t
        s = slot[i]
        j = order[np.maximum(s - 1, 0)]
        room = np.where(s > 0, np.minimum(cap, np.minimum(text_end[i] - i, text_end[j] - j)), 0)
        now = np.minimum(np.maximum(h[:live] - 1, 0), room)
        go = np.flatnonzero(now < room)
        while len(go):
            a, b, f = i[go], j[go], now[go]
            if wide:
                x = eight[a + f] ^ eight[b + f]
                step = sum(((x & m) == 0).astype(np.int64) for m in low)
            else:
                step = (values[a + f] == values[b + f]).astype(np.int64)
            f = np.minimum(f + step, room[go])
            now[go] = f
            go = go[(step == (8 if wide else 1)) & (f < room[go])]
        h[:live] = now if ordered is None else np.where(ordered[np.minimum(j + 1, n - 1)], now, 0)
        lcp[i] = now
    return lcp


class WindowRuns:
    """The suffix array of some texts (bytes), and the runs of their windows that are equal.

    texts: (elements joined, begin, end); windows begin at each of the first
    end - begin - window + 1 elements of a text.
    """

    def __init__(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> None:
        self.values, self.window = values, window
        count = np.maximum(end - begin - window + 1, 0)
        order, slot = suffix_array(values, window)
        edge = np.zeros(len(values) + 1, np.int32)
        np.add.at(edge, begin, 1)
        np.subtract.at(edge, begin + count, 1)
        is_window = np.cumsum(edge[:-1]) > 0
        self.starts = np.repeat(begin, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        self.text = np.repeat(np.arange(len(begin)), count)
        # windows are compared with the window before them: a suffix that is none, running over a separator, may stand between equal ones
        in_order = order[is_window[order]]
        slot[in_order] = np.arange(len(in_order))
        lcp = common_prefixes(values, in_order, slot, begin, count, end, window, is_window)
        whole = Rolling(values).spans(in_order, in_order + window)
        new = lcp[in_order] < window
        new[1:] |= whole[1:] != whole[:-1]
        run_of = np.empty(len(values), np.int64)
        run_of[in_order] = np.cumsum(new) - 1
        self.run = run_of[self.starts]
        self.n_runs = int(new.sum())
        self.heads = in_order[new]  # one window of each run, in sorted order

    def head_windows(self) -> np.ndarray:
        """Windows of the heads as comparable byte strings; a last byte of 1 keeps zeros at their end."""
        out = np.ones((len(self.heads), self.window + 1), np.uint8)
        for i in range(0, len(self.heads), 1 << 14):
            out[i : i + (1 << 14), :-1] = self.values[self.heads[i : i + (1 << 14), None] + np.arange(self.window)]
        return out.view(f"S{self.window + 1}").ravel()


def shared_runs(a: WindowRuns, b: WindowRuns) -> tuple[np.ndarray, np.ndarray]:
    """Merges two shards: each run of a is sought in b's sorted runs by binary search. Which runs of a and of b have a partner."""
    in_a, in_b = np.zeros(a.n_runs, bool), np.zeros(b.n_runs, bool)
    if a.n_runs and b.n_runs:
        wa, wb = a.head_windows(), b.head_windows()
        at = np.minimum(np.searchsorted(wb, wa), b.n_runs - 1)
        in_a = wb[at] == wa
        in_b[at[in_a]] = True
    return in_a, in_b


def ranges(flags: np.ndarray, text: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows with following offsets in one text: text, first and last offset."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    cutoff = np.concatenate(([True], (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]])))
    first = np.flatnonzero(cutoff)
    last = np.concatenate((first[1:], [len(at)])) - 1
    return text[at[first]], offset[at[first]], offset[at[last]]
