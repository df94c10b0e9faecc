"""A run-length index of a repetitive text, and the long repeats it finds.

The index is the Burrows-Wheeler transform in runs of equal letters, with the suffix array sampled at the ends of the runs. How
far a suffix agrees with the one sorted before it is kept for the first suffix of each run only: within a run the two
suffixes are one letter further on in the same agreement, so walking along the text the length drops by one at each step
until the next sampled suffix. The lengths are streamed in text order from these samples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEPARATOR = 0xFF  # never in UTF-8


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data)] << np.uint64(56 - 8 * k)
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in sorted order, by doubling; only suffixes still tied are sorted again."""
    n = len(data)
    words = _words(data)
    order = np.argsort(words, kind="stable")
    first = np.concatenate(([True], words[order][1:] != words[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    # a suffix that ends within the eight bytes sorts before longer ones with zero bytes: ends are told apart by length
    step = 8
    slots = np.flatnonzero(~(first & np.concatenate((first[1:], [True]))))
    while len(slots):
        tied = order[slots]
        after = tied + step
        further = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((further, rank[tied]))
        tied, further = tied[by], further[by]
        old = rank[tied]
        new = np.concatenate(([True], (old[1:] != old[:-1]) | (further[1:] != further[:-1])))
        order[slots] = tied
        rank[tied] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.concatenate((new[1:], [True])))]
        step *= 2
    return order


@dataclass
class RunIndex:
    """Runs of the transform (letter, first rank), suffixes at their first and last ranks, and lengths at their first ranks."""

    size: int
    letters: np.ndarray
    heads: np.ndarray
    head_suffix: np.ndarray
    tail_suffix: np.ndarray
    head_length: np.ndarray


def build(data: np.ndarray) -> tuple[RunIndex, np.ndarray]:
    """The index of ``data`` and its suffix array, which is needed once more to read off groups."""
    order = suffix_array(data)
    before = data[order - 1].astype(np.int16)
    before[order == 0] = -1  # the letter before the text is unlike all others
    heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
    tails = np.concatenate((heads[1:], [len(data)])) - 1
    lengths = np.zeros(len(heads), np.int64)
    lengths[1:] = _agreement(_words(data), order[heads[1:] - 1], order[heads[1:]])
    return RunIndex(len(data), before[heads], heads, order[heads], order[tails], lengths), order


def _agreement(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that the suffixes at ``a`` and ``b`` have in common from their starts."""
    n = len(words)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        room = n - np.maximum(x, y)
        differ = np.where(room > 0, words[np.minimum(x, n - 1)] ^ words[np.minimum(y, n - 1)], np.uint64(1))
        same = np.full(len(live), 8)
        for k in range(7, -1, -1):  # the first byte that differs
            same[(differ >> np.uint64(56 - 8 * k)) & np.uint64(0xFF) != 0] = k
        gained = np.minimum(same, np.maximum(room, 0))
        out[live] += gained
        live = live[gained == 8]
    return out


def stream_lengths(index: RunIndex) -> np.ndarray:
    """For each position of the text, how far its suffix agrees with the one sorted before it."""
    sampled = np.zeros(index.size, np.int64)
    at = np.zeros(index.size, np.int64)
    sampled[index.head_suffix] = index.head_length
    at[index.head_suffix] = index.head_suffix
    at = np.maximum.accumulate(at)
    return sampled[at] - (np.arange(index.size) - at)


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, in the order given, which of its windows of ``length`` bytes also start earlier: in an earlier text, or before."""
    if not texts:
        return []
    data = np.frombuffer(b"".join(t + bytes([SEPARATOR]) for t in texts), np.uint8)
    index, order = build(data)
    lengths = stream_lengths(index)[order]
    opens = np.flatnonzero(np.concatenate(([True], lengths[1:] < length)))  # groups of suffixes that agree on the window
    earliest = np.minimum.reduceat(order, opens)
    group = np.repeat(earliest, np.diff(np.concatenate((opens, [len(order)]))))
    again = np.empty(len(data), bool)
    again[order] = group < order
    out, at = [], 0
    for t in texts:
        out.append(again[at : at + max(0, len(t) - length + 1)])
        at += len(t) + 1
    return out
