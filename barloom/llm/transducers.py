"""Weighted acyclic automata over sequences of 64-bit symbols, in numpy arrays.

An automaton accepts n-grams of one length and gives each its count. It has one level of states per symbol; states with the
same continuations are one state (the register is filled level by level from the last symbol, over n-grams in sorted
order), so counts cannot stand on arcs: an arc holds the number of n-grams that come before it in its state, these add up along a path to
the n-gram's place, and the counts stand in that order.
"""

from __future__ import annotations

import pickle

import numpy as np

from barloom.llm.words import mix


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def union(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted n-grams of all parts with the sums of their counts."""
    columns = [np.concatenate(c) for c in zip(*(p for p, _ in parts))]
    counts = np.concatenate([c for _, c in parts])
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = starts(*columns)
    return [c[first] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts


def narrow(x: np.ndarray) -> np.ndarray:
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(x) or x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


class Transducer:
    """``levels[j]`` is (first arc of each state, symbols, target states); the root level has one state."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], counts: np.ndarray):
        self.levels, self.counts = levels, counts

    @classmethod
    def build(cls, grams: list[np.ndarray], counts: np.ndarray) -> Transducer:
        """From distinct n-grams in sorted order, one array per place."""
        levels, target = [], np.zeros(len(counts), np.int64)
        if not len(counts):
            return cls([(np.zeros(2, np.int64), grams[0][:0], target)] * len(grams), counts)
        place = np.arange(len(counts))
        for j in range(len(grams) - 1, -1, -1):
            symbols = grams[j][place]
            first = starts(*(g[place] for g in grams[:j])) if j else np.zeros(1, np.int64)
            size = np.diff(np.append(first, len(symbols)))
            sign = np.add.reduceat(mix(symbols + mix(target.astype(np.uint64))), first)
            _, kept, state = np.unique(mix(sign) ^ size.astype(np.uint64), return_index=True, return_inverse=True)
            inside = np.arange(len(symbols)) - np.repeat(first, size)
            twin = np.repeat(first[kept][state], size) + inside
            if not ((size[kept][state] == size).all() and (symbols[twin] == symbols).all() and (target[twin] == target).all()):
                kept, state = np.arange(len(first)), np.arange(len(first))  # two signatures met by chance: no states are merged
            arcs = np.repeat(first[kept], size[kept]) + np.arange(size[kept].sum()) - np.repeat(np.cumsum(size[kept]) - size[kept], size[kept])
            levels.insert(0, (np.append(0, np.cumsum(size[kept])), symbols[arcs], target[arcs]))
            target, place = state.astype(np.int64), place[first]
        return cls(levels, counts)

    def to_bytes(self) -> bytes:
        return pickle.dumps([[(narrow(a), s, narrow(t)) for a, s, t in self.levels], narrow(self.counts)], protocol=5)

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        levels, counts = pickle.loads(data)
        return cls([(a.astype(np.int64), s, t.astype(np.int64)) for a, s, t in levels], counts.astype(np.int64))

    def grams(self) -> list[np.ndarray]:
        """All n-grams, sorted."""
        out: list[np.ndarray] = []
        state = np.zeros(1, np.int64)
        for first, symbols, target in self.levels:
            size = first[state + 1] - first[state]
            arcs = np.repeat(first[state], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out = [np.repeat(c, size) for c in out] + [symbols[arcs]]
            state = target[arcs]
        return out

    def skips(self) -> list[np.ndarray]:
        """For every arc, the n-grams before it in its state."""
        below, out = None, []
        for first, symbols, target in self.levels[::-1]:
            many = np.ones(len(symbols), np.int64) if below is None else below[target]
            sums = np.append(0, np.cumsum(many))
            out.insert(0, sums[:-1] - np.repeat(sums[first[:-1]], np.diff(first)))
            below = sums[first[1:]] - sums[first[:-1]]
        return out

    def compose(self, asked: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The places and counts of the asked n-grams (any order); -1 and 0 for others."""
        n = len(asked[0])
        state, place, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        if not len(self.counts):
            return place - 1, place
        for (first, symbols, target), skip, x in zip(self.levels, self.skips(), asked):
            low, end = first[state], first[state + 1]
            high = end
            while (low < high).any():
                mid = (low + high) // 2
                less = (low < high) & (symbols[np.minimum(mid, len(symbols) - 1)] < x)
                low, high = np.where(less, mid + 1, low), np.where(less, high, np.minimum(high, mid))
            at = np.minimum(low, len(symbols) - 1)
            alive &= (low < end) & (symbols[at] == x)
            at = np.where(alive, at, 0)
            place, state = place + np.where(alive, skip[at], 0), np.where(alive, target[at], 0)
        return np.where(alive, place, -1), np.where(alive, self.counts[np.where(alive, place, 0)], 0)
