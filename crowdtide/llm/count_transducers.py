"""Weighted acyclic automata that map sequences of at most four words to counts.

A transducer is built from windows: the up to four words that begin at some place of a text, with
the number of times they do. Reading a sequence from the root, the weight of the last arc is the
count of all windows that begin with it, so one transducer counts sequences of every length. Windows
come in sorted order; states are closed from the last words to the first, and a closed state with
the same arcs, weights and targets as an earlier one is replaced by it, so that endings are shared.

Arcs lie in arrays, a level per word, sorted by state and word.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

DEPTH = 4


@dataclass
class Level:
    """Arcs of all states of a depth: those of state ``s`` are ``starts[s]`` to ``starts[s + 1]``."""

    starts: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    target: np.ndarray


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of some stretches, one stretch after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _mixed(*columns: np.ndarray) -> np.ndarray:
    """A hash of 64 bits per row."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB) ^ (h >> np.uint64(32))


def sorted_windows(windows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in order, and their (summed) counts."""
    if not len(windows):
        return windows, np.zeros(0, np.int64)
    base = int(windows.max()) + 1
    halves = [windows[:, d].astype(np.int64) * base + windows[:, d + 1] for d in (0, 2)]
    order = np.lexsort(halves[::-1])
    halves = [h[order] for h in halves]
    changed = np.ones(len(order), bool)
    changed[1:] = (halves[0][1:] != halves[0][:-1]) | (halves[1][1:] != halves[1][:-1])
    starts = np.flatnonzero(changed)
    summed = np.add.reduceat(np.ones(len(order), np.int32) if counts is None else counts[order], starts, dtype=np.int64)
    del order, changed
    different = np.empty((len(starts), DEPTH), np.int32)
    for d, half in zip((0, 2), halves):
        half = half[starts]
        different[:, d] = half // base
        different[:, d + 1] = half % base
    return different, summed


class CountTransducer:
    """``words`` are sorted byte strings, numbered from 1; 0 in a window stands for no word."""

    def __init__(self, words: list[bytes], levels: list[Level]):
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, words: list[bytes], windows: np.ndarray, counts: np.ndarray, share: bool = True) -> CountTransducer:
        """From different windows in order; ``share`` merges equal endings."""
        n, new, arcs, parents = len(windows), np.zeros(len(windows), bool), [], []
        if n:
            new[0] = True
        above = None
        for d in range(DEPTH):
            column = windows[:, d]
            new = new | np.concatenate([new[:1], column[1:] != column[:-1]])
            begins = np.flatnonzero(new)
            weight = np.add.reduceat(counts, begins) if n else counts
            real = column[begins] != 0
            parents.append((np.cumsum(above)[begins] - 1)[real] if d else np.zeros(int(real.sum()), np.int64))
            arcs.append((column[begins][real].astype(np.int64), weight[real]))
            above = np.zeros(n, np.int64)
            above[begins[real]] = 1
        levels: list[Level] = [None] * DEPTH
        target = np.zeros(len(arcs[-1][0]), np.int64)
        for d in range(DEPTH - 1, -1, -1):
            word, weight = arcs[d]
            states = len(arcs[d - 1][0]) if d else 1
            sizes = np.bincount(parents[d], minlength=states)
            starts = np.cumsum(sizes) - sizes
            state_of = np.arange(states)
            if share and d and states:
                chosen, state_of = cls._registered(parents[d], states, word, weight, target)
                places = _ragged(starts[chosen], sizes[chosen])
                word, weight, target, sizes = word[places], weight[places], target[places], sizes[chosen]
            edges = np.concatenate([[0], np.cumsum(sizes)])
            levels[d] = Level(edges, word, weight, target)
            target = state_of
        return cls(words, levels)

    @staticmethod
    def _registered(parent, states, word, weight, target) -> tuple[np.ndarray, np.ndarray]:
        """The first of every kind of state, and the kind of every state, by 128 bits of their arcs."""
        marks = []
        for salt in (1, 2):
            total = np.zeros(states, np.uint64)
            mixed = _mixed(np.full(len(word), salt), word, weight, target)
            begins = np.flatnonzero(np.diff(parent, prepend=-1))
            if len(begins):
                total[parent[begins]] = np.add.reduceat(mixed, begins)
            marks.append(total)
        _, chosen, kind = np.unique(marks[0], return_index=True, return_inverse=True)
        if (marks[1][chosen][kind] != marks[1]).any():  # two kinds of one mark
            return np.arange(states), np.arange(states)
        return chosen, kind

    def paths(self, least: int = 1, depth: int = DEPTH) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per length: the sequences with a weight of ``least`` or more, their weights, and how many windows end there."""
        rows, state = np.zeros((1, 0), np.int64), np.zeros(1, np.int64)
        for d in range(depth):
            level = self.levels[d]
            sizes = np.diff(level.starts)[state]
            places = _ragged(level.starts[state], sizes)
            rows = np.column_stack([np.repeat(rows, sizes, axis=0), level.word[places]])
            weight, state = level.weight[places].astype(np.int64), level.target[places].astype(np.int64)
            if least > 1:
                heavy = weight >= least
                rows, weight, state = rows[heavy], weight[heavy], state[heavy]
            if d + 1 < DEPTH:
                below = self.levels[d + 1]
                sums = np.concatenate([[0], np.cumsum(below.weight, dtype=np.int64)])
                ending = weight - (sums[below.starts[state + 1]] - sums[below.starts[state]])
            else:
                ending = weight
            yield rows, weight, ending

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The windows that the transducer was built from, in no order, and their counts."""
        found = [
            (np.pad(rows[ending > 0], ((0, 0), (0, DEPTH - rows.shape[1]))), ending[ending > 0])
            for rows, _, ending in self.paths()
        ]
        return np.concatenate([w for w, _ in found]).astype(np.int32), np.concatenate([c for _, c in found])

    @property
    def total(self) -> int:
        """Number of windows."""
        return int(self.levels[0].weight.sum())

    def compose(self, other: CountTransducer) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per length, the sequences of this automaton and their weights in the other (0: none).

        The pairs of states that both can reach are followed level by level.
        """
        number = {w: i for i, w in enumerate(other.words, 1)}
        as_other = np.array([0, *(number.get(w, 0) for w in self.words)], np.int64)
        rows, state, beyond, found = np.zeros((1, 0), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), []
        for level, there in zip(self.levels, other.levels):
            sizes = np.diff(level.starts)[state]
            places = _ragged(level.starts[state], sizes)
            rows = np.column_stack([np.repeat(rows, sizes, axis=0), level.word[places]])
            wanted, beyond = as_other[level.word[places]], np.repeat(beyond, sizes)
            base = len(other.words) + 1
            keys = np.repeat(np.arange(len(there.starts) - 1), np.diff(there.starts)) * base + there.word
            key = beyond * base + wanted
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            met = (keys[at] == key) & (wanted > 0) & (beyond >= 0) if len(keys) else np.zeros(len(key), bool)
            weight = np.where(met, there.weight[at] if len(keys) else 0, 0)
            beyond = np.where(met, there.target[at] if len(keys) else -1, -1)
            state = level.target[places].astype(np.int64)
            found.append((rows, weight))
        return found

    def dump(self) -> bytes:
        levels = [[_narrow(x) for x in (np.diff(v.starts), v.word, v.weight, v.target)] for v in self.levels]
        return pickle.dumps((self.words, levels), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> CountTransducer:
        words, levels = pickle.loads(data)
        return cls(words, [Level(np.concatenate([[0], np.cumsum(v[0], dtype=np.int64)]), *v[1:]) for v in levels])


def union(parts: Iterable[CountTransducer]) -> CountTransducer:
    """One transducer of the windows of all, with their counts summed."""
    parts = list(parts)
    words = sorted(set().union(*(p.words for p in parts)))
    number = {w: i for i, w in enumerate(words, 1)}
    rows, counts = [np.zeros((0, DEPTH), np.int32)], [np.zeros(0, np.int64)]
    for p in parts:
        own = np.array([0, *(number[w] for w in p.words)], np.int32)
        windows, times = p.windows()
        rows.append(own[windows])
        counts.append(times)
    return CountTransducer.build(words, *sorted_windows(np.concatenate(rows), np.concatenate(counts)))
