"""Minimal acyclic transducers: sorted words in, their lexicographic ordinals out.

States that accept the same endings are one state.  Every arc puts out how many words of its state
come before those behind it, so the sum along a word is its place among all words.  Arcs lie in a
hash table over state and byte, so that all words of a buffer take their next step together.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _closed(words: Iterable[bytes]) -> list[tuple[bool, tuple[tuple[int, int], ...]]]:
    """The states of the minimal automaton, each after those its arcs lead to; the root is last."""
    known: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}
    path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]  # the open states of the last word
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            state = known.setdefault((final[0], tuple(arcs)), len(known))
            path[-1][1].append((last[len(path) - 1], state))

    for word in words:
        n = min(len(word), len(last))
        shared = n if word[:n] == last[:n] else next(i for i in range(n) if word[i] != last[i])
        close(shared)
        path += [([False], []) for _ in range(len(word) - shared)]
        path[-1][0][0] = True
        last = word
    close(0)
    return [*known, (path[0][0][0], tuple(path[0][1]))]


class Transducer:
    """Ordinals of ``words``: distinct byte strings that are not empty, in ascending order."""

    def __init__(self, words: Iterable[bytes]) -> None:
        states = _closed(words)
        below: list[int] = []
        keys, targets, outputs = [], [], []
        for state, (final, arcs) in enumerate(states):
            n = int(final)
            for byte, target in arcs:
                keys.append(state << 8 | byte)
                targets.append(target)
                outputs.append(n)
                n += below[target]
            below.append(n)
        self.root, self.size = len(states) - 1, below[-1]
        self.final = np.fromiter((f for f, _ in states), bool, len(states))
        self._hash(np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32))

    def _hash(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.targets, self.outputs = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            first = np.unique(at, return_index=True)[1]
            first = first[self.keys[at[first]] == -1]
            own = left[first]
            self.keys[at[first]], self.targets[at[first]], self.outputs[at[first]] = keys[own], targets[own], outputs[own]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def _arcs(self, keys: np.ndarray) -> np.ndarray:
        """The places of the arcs, -1 where there is none."""
        at = self._home(keys)
        held = self.keys.take(at)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held[open_] = self.keys[at[open_]]
            open_ = open_[(held[open_] != keys[open_]) & (held[open_] != -1)]
        return np.where(held == keys, at, -1)

    def ordinals(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinal of each word ``buffer[start:end]``, -1 of those not known."""
        found = np.full(len(starts), -1, np.int64)
        word, at, left = np.arange(len(starts)), np.asarray(starts, np.int64), np.asarray(ends - starts, np.int64)
        state, total = np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64)
        while len(word):
            arc = self._arcs(state << 8 | buffer.take(at))
            on = np.flatnonzero(arc >= 0)
            arc, word, left = arc.take(on), word.take(on), left.take(on) - 1
            state, total = self.targets.take(arc).astype(np.int64), total.take(on) + self.outputs.take(arc)
            over = left == 0
            known = np.flatnonzero(over & self.final.take(state))
            found[word.take(known)] = total.take(known)
            more = np.flatnonzero(~over)
            word, left, state, total = word.take(more), left.take(more), state.take(more), total.take(more)
            at = at.take(on.take(more)) + 1
        return found
