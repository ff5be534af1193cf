"""Spherical-cap filters: structured random product codes and their list decoding.

A filter is a direction on the unit sphere; it takes all vectors whose inner product with it reaches
a bar.  The directions form a product code: the space, turned at random, is cut into parts, each part
has its own short list of random words, and one word of each part makes a direction.  The directions
that a vector reaches are enumerated part by part, leaving out what the best words of the later
parts could not lift over the bar.

How well a code covers the sphere differs from place to place.  So there are several codes, turned
independently, and a vector that reaches the bar less than LEAST times in a code has its bar lowered
until it does.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np

#: Vectors are padded with zeros to so many components at least.
LEAST_WIDTH = 8
#: Unrelated vectors that a filter should take, and their largest share.
PER_FILTER, LARGEST_SHARE = 64, 0.02
#: Filters that two vectors at the threshold share on average, in all codes.
SHARED, CODES = 10.0, 4
#: Filters of a code that every vector enters at least, and the steps by which its bar is lowered.
LEAST, STEP = 4, 0.02
_GRID = 20_001


def _density(width: int, u: np.ndarray) -> np.ndarray:
    """Of one coordinate of a random unit vector, not normed."""
    return np.maximum(0.0, 1 - u * u) ** ((width - 3) / 2)


def _integral(y: np.ndarray, x: np.ndarray) -> float:
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


def cap_share(width: int, bar: float) -> float:
    """Share of the sphere whose coordinate along a direction is ``bar`` or more."""
    whole, above = np.linspace(-1, 1, _GRID), np.linspace(bar, 1, _GRID)
    return _integral(_density(width, above), above) / _integral(_density(width, whole), whole)


def shared_share(width: int, bar: float, cosine: float) -> float:
    """Share of the directions that take both of two vectors with this cosine."""
    whole, above = np.linspace(-1, 1, _GRID), np.linspace(bar, 1, _GRID)[:-1]
    rest = np.cumsum(_density(width - 1, whole)[::-1])[::-1]
    need = (bar - cosine * above) / np.sqrt((1 - cosine**2) * (1 - above**2))
    other = np.interp(need, whole, rest / rest[0])
    return _integral(_density(width, above) * other, above) / _integral(_density(width, whole), whole)


def _solved(value, goal: float) -> float:
    """The bar at which the falling function ``value`` reaches ``goal``."""
    low, high = 0.0, 0.999
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) > goal else (low, middle)
    return low


@dataclass(frozen=True)
class Plan:
    """CODES codes of ``words ** parts`` directions of ``width`` components, and the bar."""

    width: int
    parts: int
    words: int
    bar: float

    @staticmethod
    def of(vectors: int, width: int, cosine: float) -> Plan:
        """Few enough unrelated vectors in a filter, enough filters for a pair at ``cosine``."""
        wide = max(width, LEAST_WIDTH)
        bar = _solved(lambda b: cap_share(wide, b), min(LARGEST_SHARE, PER_FILTER / max(vectors, 1)))
        filters = SHARED / CODES / shared_share(wide, bar, cosine)
        parts = 2 if filters <= 1 << 12 else 3 if filters <= 1 << 30 else 4
        return Plan(wide, parts, max(4, math.ceil(filters ** (1 / parts))), bar)


class Code:
    """The directions of one code, turned by its ``seed``."""

    def __init__(self, plan: Plan, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.plan, self.first = plan, seed * plan.words**plan.parts
        self.turn = np.linalg.qr(rng.standard_normal((plan.width, plan.width)))[0]
        parts = np.array_split(np.arange(plan.width), plan.parts)
        self.cuts = np.cumsum([len(part) for part in parts])[:-1]
        self.words = []
        for part in parts:
            words = rng.standard_normal((plan.words, len(part)))
            self.words.append(words / np.linalg.norm(words, axis=1, keepdims=True) / math.sqrt(plan.parts))

    def reached(self, scores: list[np.ndarray], bars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the filters they reach, ascending."""
        best = [s.max(axis=1) for s in scores]
        row, name, sums = np.arange(len(bars)), np.zeros(len(bars), np.int64), np.zeros(len(bars))
        for i, score in enumerate(scores):
            need = bars - sum(best[i + 1 :], np.zeros(len(bars))) - 1e-12
            so_far = sums[:, None] + score[row]
            at, word = np.nonzero(so_far >= need[row][:, None])
            row, name, sums = row[at], name[at] * self.plan.words + word, so_far[at, word]
        return row, name + self.first

    def filters(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the filters each enters, ascending."""
        turned = np.split(units @ self.turn, self.cuts, axis=1)
        scores = [part @ words.T for part, words in zip(turned, self.words)]
        bars, left, found = np.full(len(units), self.plan.bar), np.arange(len(units)), []
        least = min(LEAST, self.plan.words**self.plan.parts)
        while len(left):
            row, name = self.reached([s[left] for s in scores], bars[left])
            enough = np.bincount(row, minlength=len(left)) >= least
            found.append((left[row[enough[row]]], name[enough[row]]))
            left = left[~enough]
            bars[left] -= STEP
        rows, names = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((names, rows))
        return rows[order], names[order]


@functools.cache
def codes(plan: Plan) -> list[Code]:
    return [Code(plan, seed) for seed in range(CODES)]


def filters(plan: Plan, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the filters of all codes that each unit vector enters, ascending."""
    if units.shape[1] < plan.width:
        units = np.pad(units, ((0, 0), (0, plan.width - units.shape[1])))
    rows, names = (np.concatenate(x) for x in zip(*(code.filters(units) for code in codes(plan))))
    order = np.argsort(rows, kind="stable")
    return rows[order], names[order]
