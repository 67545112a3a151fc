"""DartMinHash signatures of weighted sets, with numpy.

Darts fall on every element's region [0, weight) x [0, infinity) as a Poisson
process that depends on the element alone. A dart has a rank and a coordinate;
the signature keeps, per coordinate, the dart of least rank. Two sets agree on a
coordinate with the probability of their weighted Jaccard similarity. Darts are
thrown rank by rank until every coordinate has one, so the work for a set of n
elements is about n + k log k instead of n times k.
"""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64
# Odd constants of a 64-bit finaliser (fixed values).
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_STEP = _U(0x9E3779B97F4A7C15)
# Widths of the first rank cells; every later cell has width 1.
_FIRST = (1 / 16, 1 / 16, 1 / 8, 1 / 4, 1 / 2)
_GRID = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _MIX[0]
    x = x ^ (x >> _U(27))
    x = x * _MIX[1]
    return x ^ (x >> _U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def _poisson_table(rate: float) -> np.ndarray:
    terms, term = [], math.exp(-rate)
    for i in range(24):
        terms.append(term)
        term *= rate / (i + 1)
    return np.cumsum(terms)


_TABLES = {w: _poisson_table(w) for w in (*_FIRST, 1.0)}


def _cell(i: int) -> tuple[float, float]:
    """Lower end and width of rank cell ``i``."""
    if i < len(_FIRST):
        return sum(_FIRST[:i]), _FIRST[i]
    return float(i - len(_FIRST) + 1), 1.0


def _cells_below(rank: float) -> int:
    i = 0
    while _cell(i)[0] < rank and i < len(_FIRST):
        i += 1
    return i if i < len(_FIRST) else len(_FIRST) + max(0, math.ceil(rank) - 1)


class DartMinHash:
    def __init__(self, k: int, seed: int = 1):
        self.k = k
        self.seed = mix(np.array([seed], dtype=_U))[0]

    def signature(self, elements: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """The winning darts, one 64-bit name per coordinate. ``elements`` are
        distinct 64-bit hashes; weights are positive, 1 each where not given."""
        elements = mix(elements.astype(_U) ^ self.seed)
        if weights is None:
            parts, total = None, float(len(elements))
        else:
            # A weight above 1 is a column of unit regions, the last one partial.
            heights = np.ceil(weights).astype(np.int64)
            level = np.arange(heights.sum()) - np.repeat(np.cumsum(heights) - heights, heights)
            parts = np.minimum(np.repeat(weights, heights) - level, 1.0)
            elements = mix(np.repeat(elements, heights) + level.astype(_U) * _STEP)
            total = float(weights.sum())
        rank = np.full(self.k, np.inf)
        name = np.zeros(self.k, dtype=_U)
        done, upto = 0, max(1, _cells_below(self.k * (math.log(self.k) + 2) / total))
        while True:
            self._throw(elements, parts, done, upto, rank, name)
            if np.isfinite(rank).all():
                return name
            done, upto = upto, upto + max(1, upto // 2)

    def _throw(self, elements, parts, first: int, last: int, rank, name) -> None:
        n = len(elements)
        for lo in range(0, n, _GRID):
            some = elements[lo : lo + _GRID]
            part = None if parts is None else parts[lo : lo + _GRID]
            per = max(1, _GRID // len(some))
            for c in range(first, last, per):
                self._throw_grid(some, part, range(c, min(last, c + per)), rank, name)

    def _throw_grid(self, elements, parts, cells: range, rank, name) -> None:
        bounds = [_cell(c) for c in cells]
        offsets = (np.arange(cells.start, cells.stop) + 1).astype(_U) * _STEP
        cell_hash = mix(elements[:, None] + offsets[None, :])
        u = _uniform(cell_hash)
        counts = np.empty(u.shape, dtype=np.int64)
        for j, (_, width) in enumerate(bounds):
            if width < 1.0:
                counts[:, j] = np.searchsorted(_TABLES[width], u[:, j], side="right")
            else:
                counts[:, j:] = np.searchsorted(_TABLES[1.0], u[:, j:], side="right")
                break
        flat = counts.ravel()
        hit = np.flatnonzero(flat)
        if not len(hit):
            return
        times = flat[hit]
        where = np.repeat(hit, times)
        nth = np.arange(len(where)) - np.repeat(np.cumsum(times) - times, times)
        dart = mix(cell_hash.ravel()[where] ^ mix((nth + 1).astype(_U) * _STEP))
        row, col = np.divmod(where, len(bounds))
        low = np.array([b[0] for b in bounds])[col]
        width = np.array([b[1] for b in bounds])[col]
        at = low + width * _uniform(mix(dart + _STEP))
        if parts is not None:
            inside = _uniform(mix(dart + _STEP + _STEP)) < parts[row]
            dart, at = dart[inside], at[inside]
        coordinate = (mix(dart ^ _STEP) % _U(self.k)).astype(np.int64)
        # Later assignments win, so the least rank comes last.
        order = np.argsort(-at, kind="stable")
        best_at, best_name = np.full(self.k, np.inf), np.zeros(self.k, dtype=_U)
        best_at[coordinate[order]] = at[order]
        best_name[coordinate[order]] = dart[order]
        better = best_at < rank
        rank[better] = best_at[better]
        name[better] = best_name[better]
