"""An order of pieces by their content.

A piece is the sketch of its weighted terms: a random projection of the rare
ones above all. A tree that splits a bounded sample of sketches in two, again and
again, gives every piece the number of its leaf; inside a leaf, signs of what
differs from the leaf's mean order on. Pieces of similar content come next to
each other from anywhere in the corpus, in one pass without joins, and a group of
any size is a stretch of the order that can be cut anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 256
SAMPLE = 16_384
# Leaves hold at least so many pieces of the sample.
LEAF = 8
REST_BITS = 16
_TERMS = 1 << 16
# A term counts by the square of its idf, and by its frequency with saturation.
_SATURATION = 1.2


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    drawn = np.random.default_rng(12).integers(0, 2, (_TERMS, DIMENSIONS), dtype=np.int8)
    return (drawn * 2 - 1).astype(np.float32)


def term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms in order and how often each occurs. Ids of 16 bits are sorted
    by their digits, which a stable sort does."""
    ordered = np.sort(ids, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
    return ordered[begins], np.diff(np.append(begins, len(ordered)))


def sketch(ids: np.ndarray, idf: np.ndarray, signs: np.ndarray) -> np.ndarray:
    terms, n = term_counts(ids)
    weight = (idf[terms] ** 2 * n / (n + _SATURATION)).astype(np.float32)
    v = weight @ signs[terms]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


@dataclass(frozen=True)
class LexicalTree:
    """``below`` are the two children of each node, leaves as -1 - their number."""

    direction: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    mean: np.ndarray

    def codes(self, sketches: np.ndarray) -> np.ndarray:
        """Leaf number, then the signs of the rest."""
        at = np.zeros(len(sketches), dtype=np.int64) if len(self.below) else np.full(len(sketches), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            side = np.einsum("ij,ij->i", sketches[open_], self.direction[node]) > self.threshold[node]
            at[open_] = self.below[node, side.astype(np.int64)]
        leaf = -1 - at
        planes = np.random.default_rng(13).standard_normal((DIMENSIONS, REST_BITS))
        signs = (sketches - self.mean[leaf]) @ planes > 0
        return (leaf << REST_BITS) | (signs @ (1 << np.arange(REST_BITS)[::-1]))


def _split(x: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Direction and threshold that part ``x`` in two: along the main direction
    where two groups differ most, neither below a tenth, then by rounds of
    2-means while neither falls below a twentieth. None if all rows are the same."""
    centred = x - x.mean(axis=0)
    spread = np.einsum("ij,ij->i", centred, centred)
    v = centred[int(spread.argmax())]
    for _ in range(8):
        v = (centred @ v) @ centred
        size = float(np.sqrt(v @ v))
        if size < 1e-9:
            return None
        v = v / size
    p = np.sort(x @ v)
    n, least = len(p), max(1, len(p) // 10)
    i = np.arange(least, n - least + 1)
    i = i[p[i - 1] < p[i]]
    if not len(i):
        return None
    sums = np.cumsum(p, dtype=np.float64)
    gap = (sums[-1] - sums[i - 1]) / (n - i) - sums[i - 1] / i
    best = int(i[int((i * (n - i) * gap**2).argmax())])
    cut = float((p[best - 1] + p[best]) / 2)
    right = x @ v > cut
    for _ in range(6):
        if not right.any() or right.all():
            break
        a, b = x[~right].mean(axis=0), x[right].mean(axis=0)
        now = x @ (b - a) > (b @ b - a @ a) / 2
        if min(now.sum(), (~now).sum()) < max(1, n // 20):
            break
        v, cut = b - a, float((b @ b - a @ a) / 2)
        if (now == right).all():
            break
        right = now
    return v, cut


def build_tree(sketches: np.ndarray) -> LexicalTree:
    direction, threshold, below, mean = [], [], [], []

    def grow(x: np.ndarray) -> int:
        found = _split(x) if len(x) >= 2 * LEAF else None
        right = x @ found[0] > found[1] if found else np.zeros(len(x), dtype=bool)
        if not right.any() or right.all():
            mean.append(x.mean(axis=0) if len(x) else np.zeros(DIMENSIONS, dtype=np.float32))
            return -len(mean)
        node = len(below)
        direction.append(found[0])
        threshold.append(found[1])
        below.append([0, 0])
        below[node] = [grow(x[~right]), grow(x[right])]
        return node

    grow(sketches)
    return LexicalTree(
        np.array(direction, dtype=np.float32).reshape(-1, DIMENSIONS), np.array(threshold),
        np.array(below, dtype=np.int64).reshape(-1, 2), np.array(mean, dtype=np.float32),
    )


def with_codes(pieces: DataFrame, idf: np.ndarray, n_pieces: int) -> DataFrame:
    """``pieces`` (nth, tail and more) with ``code``, their place in the order."""
    idf = idf.astype(np.float32)

    def sketches_of(batch, signs: np.ndarray) -> np.ndarray:
        rows = [sketch(np.frombuffer(t.as_buffer(), "<u2"), idf, signs) for t in batch["tail"]]
        return np.array(rows, dtype=np.float32).reshape(-1, DIMENSIONS)

    def sample(batches):
        import pyarrow as pa

        signs = _signs()
        for batch in batches:
            rows = [x.tobytes() for x in sketches_of(batch, signs)]
            yield pa.RecordBatch.from_arrays(
                [batch["nth"], pa.array(rows, pa.binary())], ["nth", "sketch"]
            )

    every = max(1, -(-n_pieces // SAMPLE))
    drawn = pieces.where(F.pmod(F.xxhash64("nth", F.lit(11)), F.lit(every)) == 0)
    # About ``SAMPLE`` sketches of 1 KB, as one block of memory.
    rows = drawn.select("nth", "tail").mapInArrow(sample, "nth bigint, sketch binary").toArrow()
    data = b"".join(x.as_buffer() for x in rows.sort_by("nth")["sketch"])
    tree = build_tree(np.frombuffer(data, np.float32).reshape(-1, DIMENSIONS))

    def place(batches):
        import pyarrow as pa

        signs = _signs()
        for batch in batches:
            codes = pa.array(tree.codes(sketches_of(batch, signs)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, codes], [*batch.schema.names, "code"]
            )

    kinds = ", ".join(f"{name} {kind}" for name, kind in pieces.dtypes)
    return pieces.mapInArrow(place, f"{kinds}, code bigint")
