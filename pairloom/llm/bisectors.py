"""Clustering of vectors around centroids by a tournament of bisectors.

For two centroids the points nearer to one than to the other lie on one side of
a plane, whose integer normal and threshold are computed once a round. A vector
plays the centroids in order: the sign of one linear test tells which of the
champion and the next one is farther and drops out, and zero keeps the smaller
number. After k - 1 tests the champion is the nearest, and its distance alone is
computed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import field, packed, written

DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
# Components up to this size keep every product, and the distance of any two
# vectors of 64 of them, inside 64 bits.
MOST = 1 << 27
_BATCH = 4_096


@dataclass(frozen=True)
class Bisectors:
    """For centroids i < j: j is nearer to x than i just where
    ``x . normal[i, j] > threshold[i, j]``."""

    centroids: np.ndarray
    normal: np.ndarray
    threshold: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Bisectors:
        squares = np.einsum("ij,ij->i", centroids, centroids)
        # Half of both sides of 2 x (c_j - c_i) > |c_j|^2 - |c_i|^2: for integers, the
        # left side exceeds the half just where it exceeds its floor.
        return cls(
            centroids,
            centroids[None, :, :] - centroids[:, None, :],
            (squares[None, :] - squares[:, None]) // 2,
        )

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid, and the squared distance to it."""
        champion = np.zeros(len(x), dtype=np.int64)
        for challenger in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", x, self.normal[champion, challenger])
            champion[side > self.threshold[champion, challenger]] = challenger
        rest = x - self.centroids[champion]
        return champion, np.einsum("ij,ij->i", rest, rest)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``nth``, ``vec_id``, ``rank_hash`` and ``q``, the scaled components as 32-bit
    integers in one binary, of the rows that take part."""
    rows = packed(vectors).select(
        field(id_col).alias("vec_id"), field(vector_col).cast("array<double>").alias("v")
    )
    scaled = F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE))))
    fits = F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(MOST // SCALE)))
    )
    said = F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    kept = rows.where((F.size("v") == DIMENSIONS) & fits).select(
        F.monotonically_increasing_id().alias("nth"), "vec_id",
        F.sha2(said, 256).alias("rank_hash"), scaled.alias("q"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["q"].flatten().to_numpy(zero_copy_only=False).astype("<i4")
            q = [r.tobytes() for r in flat.reshape(-1, DIMENSIONS)]
            yield pa.RecordBatch.from_arrays(
                [batch["nth"], batch["vec_id"], batch["rank_hash"], pa.array(q, pa.binary())],
                batch.schema.names,
            )

    kind = dict(kept.dtypes)["vec_id"]
    return kept.mapInArrow(pack, f"nth bigint, vec_id {kind}, rank_hash string, q binary")


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the least hashes; equal hashes by their components."""
    first = rows.orderBy("rank_hash", "q").limit(k).select("q").collect()
    return np.array([np.frombuffer(r.q, "<i4") for r in first], dtype=np.int64).reshape(-1, DIMENSIONS)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, batch.num_rows, _BATCH):
        part = batch["q"].slice(at, _BATCH)
        data = b"".join(x.as_buffer() for x in part)
        yield at, np.frombuffer(data, "<i4").reshape(-1, DIMENSIONS).astype(np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors moved to the floor of their mean. A task
    sends a row per centroid; the driver sees one row per centroid."""
    bisectors, k = Bisectors.of(centroids), len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(k, dtype=np.int64)
        sums = np.zeros((k, DIMENSIONS), dtype=np.int64)
        for batch in batches:
            for _, x in _matrices(batch):
                cluster, _ = bisectors.nearest(x)
                count += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, x)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(count[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    parts = rows.select("q").mapInArrow(add, "cluster bigint, n bigint, sums array<bigint>")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIMENSIONS)]
    after = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
        after[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(DIMENSIONS)]
    return after


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``
    and ``centroid_sha256``, one row per vector that takes part.

    Components become ``floor(256 * x)``. Vectors take part that have 64 components,
    none null or not finite, nor of 2^19 or more in size, whose squared distances
    would not fit 64 bits. Centroids start as the ``k`` vectors with the least
    SHA-256 of ``2:<id>`` (a null id counts as empty; equal ids go by their
    components), or as all of them where there are fewer. Repeated rows are vectors
    of their own. No vectors give an empty result.
    """
    rows = written(integer_vectors(vectors, id_col, vector_col), "vectors")
    centroids = first_centroids(rows, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids)
    bisectors = Bisectors.of(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bisectors.nearest(x) for _, x in _matrices(batch)]
            cluster, distance = (
                np.concatenate([f[i] for f in found] or [np.zeros(0, dtype=np.int64)]) for i in (0, 1)
            )
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["vec_id", "cluster", "distance"],
            )

    kind = dict(rows.dtypes)["vec_id"]
    placed = written(
        rows.select("vec_id", "q").mapInArrow(place, f"vec_id {kind}, cluster int, distance bigint"),
        "placed",
    )
    # One row per centroid, at most ``k``.
    inertia = [
        (r.cluster, int(r.spread))
        for r in placed.groupBy("cluster")
        .agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("spread"))
        .collect()
    ]
    whole = sum(spread for _, spread in inertia)
    told = [
        (c, spread, whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for c, spread in inertia
    ]
    about = vectors.sparkSession.createDataFrame(
        told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return placed.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
