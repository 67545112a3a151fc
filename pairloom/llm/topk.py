"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block, and no score is
moved: a pass sends score histograms instead. Global counts per query locate the
bin of the k-th score, the next pass cuts that bin alone into as many finer ones,
until bins are single scores and the k-th score is known. A last pass keeps what lies above it and, of what equals it, the
smallest ids. A task's histogram of a query ends at the bin of its own k-th
score, because the global k-th score is never below that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import field, packed, written

K = 20
SCALE = 64
EVERY = 20
QUERY_BLOCK = 4_096
CANDIDATE_BLOCK = 4_096
BINS = 1_024
# Rows and columns of one matrix product.
_TILE = 512


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of every component, as doubles.
    Rows without id, without vector, or with a null or non-finite component are
    left out."""
    rows = packed(vectors).select(
        field(id_col).cast("bigint").alias("vec_id"), field(vector_col).cast("array<double>").alias("v")
    )
    fine = F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = rows.where("vec_id is not null and v is not null").where(fine)
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))


def _n_blocks(rows: DataFrame, size: int) -> int:
    return max(1, -(-rows.count() // size))


def _blocks(rows: DataFrame, block: str, size: int, spread: Column) -> DataFrame:
    """One row per block: ids and vectors, a bounded number of each where the hash
    of ``spread`` differs from row to row."""
    by_hash = F.pmod(F.xxhash64(spread), F.lit(_n_blocks(rows, size))).cast("int")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        width = max(map(len, part["v"]), default=0)
        m = np.zeros((len(part), width))
        for i, v in enumerate(part["v"]):
            m[i, : len(v)] = v
        return pd.DataFrame(
            [(int(part["block"].iloc[0]), width, part["vec_id"].to_numpy("<i8").tobytes(), m.tobytes())],
            columns=["block", "width", "ids", "matrix"],
        )

    packed_rows = rows.withColumn("block", by_hash).groupBy("block").applyInPandas(
        pack, "block int, width int, ids binary, matrix binary"
    )
    return packed_rows.toDF(block, f"{block}_width", f"{block}_ids", f"{block}_matrix")


def _unpacked(ids: bytes, matrix: bytes, width: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, dtype="<i8")
    m = np.frombuffer(matrix).reshape(len(ids), width)
    return ids, np.pad(m, ((0, 0), (0, wide - width)))


def _tiles(frames: Iterator[pd.DataFrame]):
    """(query ids, candidate ids, scores) of every tile; a query's own row
    scores minus infinity. Missing components count as zero."""
    for frame in frames:
        for r in frame.itertuples(index=False):
            wide = max(r.q_width, r.c_width)
            q_ids, q = _unpacked(r.q_ids, r.q_matrix, r.q_width, wide)
            c_ids, c = _unpacked(r.c_ids, r.c_matrix, r.c_width, wide)
            # Sums of products below 2^24 are exact in single precision.
            top = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(wide, 1)
            if top < 1 << 24:
                q, c = q.astype(np.float32), c.astype(np.float32)
            for i in range(0, len(q_ids), _TILE):
                s = q[i : i + _TILE] @ c.T
                s[q_ids[i : i + _TILE, None] == c_ids[None, :]] = -np.inf
                yield r, q_ids[i : i + _TILE], c_ids, s


def _histogram(k: int, width: float):
    """First pass: per query the counts of its upper bins. A bin is an integer
    multiple of ``width``."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, q_ids, _, s in _tiles(frames):
            m = min(k, s.shape[1])
            best = np.partition(s, s.shape[1] - m, axis=1)[:, -m:]
            own = np.floor(best.min(axis=1) / width)
            row, col = np.nonzero(s >= np.where(np.isfinite(own), own, -(2.0**53))[:, None] * width)
            keep = np.isfinite(s[row, col])
            bins = np.floor(s[row, col][keep].astype(np.float64) / width).astype(np.int64)
            yield _summed(q_ids[row[keep]], bins)

    return count


def _refined(step: float):
    """Further passes: per query the counts of the parts of its bin, each ``step``
    wide; a part is its number from the bin's lower end."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, q_ids, _, s in _tiles(frames):
            low, high = _limits(r, q_ids)
            row, col = np.nonzero((s >= low[:, None]) & (s < high[:, None]))
            parts = (s[row, col].astype(np.float64) - low[row]) // step
            yield _summed(q_ids[row], parts.astype(np.int64))

    return count


def _limits(r, q_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(r.l_ids, dtype="<i8")
    at = np.searchsorted(ids, q_ids)
    return np.frombuffer(r.l_low)[at], np.frombuffer(r.l_high)[at]


def _summed(q_ids: np.ndarray, bins: np.ndarray) -> pd.DataFrame:
    frame = pd.DataFrame({"query_id": q_ids, "bin": bins})
    return frame.groupby(["query_id", "bin"], as_index=False, sort=False).size().rename(columns={"size": "n"})


def _above(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Last pass: rows above the k-th score, and of those equal to it the
    smallest ids that may still be needed (``l_high`` says how many)."""
    for r, q_ids, c_ids, s in _tiles(frames):
        kth, ties = _limits(r, q_ids)
        row, col = np.nonzero(s >= kth[:, None])
        keep = np.isfinite(s[row, col])
        row, col = row[keep], col[keep]
        equal = s[row, col] == kth[row]
        # Ids ascend along a row, so the first ties of a row are its smallest.
        nth = np.cumsum(equal) - equal
        start = np.searchsorted(row, np.arange(len(q_ids)))
        nth = nth - np.append(nth, 0)[np.minimum(start, len(nth))][row] if len(row) else nth
        keep = ~equal | (nth < ties[row])
        row, col = row[keep], col[keep]
        yield pd.DataFrame(
            {"query_id": q_ids[row], "vec_id": c_ids[col], "score": s[row, col].astype(np.int64)}
        )


def _pass(pairs: DataFrame, limits: DataFrame | None, work, schema: str) -> DataFrame:
    if limits is not None:
        pairs = pairs.join(limits, "q")
    return pairs.mapInPandas(work, schema)


def _per_block(limits: DataFrame, queries: DataFrame) -> DataFrame:
    """Two numbers per query, packed by query block."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("query_id")
        return pd.DataFrame(
            [(int(part["q"].iloc[0]), part["query_id"].to_numpy("<i8").tobytes(),
              part["low"].to_numpy("<f8").tobytes(), part["high"].to_numpy("<f8").tobytes())],
            columns=["q", "l_ids", "l_low", "l_high"],
        )

    return limits.join(queries, "query_id").groupBy("q").applyInPandas(
        pack, "q int, l_ids binary, l_low binary, l_high binary"
    )


def _reached(counts: DataFrame, k: int) -> DataFrame:
    """Per query the bin at which the counts from the top reach ``k``, and the
    count ``over`` of what lies above it; ``before`` rows lie above all bins.
    Queries with fewer rows get their lowest bin."""
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    upto = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))
    sums = counts.withColumn("over", F.col("before") + upto - F.col("n"))
    reached = sums.where(F.col("over") < k).groupBy("query_id")
    return reached.agg(F.min(F.struct("bin", "over")).alias("at")).select(
        "query_id", "at.bin", "at.over"
    )


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """For every row for which ``is_query`` (a Column over ``vec_id``) holds, the
    ``k`` candidates of largest integer inner product, ties to the smaller id:
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``. Queries with fewer
    candidates get all of them.

    Candidates are all rows but those with the query's id. Rows without id, and
    vectors that are null or hold null or non-finite components, take no part;
    shorter vectors count as if zeros followed. Of query rows with one id the
    smallest vector asks; repeated candidate rows are candidates each. Components
    times ``scale`` must stay below 2^53 in every sum. Empty tables give an empty
    result.
    """
    rows = written(integer_vectors(vectors, id_col, vector_col, scale), "vectors")
    asking = written(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    q = written(_blocks(asking, "q", QUERY_BLOCK, F.col("vec_id")), "query-blocks")
    n_blocks = q.count()
    if not n_blocks:
        return rows.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
            F.lit(0).cast("bigint").alias("score"),
        ).limit(0)
    of_query = asking.select(
        F.col("vec_id").alias("query_id"),
        F.pmod(F.xxhash64("vec_id"), F.lit(_n_blocks(asking, QUERY_BLOCK))).cast("int").alias("q"),
    )
    # By the place in the stored table, so that repeated rows are dealt out too.
    place = F.monotonically_increasing_id()
    c = written(_blocks(rows, "c", CANDIDATE_BLOCK, place), "candidate-blocks")
    # Every candidate block meets every query block, by an equi-join.
    meets = c.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(_last_block(q)))))
    pairs = meets.repartition("c", "q").join(q, "q")

    norms = rows.select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("n"))
    largest = norms.agg(F.max("n")).first()[0] or 0.0
    width = float(max(1, -(-int(2 * largest + 1) // BINS)))

    counts = _pass(pairs, None, _histogram(k, width), "query_id bigint, bin bigint, n bigint")
    counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
    # The k-th score of a query lies in [low, low + width); ``over`` scores lie above.
    at = _reached(counts.withColumn("before", F.lit(0).cast("bigint")), k)
    state = written(at.select("query_id", (F.col("bin") * width).alias("low"), "over"), "kth-bins")
    while width > 1:
        step = float(-(-int(width) // BINS))
        limits = state.select("query_id", "low", (F.col("low") + width).alias("high"))
        counts = _pass(pairs, _per_block(limits, of_query), _refined(step), "query_id bigint, bin bigint, n bigint")
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        counts = counts.join(state.select("query_id", F.col("over").alias("before")), "query_id")
        found = _reached(counts, k).join(state.select("query_id", "low"), "query_id")
        state = written(
            found.select("query_id", (F.col("low") + F.col("bin") * step).alias("low"), "over"), "kth-bins"
        )
        width = step
    limits = state.select(
        "query_id", "low", (F.lit(k) - F.col("over")).cast("double").alias("high")
    )
    found = _pass(pairs, _per_block(limits, of_query), _above, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _last_block(q: DataFrame) -> int:
    return q.agg(F.max("q")).first()[0]
