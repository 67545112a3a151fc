"""Selection of k-th values by global histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4_096
# Rows of the last bin that may come to the driver.
FEW = 10_000


def kth_largest(df: DataFrame, score: str, key: str, k: int) -> tuple[float, int] | None:
    """The k-th row of ``df`` by descending score, ties by ascending key, as
    (score, key); None for k < 1. ``df`` should be a stored table with finite
    scores and distinct keys. Each round counts a histogram of one bin of the
    round before; the driver sees bin counts only, then one small bin."""
    if k < 1:
        return None
    low, high, n = df.agg(F.min(score), F.max(score), F.count(F.lit(1))).first()
    k = min(k, n)
    if not k:
        return None
    left = k
    inside = df.select(F.col(score).alias("s"), F.col(key).alias("k"))
    while True:
        inside = inside.where((F.col("s") >= low) & (F.col("s") <= high))
        if high <= low:
            return low, _nth_key(inside, left)
        width = (high - low) / BINS
        bin_of = F.least(F.floor((F.col("s") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        counts = (
            inside.groupBy(bin_of.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
            .collect()
        )
        for row in sorted(counts, key=lambda r: -r["bin"]):
            if row["n"] >= left:
                break
            left -= row["n"]
        n, low, high = row["n"], row["low"], row["high"]
        if n <= FEW:
            rows = inside.where((F.col("s") >= low) & (F.col("s") <= high)).collect()
            best = sorted((-s, key) for s, key in rows)[left - 1]
            return -best[0], best[1]


def _nth_key(ties: DataFrame, nth: int) -> int:
    """The nth smallest key of rows of one score, by the same histograms."""
    as_scores = ties.select((-F.col("k").cast("decimal(20,0)")).alias("s"), "k")
    low, high, n = as_scores.agg(F.min("s"), F.max("s"), F.count(F.lit(1))).first()
    left = nth
    inside = as_scores
    while True:
        inside = inside.where((F.col("s") >= low) & (F.col("s") <= high))
        if n <= FEW:
            return sorted(r[0] for r in inside.select("k").collect())[left - 1]
        step = max(1, int(high - low) // BINS + 1)
        counts = (
            inside.groupBy(F.floor((F.col("s") - low) / step).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
            .collect()
        )
        for row in sorted(counts, key=lambda r: -r["bin"]):
            if row["n"] >= left:
                break
            left -= row["n"]
        n, low, high = row["n"], row["low"], row["high"]
        if n > FEW and high == low:
            return int(-low)
