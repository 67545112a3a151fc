"""Quality classifier by importance resampling.

Two generative models over hashed words and word pairs: one of target text (rows
labelled good), one of all documents. A document's log importance weight is the
log of their ratio, summed over its features. Documents are drawn by Gumbel
top-k; k is the number of documents whose weight passes a cutoff fitted on
labelled rows, so the sampler takes as many as look like target text. Every labelled
row counts for the cutoff, scored by a model that did not learn from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import field, packed, text_batches, text_of, with_keys, written
from pairloom.llm.minhash import mix
from pairloom.llm.selection import kth_largest

BUCKETS = 1 << 16
# The classifier is fitted on at most so many labelled rows, drawn by hash.
MAX_LABELLED = 20_000
# Labelled rows are dealt into so many folds for the cutoff.
FOLDS = 5
SMOOTHING = 0.5
# Scale of the Gumbel noise beside log weights: 1 samples in proportion to the
# weights, 0 takes the largest.
TEMPERATURE = 1.0
# Added to the number of features of a text: short texts say little.
SHRINK = 10
_CACHE = 400_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def features(text: str, cache: dict[bytes, int], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and pairs of neighbouring words."""
    words = text.encode("utf-8", "surrogatepass").split()
    if len(cache) > _CACHE:
        cache.clear()
    get, ids = cache.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    h = np.array(ids, dtype=np.uint64)
    pairs = mix(h[:-1] * _PRIME + h[1:])
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def _counter(buckets: int, folds: int = FOLDS):
    """Per bucket its count over all texts, and that over the targets of each fold;
    ``target`` is the fold of a target, minus one for any other text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        sums = np.zeros((1 + folds, buckets), dtype=np.int64)
        for batch in text_batches(batches):
            for text, target in zip(batch["text"].to_pylist(), batch["target"].to_pylist()):
                f = np.bincount(features(text, cache, buckets), minlength=buckets)
                sums[0] += f
                if target >= 0:
                    sums[1 + target] += f
        seen = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), *(pa.array(row[seen]) for row in sums)],
            ["bucket", "raw", *(f"target_{i}" for i in range(folds))],
        )

    return count


def _scorer(log_ratios: np.ndarray):
    """Log weights by the model whose row of ``log_ratios`` a text names in ``fold``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in text_batches(batches):
            sums, sizes = [], []
            for t, fold in zip(batch["text"].to_pylist(), batch["fold"].to_pylist()):
                f = features(t, cache, log_ratios.shape[1])
                sums.append(float(log_ratios[fold][f].sum()))
                sizes.append(len(f))
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array(sums, pa.float64()), pa.array(sizes, pa.int64())],
                ["key", "log_weight", "n_features"],
            )

    return score


@dataclass(frozen=True)
class ImportanceModel:
    log_ratio: np.ndarray
    cutoff: float


def _best_cutoff(rows: list[tuple[float, bool]]) -> float:
    """The cutoff of largest balanced accuracy; the middle of the best gap. With
    one class only nothing tells where to cut: everything passes."""
    good = sum(1 for _, g in rows if g)
    bad = len(rows) - good
    if not good or not bad:
        return -float("inf")
    rows = sorted(rows)
    below_good = below_bad = 0
    best, cut = -1.0, 0.0
    for i, (s, g) in enumerate(rows):
        below_good, below_bad = below_good + g, below_bad + (not g)
        if i + 1 < len(rows) and rows[i + 1][0] > s:
            worth = (good - below_good) / good + below_bad / bad
            if worth > best:
                best, cut = worth, (s + rows[i + 1][0]) / 2
    return cut


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` labelled ids (``id``, ``good``, ``fine``, ``fold``), drawn by
    the hash of the id. Rows with null id or quality do not count; of
    contradicting rows the worse label holds. ``good`` is ``fine`` and not toxic."""
    rows = packed(labels).select(
        field(id_col).cast("bigint").alias("id"),
        (field("quality") > 0).alias("fine"),
        (F.coalesce(field("toxic"), F.lit(0)) > 0).alias("toxic"),
    )
    by_id = (
        rows.where("id is not null and fine is not null")
        .groupBy("id")
        .agg(F.min("fine").alias("fine"), F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64("id", F.lit(3))
    drawn = by_id.withColumn("h", order).orderBy("h", "id").limit(most)
    return drawn.select(
        "id", (F.col("fine") & ~F.col("toxic")).alias("good"), F.col("fine"),
        F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"),
    )


def _log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Zero everywhere without targets. The target is smoothed towards the raw
    model, so that a feature it has not seen weighs by how often it should have
    been seen."""
    if not target.sum():
        return np.zeros(len(raw))
    p_raw = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    strength = SMOOTHING * len(raw)
    p_target = (target + strength * p_raw) / (target.sum() + strength)
    return np.log(p_target / p_raw)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ImportanceModel:
    """Both models and the cutoff. The raw model counts every document, the target
    model the drawn rows labelled good. For the cutoff each fold of labelled rows is
    scored by a target model of the other folds; toxic rows of good quality count on
    neither side there. Without any good row the ratio is zero everywhere."""
    sample = written(labelled_sample(labels), "label-sample")
    texts = packed(docs).select(field(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    targets = F.broadcast(sample.where("good").select("id", F.col("fold").alias("target")))
    sums = [F.sum(c) for c in ("raw", *(f"target_{i}" for i in range(FOLDS)))]
    kind = ", ".join(f"target_{i} bigint" for i in range(FOLDS))
    counts = (
        texts.join(targets, "id", "left")
        .select("text", F.coalesce("target", F.lit(-1)).alias("target"))
        .mapInArrow(_counter(BUCKETS), f"bucket bigint, raw bigint, {kind}")
        .groupBy("bucket")
        .agg(*sums)
        .collect()
    )
    raw, target = np.zeros(BUCKETS), np.zeros((FOLDS, BUCKETS))
    for bucket, n_raw, *n_target in counts:
        raw[bucket], target[:, bucket] = n_raw, n_target
    everything = target.sum(axis=0)
    if not everything.sum():
        return ImportanceModel(np.zeros(BUCKETS), -float("inf"))
    without = np.array([_log_ratio(raw, everything - target[i]) for i in range(FOLDS)])
    judged = sample.where("good or not fine")
    rows = (
        texts.join(F.broadcast(judged), "id")
        .select(F.col("good").cast("bigint").alias("key"), "text", "fold")
        .mapInArrow(_scorer(without), "key bigint, log_weight double, n_features bigint")
        .collect()
    )
    cutoff = _best_cutoff([(_mean(r[1], r[2]), bool(r[0])) for r in rows])
    return ImportanceModel(_log_ratio(raw, everything), cutoff)


def _mean(log_weight: float, n: int) -> float:
    return log_weight / (n + SHRINK)


def _gumbel(key: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    temperature: float = TEMPERATURE,
    seed: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: ``row``, ``log_weight`` (of the whole text),
    ``score`` (log weight over the number of features plus ``SHRINK``) and
    ``kept``.

    k documents are kept, k being the number of documents whose score passes the
    fitted cutoff: those of largest score plus Gumbel noise times ``temperature``
    over the same size. Equal sums go to the smaller key. Texts without
    words have score 0. Rows that share id and text are one document; null ids
    have no label. Without labels, or where the rows judged for the cutoff are
    all good or all bad, everything is kept; an empty table gives an empty
    result. Toxicity is not judged: toxic rows are no targets, but toxic text of
    good quality passes like other text. Reruns agree.
    """
    model = fit(docs, labels, id_col, text_col)
    keyed = with_keys(docs, id_col, text_col)
    raw = keyed.select("key", "text", F.lit(0).alias("fold")).mapInArrow(
        _scorer(model.log_ratio[None, :]), "key bigint, log_weight double, n_features bigint"
    )
    size = F.col("n_features") + F.lit(SHRINK)
    score = F.col("log_weight") / size
    noise = F.lit(temperature) * _gumbel(F.col("key"), seed) / size
    scored = written(
        raw.withColumn("score", score).withColumn("drawn", F.col("score") + noise).dropDuplicates(["key"]),
        "weights",
    )
    k = scored.where(F.col("score") > model.cutoff).count()
    kth = kth_largest(scored, "drawn", "key", k)
    if kth is None:
        kept = F.lit(False)
    else:
        value, last_key = kth
        kept = (F.col("drawn") > value) | ((F.col("drawn") == value) & (F.col("key") <= last_key))
    return keyed.select("key", "row").join(
        scored.select("key", "log_weight", "score", kept.alias("kept")), "key"
    ).select("row", "log_weight", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return quality_scores(docs, labels, id_col, text_col).where("kept").select("row.*")
