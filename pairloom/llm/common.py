"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.staging import shared_folder

# ASCII white space, as every contract of this folder means it.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Rows of a sorted sample per range: balance only, never results.
SAMPLE_PER_RANGE = 30
MAX_RANGES = 4_096
MIN_RANGES = 256

_FREE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Filters the large side of a join by a Bloom filter of the other side's keys
# before it is shuffled. The filter is 1 MB whatever the number of keys: past
# some millions it lets more rows through, and the join drops them.
KEY_FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1000t",
}
_SEPARATOR = "|"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def written(df: DataFrame, label: str, extra: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back. Its lineage ends
    there, a lost executor costs nothing, and the shuffle files of the job are
    freed when it ends. ``extra`` settings hold for the job."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with settings(spark, _FREE_SHUFFLES | (extra or {})):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """The whole row as one column ``row``: no column of the caller can clash
    with a name used inside an operator."""
    return df.select(F.struct("*").alias("row"))


def field(name: str) -> Column:
    return F.col("row").getField(name)


def text_of(name: str) -> Column:
    return F.coalesce(field(name), F.lit(""))


def with_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row``, ``text`` (null: empty) and ``key``, a long that orders like the
    id. Unique integer ids are the keys. Where ids repeat or are null, rows with
    the same id and text are one document, null ids come last, and the keys are
    ranks of (id, hash of the text)."""
    rows = packed(df)
    ids = df.select(F.col(f"`{id_col}`").alias("id"))
    integral = dict(ids.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint")
    repeated = ids.groupBy("id").count().where((F.col("count") > 1) | F.col("id").isNull())
    if integral and repeated.isEmpty():
        return rows.select(
            field(id_col).cast("bigint").alias("key"), text_of(text_col).alias("text"), "row"
        )
    rows = rows.select(
        field(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h"), "row"
    )
    ordered = rows.select("id", "h").distinct().orderBy(F.asc_nulls_last("id"), "h")
    ranked = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    kind = dict(ids.dtypes)["id"]
    ranks = written(
        df.sparkSession.createDataFrame(ranked, f"rank_id {kind}, rank_h bigint, key bigint"),
        "ranks",
    )
    joined = rows.join(
        ranks, F.col("id").eqNullSafe(F.col("rank_id")) & (F.col("h") == F.col("rank_h"))
    )
    return joined.select("key", text_of(text_col).alias("text"), "row")


def choose_ranges(amount: int, per_range: int) -> int:
    return min(MAX_RANGES, max(MIN_RANGES, math.ceil(amount / per_range)))


def sampled_cuts(keys: DataFrame, column: str, n_rows: int, n_ranges: int) -> list[str]:
    """At most ``n_ranges - 1`` cut points of a short string column, from a
    sample of about ``SAMPLE_PER_RANGE`` rows per range. They balance the
    ranges; no result depends on them. Keys must not hold ``|``."""
    share = min(1.0, SAMPLE_PER_RANGE * n_ranges / max(n_rows, 1))
    sample = sorted(r[0] for r in keys.select(column).sample(False, share, 17).collect())
    step = max(1, len(sample) // n_ranges)
    return sorted(set(sample[step::step]))


def range_index(key: Column, cuts: list[str]) -> Column:
    """Number of cuts at or below ``key``: a coarse list first, then the cuts
    between two of its entries."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    fine = F.split(F.lit(_SEPARATOR.join(cuts)), rf"\{_SEPARATOR}")
    coarse = F.split(F.lit(_SEPARATOR.join(cuts[::step])), rf"\{_SEPARATOR}")

    def place(k: Column) -> Column:
        c = F.size(F.filter(coarse, lambda x: x <= k))
        start = F.greatest((c - 1) * step, F.lit(0))
        inside = F.size(F.filter(F.slice(fine, start + 1, step), lambda x: x <= k))
        return F.when(c == 0, F.lit(0)).otherwise(start + inside)

    # An array of one binds the key, so that it is computed once.
    return F.transform(F.array(key), place)[0]


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds few bytes, or one row."""
    for batch in batches:
        start, n = 0, batch.num_rows
        if batch.nbytes <= most or n <= 1:
            if n:
                yield batch
            continue
        per = max(1, int(n * most / batch.nbytes))
        while start < n:
            yield batch.slice(start, min(per, n - start))
            start += per
