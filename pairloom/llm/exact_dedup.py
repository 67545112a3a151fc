"""Exact deduplication by sorting the content.

Normalised texts are dealt into ranges of their bytes by sampled cut points,
each range is sorted (Spark's external sort), equal texts become neighbours,
and a full comparison with the neighbour tells where a run begins. A cut point
also holds a hash of the row's number, so a group of copies of any size,
repeated rows too, is spread over several ranges; the groups that a cut point runs
through are counted apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import (
    WHITE,
    choose_ranges,
    field,
    packed,
    range_index,
    sampled_cuts,
    text_of,
    written,
)

BYTES_PER_RANGE = 4 << 20
# Leading bytes of a text in its sort key; its digest follows.
LEAD_BYTES = 24


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``row`` (the input row), ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after replacing each run of ASCII white space
    by one space; null counts as empty. The row with the smallest id stays; null
    ids come last, and of rows that share text and id one stays. An empty table
    gives an empty result.
    """
    normal = F.regexp_replace(text_of(text_col), WHITE, " ")
    lead = F.rpad(F.hex(F.substring(F.col("norm").cast("binary"), 1, LEAD_BYTES)), 2 * LEAD_BYTES, "0")
    # Numbers are given once and written, so that they hold for every later pass.
    numbered = packed(docs).withColumn("nth", F.monotonically_increasing_id())
    hashed = numbered.withColumn("norm", normal).withColumn("digest", F.sha2("norm", 256))
    rows = written(
        hashed.withColumn("n", F.octet_length("norm")).withColumn("k", F.concat(lead, "digest")).drop("norm"),
        "content-keys",
    ).withColumn("place", F.concat("k", F.hex(F.xxhash64("nth"))))
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    cuts = sampled_cuts(rows, "place", n_rows, choose_ranges(n_bytes, BYTES_PER_RANGE))

    # Groups that a cut point may run through: at most one per cut point.
    cut_keys = sorted({c[: 2 * LEAD_BYTES + 64] for c in cuts})
    smallest = F.min(F.struct(field(id_col).isNull(), field(id_col).alias("id"), "nth"))
    split_groups = (
        rows.where(F.col("k").isin(cut_keys))
        .groupBy("digest")
        .agg(smallest.alias("least"), F.count(F.lit(1)).alias("all_n"))
        .select("digest", F.col("least.id").alias("all_min"), F.col("least.nth").alias("all_nth"), "all_n")
    )

    ranged = rows.select("row", "nth", "k", "digest", range_index(F.col("place"), cuts).alias("range"))
    # A task per range: one shuffle partition each, whatever the session's number.
    ranged = ranged.repartitionById(len(cuts) + 1, F.col("range")).withColumn("norm", normal)
    order = Window.partitionBy("range").orderBy("k", "norm", F.asc_nulls_last(field(id_col)), "nth")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    begins = ~F.col("norm").eqNullSafe(F.lag("norm").over(order))
    runs = (
        ranged.withColumn("begins", begins)
        .withColumn("run", F.sum(F.col("begins").cast("int")).over(so_far))
        .drop("norm", "k")
    )
    of_run = Window.partitionBy("range", "run")
    in_run = runs.select(
        "row",
        "nth",
        "digest",
        "begins",
        F.min(field(id_col)).over(of_run).alias("run_min"),
        F.count(F.lit(1)).over(of_run).alias("run_n"),
    )
    whole = in_run.join(F.broadcast(split_groups), "digest", "left")
    split = F.col("all_n").isNotNull()
    return whole.select(
        "row",
        F.when(split, F.col("all_min")).otherwise(F.col("run_min")).alias("keep_id"),
        F.coalesce("all_n", "run_n").alias("group_size"),
        F.when(split, F.col("nth") == F.col("all_nth")).otherwise(F.col("begins")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    return exact_duplicates(docs, id_col, text_col).where("kept").select("row.*")
