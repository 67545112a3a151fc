"""Connected components by alternating star steps. Every step is a map-side
combined minimum and an equi-join; the edges are written between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
    ).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of long nodes to ``node``, ``label``: the smallest node
    of the component. Loops and repeated edges are allowed; nodes without an edge
    to another node are not listed."""
    current = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    state = _state(current)
    while True:
        # Each node points its larger neighbours to its smallest neighbour.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large-star")
        # Each node points its smaller neighbours and itself to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        current = written(small, "small-star")
        before, state = state, _state(current)
        if before == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
