"""Join helpers for keys that may hold a large share of all rows.

Heavy keys are found by a counting job first. Counts combine map-side, so the
job moves one row per key and map task, and a top-N bounds the list of heavy
keys. That list is the only thing broadcast. Where it is empty the plan is a
plain equi-join.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pairloom.operators.staging import stage

# Hard bound of the list of heavy keys. A key past it holds less than one in
# MAX_HEAVY_KEYS of the rows and is joined like any other.
MAX_HEAVY_KEYS = 50_000
MAX_SPLITS = 4_096
ROWS_PER_TASK = 1_000_000
PAIRS_PER_TASK = 20_000_000
# Rows of the second side of a block that one task sees.
FEW_ROWS = 4_096


def _splits(n: Column, per_task: int) -> Column:
    return F.least(F.ceil(n / F.lit(per_task)), F.lit(MAX_SPLITS)).cast("int")


def bounded_rows(df: DataFrame, *order: Column) -> list[Row]:
    return df.orderBy(*order).limit(MAX_HEAVY_KEYS).collect()


def local_table(rows: list[Row], like: DataFrame) -> DataFrame | None:
    return like.sparkSession.createDataFrame(rows, like.schema) if rows else None


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Ask for a broadcast where the rows, counted, are few enough; otherwise
    leave the join to Spark. ``df`` should be a stored table."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def heavy_keys(many: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame | None:
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    heavy = counts.where(F.col("_n") > rows_per_task).select(
        *keys, "_n", _splits(F.col("_n"), rows_per_task).alias("_p"), F.lit(1).alias("_q")
    )
    return local_table(bounded_rows(heavy, F.desc("_n")), heavy)


@dataclass(frozen=True)
class HeavyBlocks:
    """Blocks worth special care. ``hot`` ones have more than the allowed rows
    on the second side; ``calm`` ones merely multiply to many pairs."""

    calm: DataFrame | None = None
    hot: DataFrame | None = None
    # Hot blocks past the broadcast bound.
    more_hot: DataFrame | None = None
    # Over the hot blocks: most rows on the first side, largest width.
    most_rows: int = 0
    widest: int = 0

    def within(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of ``df`` in hot blocks. The largest blocks are told by the
        broadcast list, so the join with the rest meets no hot key."""
        largest = F.broadcast(self.hot.select(*keys))
        inside = df.join(largest, keys, "left_semi")
        if self.more_hot is None:
            return inside
        rest = df.join(largest, keys, "left_anti")
        return inside.unionByName(rest.join(self.more_hot, keys, "left_semi"))

    def outside(self, df: DataFrame, keys: list[str]) -> DataFrame:
        rest = df.join(F.broadcast(self.hot.select(*keys)), keys, "left_anti")
        return rest if self.more_hot is None else rest.join(self.more_hot, keys, "left_anti")


def heavy_blocks(
    first: DataFrame,
    second: DataFrame,
    keys: list[str],
    pairs_per_task: int,
    hot_rows: int | None = None,
    width: str = "0",
) -> HeavyBlocks:
    """``width`` is an SQL expression whose maximum per block is kept."""
    n_first = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.expr(width)).alias("_w"))
    n_second = second.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.max(F.expr(width)).alias("_v"))
    n, m = F.col("_n"), F.col("_m")
    pairs = n * m.cast("double")
    hot = F.lit(False) if hot_rows is None else m > hot_rows
    heavy = (
        n_first.join(n_second, keys)
        .where(hot | (pairs > pairs_per_task))
        .select(
            *keys,
            "_n",
            pairs.alias("_pairs"),
            hot.alias("_hot"),
            F.least(_splits(n * F.least(m, F.lit(FEW_ROWS)), pairs_per_task), n)
            .cast("int")
            .alias("_p"),
            _splits(m, FEW_ROWS).alias("_q"),
            F.greatest("_w", "_v").alias("_width"),
        )
    )
    # Hot blocks first: those beyond the list are told by a join, calm ones
    # beyond it are joined unsplit.
    rows = bounded_rows(heavy, F.desc("_hot"), F.desc("_pairs"))
    hot_blocks = [r for r in rows if r["_hot"]]
    most_rows = max((r["_n"] for r in hot_blocks), default=0)
    widest = max((r["_width"] for r in hot_blocks), default=0)
    listed, more_hot = local_table(hot_blocks, heavy), None
    if len(hot_blocks) == MAX_HEAVY_KEYS:
        more_hot = stage(
            heavy.where("_hot").join(F.broadcast(listed.select(*keys)), keys, "left_anti"),
            "hot-blocks",
        )
        more = more_hot.agg(F.max("_n"), F.max("_width")).first()
        most_rows, widest = max(most_rows, more[0] or 0), max(widest, more[1] or 0)
    return HeavyBlocks(
        calm=local_table([r for r in rows if not r["_hot"]], heavy),
        hot=listed,
        more_hot=None if more_hot is None else more_hot.select(*keys),
        most_rows=most_rows,
        widest=widest,
    )


def join_split(
    first: DataFrame,
    second: DataFrame,
    keys: list[str],
    first_id: Column,
    second_id: Column,
    heavy: DataFrame | None,
) -> DataFrame:
    """Inner equi-join with heavy keys split as :func:`dealt_sides` does it."""
    if heavy is None:
        return first.join(second, keys)
    left, right = dealt_sides(first, second, keys, first_id, second_id, heavy)
    return left.join(right, [*keys, "_i", "_j"]).drop("_i", "_j")


def dealt_sides(
    first: DataFrame,
    second: DataFrame,
    keys: list[str],
    first_id: Column,
    second_id: Column,
    heavy: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_i`` and ``_j``. A heavy key is cut into ``_p`` times ``_q``
    tasks: its rows are dealt by the hash of their id, ``_p`` ways on the first side and
    ``_q`` ways on the second, and copied along the other direction."""
    heavy = F.broadcast(heavy.select(*keys, "_p", "_q"))
    p, q = F.coalesce("_p", F.lit(1)), F.coalesce("_q", F.lit(1))

    def dealt(df: DataFrame, own: str, ways: Column, row_id: Column, copied: str, copies: Column):
        columns = df.columns
        return (
            df.join(heavy, keys, "left")
            .withColumn(own, F.pmod(F.xxhash64(row_id), ways).cast("int"))
            .withColumn(copied, F.explode(F.sequence(F.lit(0), copies - 1)))
            .select(*columns, own, copied)
        )

    return dealt(first, "_i", p, first_id, "_j", q), dealt(second, "_j", q, second_id, "_i", p)


def salted_join(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    row_id: Column,
    rows_per_task: int = ROWS_PER_TASK,
    most_rows: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Inner equi-join for a ``many`` side with hot keys and a ``few`` side
    with a bounded number of rows per key. ``most_rows`` is an upper bound of
    the ``many`` rows per key, if the caller has one: when it is low enough,
    nothing needs counting. ``counted`` is a table with the keys of ``many`` that is
    cheaper to count."""
    if most_rows is not None and most_rows <= rows_per_task:
        return many.join(few, keys)
    heavy = heavy_keys(many if counted is None else counted, keys, rows_per_task)
    return join_split(many, few, keys, row_id, F.lit(0), heavy)
