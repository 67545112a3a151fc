"""Mixing sources to target weights under a time-varying curriculum.

Every source has a schedule: knots (progress, weight) of a piecewise linear
function. Its integral tells how much of the source's target is demanded up to
a point of training; inverting the integral turns a document's place in its
source (words before it) into a position in training. Only DataFrame functions
run here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import WORD, field, packed, text_of, written

Schedule = Sequence[tuple[float, float]]

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
# Production schedules by place in the cycle of weights: sources of weight 1
# come early, those of weight 3 late. Each integrates to 1.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
)
# Buckets of a source's hash order. A source may hold any share of the rows.
BUCKET_BITS = 8
BUCKET_ROWS = 20_000


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size), one row per source, gains ``weight``,
    ``cycle`` (place in ``weights``) and ``target``. Targets share the total by
    weight; one that would pass ``cap`` times its source's size stops there and
    the excess is shared anew until none is above.

    Sources in order of room per weight stop first, so the shared level follows
    from running sums over them.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    ranked = sources.withColumn("cycle", F.pmod(place, F.lit(len(weights))).cast("int"))
    by_cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", by_cycle[F.col("cycle")])
    room = (F.lit(cap) * F.col("source_size")).cast("double") / F.col("weight")
    order = Window.orderBy("room", F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("room", room)
        .withColumn("stopped", F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(rest))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn(
            "level", (F.col("total") - F.col("stopped")).cast("double") / F.col("open_weight")
        )
    )
    # The first source whose room is above the level reached before it.
    fits = F.min(F.when(F.col("room") >= F.col("level"), F.struct("room", "level"))).over(everything)
    shared = fits["level"]
    capped = (F.lit(cap) * F.col("source_size")).cast("double")
    target = F.when(F.col("room") < shared, capped).otherwise(F.col("weight") * shared)
    return levels.select("source", "source_size", "cycle", "weight", target.alias("target"))


def _areas(schedule: Schedule) -> list[float]:
    sums = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        sums.append(sums[-1] + (t1 - t0) * (w0 + w1) / 2)
    return sums


def training_position(demand: Column, schedule: Schedule) -> Column:
    """The progress at which the schedule's integral reaches the share
    ``demand`` of its whole. Knots must rise in progress and weights be
    positive; a share past the end gives the end."""
    areas = _areas(schedule)
    whole = areas[-1]
    result = F.lit(float(schedule[-1][0]))
    for i in range(len(schedule) - 2, -1, -1):
        (t0, w0), (t1, w1) = schedule[i], schedule[i + 1]
        slope = (w1 - w0) / (t1 - t0)
        left = demand * F.lit(whole) - F.lit(areas[i])
        # left = w0 * x + slope * x * x / 2, solved without cancellation.
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * left, F.lit(0.0)))
        at = F.lit(float(t0)) + 2 * left / (F.lit(float(w0)) + root)
        result = F.when(demand * F.lit(whole) < F.lit(areas[i + 1]), at).otherwise(result)
    return result


def _with_part(df: DataFrame) -> DataFrame:
    """Source and bucket as one key that is never null, for window and join."""
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    return df.withColumn("part", F.concat("bucket", source))


def curriculum(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
    cap: int = MAX_REPEATS,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: ``row``, ``size`` (words; null text: 0),
    ``source_size``, ``target``, ``taken`` (words taken, repeats counted) and
    ``positions`` (training positions of the copies taken, in 0..1).

    Documents of a source stand in an order drawn from ``seed`` and the id, equal
    on every run. Copy ``e`` of a document is taken where the words before it,
    ``e`` whole sources included, plus half its own size are below the target:
    whole documents only, at most ``cap`` copies, and a source's sum is off its
    target by no more than about half a document. Rows with the same id and size
    are interchangeable. A null source is a source; an empty table gives an empty
    result. With no words at all nothing is taken.
    """
    sized = written(
        packed(docs).select(
            field(id_col).alias("id"),
            field(source_col).cast("string").alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        ),
        "sizes",
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sums = written(sums, "sources")
    most = sums.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    bits = BUCKET_BITS
    while (most >> bits) > BUCKET_ROWS and bits < 24:
        bits += 4
    targets = written(source_targets(sums.drop("n"), weights, cap), "targets")

    def ordered(df: DataFrame, row_id: Column) -> DataFrame:
        """Order in the source, and the leading hex digits of it as a bucket."""
        digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("null"))))
        return df.withColumn("at", digest).withColumn("bucket", F.substring("at", 1, bits // 4))

    # Words before each bucket of a source: one row per source and bucket.
    fills = ordered(sized, F.col("id")).groupBy("source", "bucket").agg(F.sum("size").alias("fill"))
    earlier = (
        Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = fills.withColumn("start", F.coalesce(F.sum("fill").over(earlier), F.lit(0)))
    targets = targets.withColumnRenamed("source", "t_source")
    starts = starts.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    starts = _with_part(starts).drop("source", "t_source", "bucket", "fill")

    full = ordered(
        packed(docs).select(
            "row",
            field(id_col).alias("id"),
            field(source_col).cast("string").alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        ),
        F.col("id"),
    )
    within = (
        Window.partitionBy("part")
        .orderBy("at", "id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = _with_part(full).withColumn("inside", inside).join(starts, "part")
    middle = (F.col("start") + F.col("inside")).cast("double") + F.col("size") / F.lit(2.0)
    taken_at = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(cap - 1)), lambda e: middle + e * F.col("source_size")
        ),
        lambda x: x < F.col("target"),
    )
    placed = placed.withColumn("taken_at", taken_at)

    def position(demand: Column) -> Column:
        result = training_position(demand, schedules[0])
        for i, schedule in enumerate(schedules[1:], start=1):
            result = F.when(F.col("cycle") == i, training_position(demand, schedule)).otherwise(result)
        return result

    return placed.select(
        "row",
        "size",
        "source_size",
        "target",
        (F.size("taken_at") * F.col("size")).cast("long").alias("taken"),
        F.transform("taken_at", lambda x: position(x / F.col("target"))).alias("positions"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with their columns, once per copy taken, range
    sorted by training position."""
    plan = curriculum(docs, **options)
    copies = plan.select("row", F.posexplode("positions").alias("copy", "position"))
    return copies.orderBy("position", "copy").select("row.*")
