"""The trie of conversation prefixes, screened by a count-min sketch.

Conversations are lists of turns, and every distinct beginning of one is a node. A
prefix is named by a digest that is a running sum over its turns, so a conversation
of any length may lie in several tasks. A count-min sketch counts the digests of
all prefixes: an estimate of one proves that only one conversation has the
prefix, and then the same holds for everything after it. Such tails are nodes as
they stand. Only prefixes that may be shared are shuffled and grouped exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import WORD, field, packed, written
from pairloom.llm.minhash import mix

GROUP_OF, HEAD_TURNS = 20, 4
# Counters in each of the rows of the sketch: four per prefix, between these
# bounds. The result never depends on it; past 4 million prefixes a row of the sketch
# holds fewer counters per prefix, and more prefixes are grouped than need be.
SKETCH_ROWS = 3
LEAST_WIDTH, MOST_WIDTH = 1 << 16, 1 << 24
_SLICE = 1 << 15
# Rows of one range, and ids of one piece of a digest.
ROWS_PER_RANGE = 50_000
_IDS_PER_PIECE = 50_000
_U = np.uint64
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_NOBODY = hashlib.sha256(b"").hexdigest()


def _digest_lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two 64-bit lanes of the SHA-256 of role and text in place of both."""
    for batch in batches:
        lanes = []
        for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist()):
            r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
            lanes.append(hashlib.sha256(b"%d:" % len(r) + r + t).digest()[:16])
        both = np.frombuffer(b"".join(lanes), "<i8").reshape(-1, 2)
        rest = [n for n in batch.schema.names if n not in ("role", "text")]
        yield pa.RecordBatch.from_arrays(
            [*(batch[n] for n in rest), pa.array(both[:, 0]), pa.array(both[:, 1])],
            [*rest, "lane_a", "lane_b"],
        )


def _runs(group: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


def running_sums(rows: DataFrame, group: str, order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with the wrapping 64-bit sums of ``values`` over the rows of their
    ``group`` up to and with their own, as ``sum_<value>``.

    Rows are ordered by group and ``order``, which must tell them apart, in ranges, so
    a group may lie in several. A task sums its range; what the ranges before it add
    to its first group is a row per range, which the driver sums up.
    """
    n_ranges = max(1, -(-rows.count() // ROWS_PER_RANGE))
    ranges = rows.repartitionByRange(n_ranges, group, *order).sortWithinPartitions(group, *order)
    names = [f"sum_{v}" for v in values]
    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, carried, nth = None, np.zeros(len(values), dtype=np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch[group].to_numpy()
            begins = _runs(ids)
            sums = []
            for i, value in enumerate(values):
                x = batch[value].to_numpy()
                run = np.cumsum(x, dtype=np.int64)
                before = np.zeros(len(begins), dtype=np.int64)
                before[1:] = run[begins[1:] - 1]
                if ids[0] == last:
                    before[0] = -carried[i]
                lengths = np.diff(np.append(begins, len(ids)))
                sums.append(run - np.repeat(before, lengths))
            last = ids[-1]
            carried = np.array([s[-1] for s in sums], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(s) for s in sums),
                 pa.array(np.full(len(ids), part, dtype=np.int32)),
                 pa.array(np.arange(nth, nth + len(ids)))],
                [*batch.schema.names, *names, "_part", "_nth"],
            )
            nth += len(ids)

    kept = f"{kinds}, {', '.join(f'{n} bigint' for n in names)}, _part int, _nth bigint"
    summed = written(ranges.mapInArrow(add, kept), "sums")
    ends = summed.groupBy("_part").agg(
        F.min(group).alias("first"), F.max(group).alias("last"),
        F.max_by(F.struct(*names), "_nth").alias("sums"),
    )
    # One row per range, at most.
    carried, offsets, over = {}, [], None
    for row in sorted(ends.collect(), key=lambda r: r["_part"]):
        if row["first"] == over:
            offsets.append((row["_part"], row["first"], *(_wrapped(carried[n]) for n in names)))
        spanning = row["first"] == over and row["last"] == over
        carried = {n: row["sums"][n] + (carried[n] if spanning else 0) for n in names}
        over = row["last"]
    if not offsets:
        return summed.drop("_part", "_nth")
    table = summed.sparkSession.createDataFrame(
        offsets,
        f"_at_part int, _at_group {dict(rows.dtypes)[group]}, "
        + ", ".join(f"add_{n} bigint" for n in names),
    )
    joined = summed.join(
        F.broadcast(table), (F.col("_part") == F.col("_at_part")) & (F.col(group) == F.col("_at_group")), "left"
    )
    for n in names:
        joined = joined.withColumn(n, _wrapping(_wide(n) + F.coalesce(_wide(f"add_{n}"), F.lit(0))))
    return joined.select(*rows.columns, *names)


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def _wrapping(wide: Column) -> Column:
    """A sum of two 64-bit numbers as 64 bits hold it."""
    top, span = F.lit(Decimal(1 << 63)), F.lit(Decimal(1 << 64))
    return (
        F.when(wide >= top, wide - span).when(wide < -top, wide + span).otherwise(wide).cast("bigint")
    )


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``at`` (from 0), ``words`` and two lanes for every turn."""
    rows = packed(conversations).select(
        field("conv_id").cast("bigint").alias("conv_id"),
        field("turn").alias("turn"),
        F.coalesce(field("role"), F.lit("")).alias("role"),
        F.coalesce(field("text"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    words = F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words")
    # The order of role and text as a hash would not be theirs: rows of one turn are
    # told apart by them, the rest by a number that is written with the row.
    turns = rows.select("conv_id", "turn", words, "role", "text", F.lit(1).cast("bigint").alias("one"))
    numbered = written(
        turns.withColumn("row_nth", F.monotonically_increasing_id()), "turns"
    )
    placed = running_sums(numbered, "conv_id", ["turn", "role", "text", "row_nth"], ["one"])
    shape = "conv_id bigint, at bigint, words bigint"
    lanes = placed.select(
        "conv_id", (F.col("sum_one") - 1).alias("at"), "words", "role", "text"
    ).mapInArrow(_digest_lanes, f"{shape}, lane_a bigint, lane_b bigint")
    return written(lanes, "lanes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the turns of the rebuilt conversations with their
    depth (from 1): the first ``h`` of the group's first conversation, then the own
    ones after the first ``h``."""
    convs = written(
        turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conversations"
    )
    heads = (
        turns.where((F.col("conv_id") % GROUP_OF == 0) & (F.col("at") < HEAD_TURNS - 1))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "words", "lane_a", "lane_b"))).alias("head"))
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS
    shared = convs.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP_OF).alias("base"), h.alias("h")
    ).join(heads, "base", "left")
    shared = written(
        shared.select(
            "conv_id", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array()).alias("head")
        ),
        "heads",
    )
    begun = shared.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", (F.col("t.at") + 1).alias("depth"), "t.words", "t.lane_a", "t.lane_b"
    )
    shift = shared.select("conv_id", "h", (F.size("head") - F.col("h")).alias("shift"))
    own = turns.join(shift, "conv_id").where(F.col("at") >= F.col("h")).select(
        "conv_id", (F.col("at") + F.col("shift") + 1).alias("depth"), "words", "lane_a", "lane_b"
    )
    return convs, begun.unionByName(own)


def _placed_lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lanes that depend on the depth, so that their sum depends on the order."""
    for batch in batches:
        depth = batch["depth"].to_numpy().astype(_U)
        lanes = []
        for name, salt in zip(("lane_a", "lane_b"), _SALTS):
            lanes.append(mix(batch[name].to_numpy().view(_U) ^ mix(depth * _U(salt))).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], batch["depth"], batch["words"], *(pa.array(x) for x in lanes)],
            ["conv_id", "depth", "words", "lane_a", "lane_b"],
        )


def _cells(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """The counter of each digest in each row of the sketch."""
    cells = [
        (mix(a ^ (b * _U(salt))) & _U(width - 1)).astype(np.int64) + i * width
        for i, salt in enumerate(_SALTS[:SKETCH_ROWS])
    ]
    return np.stack(cells)


def shared_cells(prefixes: DataFrame, width: int) -> np.ndarray:
    """Which counters of a count-min sketch of all digests are above one. A counter
    stops at two, so tasks send and merge single bytes; the driver sees a bit each,
    at most ``SKETCH_ROWS * MOST_WIDTH`` of them, 6 MB."""

    def count(batches):
        cells = np.zeros(SKETCH_ROWS * width, dtype=np.uint8)
        for batch in batches:
            a, b = (batch[n].to_numpy().view(_U) for n in ("digest_a", "digest_b"))
            found, n = np.unique(_cells(a, b, width), return_counts=True)
            cells[found] = np.minimum(cells[found] + np.minimum(n, 2), 2)
        out = [
            (i, zlib.compress(part.tobytes(), 1))
            for i, part in enumerate(cells.reshape(-1, _SLICE)) if part.any()
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())],
            ["slice", "counts"],
        )

    def merge(batches):
        at, total, out = None, None, []
        for batch in batches:
            for number, counts in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist()):
                if number != at:
                    if at is not None:
                        out.append((at, np.packbits(total > 1).tobytes()))
                    at, total = number, np.zeros(_SLICE, dtype=np.uint8)
                total = np.minimum(total + np.frombuffer(zlib.decompress(counts), np.uint8), 2)
        if at is not None:
            out.append((at, np.packbits(total > 1).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())],
            ["slice", "above"],
        )

    n_slices = SKETCH_ROWS * width // _SLICE
    sent = prefixes.select("digest_a", "digest_b").mapInArrow(count, "slice int, counts binary")
    merged = (
        sent.repartition(min(n_slices, 64), "slice")
        .sortWithinPartitions("slice")
        .mapInArrow(merge, "slice int, above binary")
    )
    above = np.zeros(SKETCH_ROWS * width // 8, dtype=np.uint8).reshape(-1, _SLICE // 8)
    for row in merged.collect():
        above[row["slice"]] = np.frombuffer(row["above"], np.uint8)
    return above.reshape(-1)


def _screened(above: np.ndarray, width: int):
    """``single``: the estimate is one, or was so for a shorter prefix of the
    conversation seen by this task. ``first``: it is the first one that is."""

    def screen(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, told = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch[n].to_numpy().view(_U) for n in ("digest_a", "digest_b"))
            cells = _cells(a, b, width)
            one = ((above[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 0).any(axis=0)
            conv = batch["conv_id"].to_numpy()
            begins = _runs(conv)
            seen = np.cumsum(one)
            before = seen[begins] - one[begins]
            if conv[0] == last and told:
                before[0] = -1
            lengths = np.diff(np.append(begins, len(conv)))
            since = seen - np.repeat(before, lengths)
            single = since > 0
            first = one & (since == 1)
            last, told = conv[-1], bool(single[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(single), pa.array(first),
                 pa.array(np.full(len(conv), part, dtype=np.int32))],
                [*batch.schema.names, "single", "first", "_part"],
            )

    return screen


def _told_on(screened: DataFrame) -> DataFrame:
    """What a range found of its last conversation told to the ranges that go on
    with it: the driver sees a row per range."""
    ends = screened.groupBy("_part").agg(
        F.min("conv_id").alias("first_id"), F.max("conv_id").alias("last_id"),
        F.max_by("single", F.struct("conv_id", "depth")).alias("told"),
    )
    known, over, told = [], None, False
    for row in sorted(ends.collect(), key=lambda r: r["_part"]):
        goes_on = row["first_id"] == over and told
        if goes_on:
            known.append((row["_part"], over))
        told = row["told"] or (goes_on and row["last_id"] == over)
        over = row["last_id"]
    if not known:
        return screened.drop("_part")
    table = screened.sparkSession.createDataFrame(known, "at_part int, at_conv bigint")
    joined = screened.join(
        F.broadcast(table), (F.col("_part") == F.col("at_part")) & (F.col("conv_id") == F.col("at_conv")), "left"
    )
    known_single = F.col("at_part").isNotNull()
    return joined.withColumns(
        {"single": F.col("single") | known_single, "first": F.col("first") & ~known_single}
    ).drop("_part", "at_part", "at_conv")


def _joined_ids(batches):
    """Sorted (digest, conv_id) rows to pieces of comma-joined ids."""
    at, ids = None, []

    def piece():
        return at[0], at[1], ids[0], ",".join(map(str, ids))

    for batch in batches:
        out = []
        for a, b, conv in zip(*(batch[n].to_pylist() for n in ("digest_a", "digest_b", "conv_id"))):
            if (a, b) != at or len(ids) >= _IDS_PER_PIECE:
                if ids:
                    out.append(piece())
                at, ids = (a, b), []
            ids.append(conv)
        yield _pieces(out)
    if ids:
        yield _pieces([piece()])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds)],
        ["digest_a", "digest_b", "least", "ids"],
    )


def _hashed_pieces(batches):
    """The SHA-256 of each digest's pieces in order, fed one after another."""
    at, told = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(*(batch[n].to_pylist() for n in ("digest_a", "digest_b", "ids"))):
            if (a, b) != at:
                if at:
                    out.append((*at, told.hexdigest()))
                at, told = (a, b), hashlib.sha256(ids.encode())
            else:
                told.update(b"," + ids.encode())
        yield _ends(out)
    if at:
        yield _ends([(*at, told.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.string()])],
        ["node_a", "node_b", "ends_sha256"],
    )


def _ends_of(ends: DataFrame) -> DataFrame:
    """(node_a, node_b, ends_sha256) of rows (digest_a, digest_b, conv_id)."""
    key = ["digest_a", "digest_b"]
    n_ranges = max(1, -(-ends.count() // ROWS_PER_RANGE))
    pieces = (
        ends.repartitionByRange(n_ranges, *key, "conv_id")
        .sortWithinPartitions(*key, "conv_id")
        .mapInArrow(_joined_ids, "digest_a bigint, digest_b bigint, least bigint, ids string")
    )
    return (
        pieces.repartition(*key)
        .sortWithinPartitions(*key, "least")
        .mapInArrow(_hashed_pieces, "node_a bigint, node_b bigint, ends_sha256 string")
    )


NODE = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the
    parent's; null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    and ``ends_sha256``.

    Turns are ordered by turn (null first), then role, then text, null ones as empty;
    a conversation is rebuilt from the first turns of its group's first one and its own
    (``rebuilt``). Rows with a null ``conv_id`` belong to no conversation and are left
    out. Rows of one id that repeat are turns of their own. An empty table has no
    nodes, not even a root.
    """
    convs, turns = rebuilt(ordered_turns(conversations))
    placed = turns.mapInArrow(
        _placed_lanes, "conv_id bigint, depth bigint, words bigint, lane_a bigint, lane_b bigint"
    )
    summed = running_sums(written(placed, "placed"), "conv_id", ["depth"], ["lane_a", "lane_b"])
    prefixes = summed.select(
        "conv_id", "depth", "words",
        F.col("sum_lane_a").alias("digest_a"), F.col("sum_lane_b").alias("digest_b"),
        _wrapping(_wide("sum_lane_a") - _wide("lane_a")).alias("parent_a"),
        _wrapping(_wide("sum_lane_b") - _wide("lane_b")).alias("parent_b"),
    )
    # In the order of the ranges, so that a conversation's prefixes come together.
    n_ranges = max(1, -(-prefixes.count() // ROWS_PER_RANGE))
    prefixes = written(
        prefixes.repartitionByRange(n_ranges, "conv_id", "depth").sortWithinPartitions("conv_id", "depth"),
        "prefixes",
    )
    lengths = prefixes.groupBy("conv_id").agg(F.max("depth").alias("length"))
    lengths = written(
        convs.select("conv_id").join(lengths, "conv_id", "left").select(
            "conv_id", F.coalesce("length", F.lit(0)).alias("length")
        ),
        "lengths",
    )
    n_prefixes = prefixes.count()
    width = min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (4 * max(n_prefixes, 1) - 1).bit_length()))
    above = shared_cells(prefixes, width)
    shape = (
        "conv_id bigint, depth bigint, words bigint, digest_a bigint, digest_b bigint,"
        " parent_a bigint, parent_b bigint, single boolean, first boolean, _part int"
    )
    ordered = prefixes.repartitionByRange(n_ranges, "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    screened = _told_on(written(ordered.mapInArrow(_screened(above, width), shape), "screened"))
    tails, maybe = screened.where("single"), screened.where("not single")

    # Prefixes that may be shared, grouped exactly.
    nodes = written(
        maybe.groupBy("digest_a", "digest_b").agg(
            F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n_convs"),
            F.first("depth").alias("depth"), F.first("words").alias("words"),
            F.first("parent_a").alias("parent_a"), F.first("parent_b").alias("parent_b"),
        ),
        "nodes",
    )
    begun = tails.where("first")
    children = (
        nodes.select("parent_a", "parent_b", "depth")
        .unionByName(begun.select("parent_a", "parent_b", "depth"))
        .groupBy("parent_a", "parent_b", F.col("depth").alias("child_depth"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    # A digest also says its depth, but for a sum that happens to be zero: the depth
    # is part of every key, and the root is the one node of depth zero.
    children = written(children, "children")
    family = nodes.join(
        children.withColumnsRenamed({"parent_a": "digest_a", "parent_b": "digest_b"}).withColumn(
            "depth", F.col("child_depth") - 1
        ).drop("child_depth"),
        ["digest_a", "digest_b", "depth"], "left",
    ).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    family = written(family, "family")

    # What a node saves, and that it is a leaf, is told to its smallest member; the
    # members of a node sum up what they were told from its depth on.
    told = family.select(
        F.col("least").alias("conv_id"), "depth",
        ((F.col("n_convs") - 1) * F.col("words")).alias("saves"),
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
    )
    with_tail = begun.select("conv_id", F.lit(1).cast("bigint").alias("tail"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    members = (
        maybe.select("conv_id", "depth", "digest_a", "digest_b")
        .join(told, ["conv_id", "depth"], "left")
        .join(with_tail, "conv_id", "left")
        .select(
            "conv_id", "depth", "digest_a", "digest_b",
            F.sum(F.coalesce("saves", F.lit(0))).over(later).alias("saves"),
            (F.max(F.coalesce("leaf", F.lit(0))).over(later) + F.coalesce("tail", F.lit(0))).alias("leaves"),
        )
    )
    below = members.groupBy("digest_a", "digest_b", "depth").agg(
        F.sum("saves").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")
    )
    ending = maybe.join(
        lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"], "left_semi"
    ).select("digest_a", "digest_b", "conv_id")
    ends = _ends_of(written(ending, "ending"))
    parents = family.select(
        F.col("digest_a").alias("parent_a"), F.col("digest_b").alias("parent_b"),
        (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent_conv_id"),
    )
    top = convs.agg(F.min("conv_id").alias("root_id"), F.count(F.lit(1)).alias("n_convs"))
    root_id = top.first()["root_id"]
    parent = F.when(F.col("depth") == 1, F.lit(root_id)).otherwise(F.col("parent_conv_id"))
    grouped = written(
        family.join(below, ["digest_a", "digest_b", "depth"])
        .join(parents, ["parent_a", "parent_b", "depth"], "left")
        .join(ends, (F.col("digest_a") == F.col("node_a")) & (F.col("digest_b") == F.col("node_b")), "left")
        .select(
            F.col("least").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children",
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOBODY)).alias("ends_sha256"),
        ),
        "grouped",
    )
    # Tails: one conversation, no branches, nothing saved.
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    own_id = F.col("conv_id").cast("string").cast("binary")
    alone = (
        tails.join(lengths, "conv_id")
        .join(parents.withColumnRenamed("depth", "begun_at"), (
            tails["first"] & (tails["parent_a"] == parents["parent_a"])
            & (tails["parent_b"] == parents["parent_b"]) & (tails["depth"] == F.col("begun_at"))
        ), "left")
        .select(
            "conv_id", "depth",
            F.when(F.col("depth") == 1, F.lit(root_id))
            .when(F.col("first"), F.col("parent_conv_id"))
            .otherwise(F.col("conv_id")).alias("parent_conv_id"),
            one.alias("n_convs"), (F.col("depth") < F.col("length")).cast("bigint").alias("n_children"),
            one.alias("n_leaves"), none.alias("saved_tokens"),
            F.when(F.col("depth") == F.col("length"), F.sha2(own_id, 256)).otherwise(F.lit(_NOBODY)).alias("ends_sha256"),
        )
    )
    # The root: all conversations, those without turns end there.
    firsts = children.where("child_depth = 1").agg(F.sum("n_children").alias("n_children"))
    leaves = family.where("n_children = 0").select(F.lit(1).alias("leaf")).unionByName(
        begun.select(F.lit(1).alias("leaf"))
    ).agg(F.count(F.lit(1)).alias("n_leaves"))
    saved = told.agg(F.sum("saves").alias("saved_tokens"))
    empty = lengths.where("length = 0").select(
        F.lit(0).cast("bigint").alias("digest_a"), F.lit(0).cast("bigint").alias("digest_b"), "conv_id"
    )
    root = (
        top.where("n_convs > 0").join(firsts).join(leaves).join(saved)
        .join(_ends_of(empty).select("ends_sha256"), F.lit(True), "left")
        .select(
            F.col("root_id").alias("conv_id"), none.alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"),
            "n_convs", F.coalesce("n_children", none).alias("n_children"),
            F.greatest("n_leaves", one).alias("n_leaves"), F.coalesce("saved_tokens", none).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(_NOBODY)).alias("ends_sha256"),
        )
    )
    return grouped.select(NODE).unionByName(alone.select(NODE)).unionByName(root.select(NODE))
