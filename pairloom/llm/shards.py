"""Token sequences in training order, as binary shards of fixed stride.

Sequences are cut from the token stream of each task and numbered without gaps.
A keyed Feistel permutation with cycle-walking gives each number a slot, so the
training order needs no sort of random keys and any slot can be traced back.
Slots are dealt into ranges of whole shards; a shard holds its records at
multiples of one stride, and a reader can go on from any slot.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import field, packed, text_of, text_batches, written
from pairloom.llm.minhash import mix
from pairloom.llm.tokens import END_ID, ID_BYTES, TokenIds
from pairloom.operators.staging import shared_folder

WINDOW = 2_048
PER_SHARD = 512
# Shards are written in so many jobs, one after another.
WAVES = 4
ROUNDS = 6
SEED = 20_240_229


def feistel(numbers: np.ndarray, size: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..size-1. Balanced Feistel rounds permute the next
    power of four; values past the end are permuted again until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = numbers.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> shift, x[todo] & mask
        for r in range(rounds):
            salt = mix(np.array([seed * 64 + r], dtype=np.uint64))[0]
            left, right = right, left ^ (mix(right ^ salt) & mask)
        x[todo] = left << shift | right
        todo &= x >= np.uint64(size)
    return x.astype(np.int64)


def _sequences(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = TokenIds(), np.array([END_ID], dtype="<u2").tobytes()
        task, nth = TaskContext.get().partitionId(), 0
        pending, held, owners = [], 0, []
        width = window * ID_BYTES

        def flush(rows):
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                ["task", "nth", "n_tokens", "doc_ids", "ids"],
            )

        for batch in text_batches(batches):
            rows = []
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                ids, at = encoder.ids(text) + end, 0
                while at < len(ids):
                    part = ids[at : at + width - held]
                    pending.append(part)
                    owners.append(key)
                    held, at = held + len(part), at + len(part)
                    if held == width:
                        rows.append((task, nth, window, owners, b"".join(pending)))
                        pending, held, owners, nth = [], 0, [], nth + 1
            yield flush(rows)
        if held:
            filled = b"".join(pending)
            padding = end * ((width - held) // ID_BYTES)
            yield flush([(task, nth, held // ID_BYTES, owners, filled + padding)])

    return cut


def write_training_order(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    per_shard: int = PER_SHARD,
    seed: int = SEED,
) -> DataFrame:
    """Tokenise ``docs``, write ``folder``/shards/shard=N with one file each and
    a manifest, and return one row per sequence: ``sequence_id``, ``slot``,
    ``n_tokens`` (without padding) and ``doc_ids`` in order of appearance.

    Documents are their ids and the end id (null text: only that), one after
    another; a sequence holds ``window`` ids, and only the last of a task is
    padded with the end id. Ids are little-endian unsigned 16-bit; a record ends
    with a line end, so the stride is 2 * window + 1 bytes. Repeated rows are
    written once each, null document ids stay null. An empty table writes only
    the manifest.
    """
    spark = docs.sparkSession
    texts = packed(docs).select(field(id_col).cast("bigint").alias("key"), text_of(text_col).alias("text"))
    cut = written(
        texts.mapInArrow(
            _sequences(window),
            "task int, nth bigint, n_tokens bigint, doc_ids array<bigint>, ids binary",
        ),
        "sequences",
    )
    # One row per task of the job above.
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = cut.groupBy("task").count()
    starts = tasks.select("task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    starts = written(starts, "starts")
    size = cut.count()
    permute = F.pandas_udf(lambda x: pd.Series(feistel(x.to_numpy(), size, seed)), "bigint")
    numbered = cut.join(starts, "task").withColumn("sequence_id", F.col("start") + F.col("nth"))
    placed = numbered.withColumn("slot", permute("sequence_id"))
    n_shards = -(-size // per_shard)
    n_tasks = max(1, min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    records = placed.select(
        "slot", "ids", F.floor(F.col("slot") / per_shard).cast("int").alias("shard")
    )
    per_wave = -(-n_shards // WAVES)
    for first in range(0, n_shards, max(1, per_wave)):
        last = min(n_shards, first + per_wave)
        wave = records.where((F.col("shard") >= first) & (F.col("shard") < last))
        task_of = F.floor((F.col("shard") - first) * n_tasks / F.lit(last - first)).cast("int")
        wave = wave.repartitionById(n_tasks, task_of).sortWithinPartitions("shard", "slot")
        _append(wave.select("shard", F.col("ids").cast("string").alias("value")), f"{folder}/shards")
    manifest = {
        "sequences": size, "window": window, "per_shard": per_shard, "seed": seed,
        "id_bytes": ID_BYTES, "stride": window * ID_BYTES + 1, "end_id": END_ID,
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(
        f"{folder}/manifest"
    )
    return placed.select("sequence_id", "slot", "n_tokens", "doc_ids")


def _append(wave: DataFrame, path: str) -> None:
    spark, flag = wave.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(flag)
    spark.conf.set(flag, "true")
    try:
        wave.write.mode("append").partitionBy("shard").text(path, compression="none")
    finally:
        spark.conf.set(flag, before)


def read_training_order(spark: SparkSession, folder: str, first_slot: int = 0) -> DataFrame:
    """The records from ``first_slot`` on: ``slot``, ``shard``, ``byte_offset``,
    ``ids`` (binary). Shards before it are not opened; a shard is read whole."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    stride, per_shard = manifest["stride"], manifest["per_shard"]
    schema = "slot bigint, shard int, byte_offset bigint, ids binary"
    if not manifest["sequences"]:
        return spark.createDataFrame([], schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch["shard"].to_pylist(), batch["content"]):
                whole = memoryview(content.as_buffer())
                n = len(whole) // stride
                slots = np.arange(n) + shard * per_shard
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slots), pa.array(np.full(n, shard, dtype=np.int32)),
                        pa.array(np.arange(n) * stride),
                        pa.array([whole[i * stride : (i + 1) * stride - 1] for i in range(n)], pa.binary()),
                    ],
                    ["slot", "shard", "byte_offset", "ids"],
                )

    files = spark.read.format("binaryFile").load(f"{folder}/shards")
    files = files.where(F.col("shard") >= first_slot // per_shard)
    read = files.select("shard", "content").mapInArrow(records, schema)
    return read.where(F.col("slot") >= first_slot)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/training-order-{uuid.uuid4().hex}"


def crc32_of_ids(ids: Column) -> Column:
    """CRC-32 of the ids as little-endian unsigned 32-bit."""
    checksum = F.pandas_udf(
        lambda s: s.map(lambda b: zlib.crc32(np.frombuffer(b, "<u2").astype("<u4").tobytes())), "bigint"
    )
    return checksum(ids)
