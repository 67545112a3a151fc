"""The best records of many short blocks, ranked pair by pair in arrays.

Rows of both sides come block by block, the other side first. A batch of rows holds
many blocks, and all of their pairs are counted and sorted at once, some
``_PAIRS`` of them at a time; a block that a batch ends in hands its records of the
other side on to the next batch.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs ranked at a time.
_PAIRS = 1 << 19
# A pair is one number: its row, its place in the order of overlaps, and its id.
_ID_BITS, _AT_BITS = 22, 22
_NONE_SHARED = 1 << (_AT_BITS - 1)


def best_of_blocks(
    left: DataFrame, right: DataFrame, keys: list[str], k: int, unknown: int
) -> DataFrame:
    """``(s1_id, at, ids)``, one row per row of ``left`` (``s1_id``, ``tokens``) whose
    block has rows of ``right`` (``other_id``, ``tokens``): the ``k`` best distinct
    ``(at, other_id)`` of the block in this order. ``at`` is minus the number of shared
    tokens, or ``unknown`` where either side has none. The rows of ``right`` in a block
    are held in memory."""
    s1_type = left.schema["s1_id"].dataType
    other_type = right.schema["other_id"].dataType
    no_s1, no_other = F.lit(None).cast(s1_type), F.lit(None).cast(other_type)
    columns = [*keys, "s1_id", "other_id", "tokens", "is_left"]
    rows = (
        left.withColumns({"other_id": no_other, "is_left": F.lit(True)})
        .select(*columns)
        .unionByName(
            right.withColumns({"s1_id": no_s1, "is_left": F.lit(False)}).select(*columns)
        )
    )
    # The hash of the block comes first: a number is compared before any text.
    rows = rows.repartition(*keys).sortWithinPartitions(
        F.xxhash64(*keys), *keys, "is_left", "other_id"
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            parts = [pa.Table.from_batches([batch])]
            table = pa.concat_tables(parts if held is None else [held, *parts]).combine_chunks()
            if not table.num_rows:
                continue
            is_left = table["is_left"].to_numpy()
            block = np.cumsum(_differs(table, keys)) - 1
            yield from _lists(table, block, is_left, k, unknown)
            held = table.filter(pa.array((block == block[-1]) & ~is_left))

    return rows.mapInArrow(
        rank,
        f"s1_id {s1_type.simpleString()}, at array<int>, ids array<{other_type.simpleString()}>",
    )


def _differs(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether a row has another value than the row before in any of ``columns``."""
    differs = np.zeros(table.num_rows, dtype=bool)
    differs[:1] = True
    for name in columns:
        values = table[name].combine_chunks()
        here, before = values[1:], values[:-1]
        same = pc.fill_null(pc.equal(here, before), False).to_numpy(zero_copy_only=False)
        if values.null_count:
            same = same | pc.and_(here.is_null(), before.is_null()).to_numpy(zero_copy_only=False)
        differs[1:] |= ~same
    return differs


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes`` numbers from each of ``starts`` on."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _lists(
    table: pa.Table, block: np.ndarray, is_left: np.ndarray, k: int, unknown: int
) -> Iterator[pa.RecordBatch]:
    others = np.flatnonzero(~is_left)
    n_others = np.bincount(block[others], minlength=block[-1] + 1)
    first = np.cumsum(n_others) - n_others
    owners = np.flatnonzero(is_left & (n_others[block] > 0))
    if not len(owners):
        return
    if n_others.max() >> _ID_BITS:
        raise ValueError("a block has too many records of the other side to be ranked by pairs")
    # Ids are numbered in order; rows of one id in a block share its number.
    new_id = _differs(table, ["other_id"])[others]
    new_id[first[n_others > 0]] = True
    id_number = np.cumsum(new_id) - 1
    id_rows = others[new_id]

    tokens = table["tokens"].combine_chunks()
    nameless = tokens.is_null().to_numpy(zero_copy_only=False)
    n_tokens = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    words = tokens.flatten().dictionary_encode()
    row = np.repeat(np.arange(table.num_rows), n_tokens)
    word = block[row] * (len(words.dictionary) + 1) + words.indices.to_numpy().astype(np.int64)
    # The words of the other side in order, each with the place of its record.
    theirs = np.flatnonzero(~is_left[row])
    theirs = theirs[np.argsort(word[theirs], kind="stable")]
    place = np.cumsum(~is_left)[row[theirs]] - 1 - first[block[row[theirs]]]
    own = np.flatnonzero(is_left[row] & (n_others[block[row]] > 0))
    found = np.searchsorted(word[theirs], word[own], side="left")
    n_found = np.searchsorted(word[theirs], word[own], side="right") - found
    owner_number = np.cumsum(is_left & (n_others[block] > 0)) - 1
    word_owner = owner_number[row[own]]

    s1_ids, other_ids = table["s1_id"].combine_chunks(), table["other_id"].combine_chunks()
    sizes = n_others[block[owners]]
    ends = np.cumsum(sizes)
    start = 0
    while start < len(owners):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _PAIRS, side="right")))
        mine, size = owners[start:stop], sizes[start:stop]
        at_pair = np.cumsum(size) - size
        a, b = np.searchsorted(word_owner, [start, stop])
        shared = place[_ranges(found[a:b], n_found[a:b])]
        shared += np.repeat(at_pair[word_owner[a:b] - start], n_found[a:b])
        at = -np.bincount(shared, minlength=int(size.sum()))
        begin = first[block[mine]]
        record = _ranges(begin, size)
        if nameless.any():
            at[np.repeat(nameless[mine], size) | nameless[others[record]]] = unknown
        lowest = id_number[begin]
        pair = (np.repeat(np.arange(len(mine)), size) << _AT_BITS) + (at + _NONE_SHARED)
        pair = (pair << _ID_BITS) + (id_number[record] - np.repeat(lowest, size))
        pair.sort()
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
        of = pair >> (_AT_BITS + _ID_BITS)
        kept = np.arange(len(pair)) - np.searchsorted(of, of) < k
        pair, of = pair[kept], of[kept]
        at = ((pair >> _ID_BITS) & ((1 << _AT_BITS) - 1)) - _NONE_SHARED
        number = (pair & ((1 << _ID_BITS) - 1)) + lowest[of]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(mine)))])
        offsets = pa.array(offsets.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                s1_ids.take(pa.array(mine)),
                pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, other_ids.take(pa.array(id_rows[number]))),
            ],
            names=["s1_id", "at", "ids"],
        )
        start = stop
