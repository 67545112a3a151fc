"""Lexical retrieval packing.

Whole windows of a document are sequences of their own. What remains of each
document is placed in one order of the whole corpus by its content
(``pairloom.llm.lexical``), and the order is cut into shards of a bounded number
of tokens, so that pieces with the same rare terms share a shard. Inside a shard
a BM25 inverted index over token ids returns, for a seed piece, its unused
neighbours by score, and they fill the seed's window one after another. The
piece that overflows is cut, and its rest seeds the next window. Document
frequencies and the mean length come from all documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import field, packed, text_of, written
from pairloom.llm.lexical import term_counts, with_codes
from pairloom.llm.tokens import ID_BYTES, encode_batches

WINDOW = 2_048
# About so many tokens of remainders in a shard: some hundreds of documents.
SHARD_TOKENS = 400_000
# About so many shards are cut from one range of the order.
SHARDS_PER_RANGE = 4
VOCABULARY = 1 << 16
K1, B = 1.2, 0.75

PIECES = (
    "key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " sequence_id bigint, offset bigint"
)
_COLUMNS = [c.split()[0] for c in PIECES.split(", ")]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _counted(batches):
    """Token ids with ``nth``, and in the last row of a task ``seen`` and ``times``: the
    token ids of its documents and how many of them hold each."""
    import pyarrow as pa

    kind, sums, held = pa.list_(pa.int32()), np.zeros(VOCABULARY, dtype=np.int64), None

    def told(batch, found: list):
        none = [None] * (batch.num_rows - len(found))
        columns = [pa.array(none + [x[i] for x in found], kind) for i in range(2)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, *columns], [*batch.schema.names, "seen", "times"]
        )

    for batch in encode_batches(batches):
        for ids in batch["ids"]:
            sums[term_counts(np.frombuffer(ids.as_buffer(), dtype="<u2"))[0]] += 1
        if held is not None:
            yield told(held, [])
        held = batch
    if held is not None:
        seen = np.flatnonzero(sums)
        yield told(held, [(seen, sums[seen])])


def counted_tokens(keyed: DataFrame) -> DataFrame:
    """``token_ids``, with the counts of :func:`document_frequencies` beside them."""
    return keyed.select("key", "text").mapInArrow(
        _counted, "key bigint, ids binary, n bigint, seen array<int>, times array<int>"
    )


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """Documents that hold each token id; the driver sees one row per id."""
    told = tokens.where("seen is not null").select(F.explode(F.arrays_zip("seen", "times")).alias("c"))
    df = np.zeros(VOCABULARY)
    for i, n in told.groupBy("c.seen").agg(F.sum("c.times")).collect():
        df[i] = n
    return df


class InvertedIndex:
    """BM25 postings of the pieces of one shard."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean_length: float):
        lengths = np.array([len(p) for p in pieces], dtype=np.float64)
        norm = K1 * (1 - B + B * lengths / max(mean_length, 1.0))
        terms, owners, tf = [], [], []
        for i, p in enumerate(pieces):
            t, n = term_counts(p)
            terms.append(t)
            owners.append(np.full(len(t), i))
            tf.append(n)
        self.terms = terms
        term, owner, tf = np.concatenate(terms), np.concatenate(owners), np.concatenate(tf)
        order = np.argsort(term, kind="stable")
        term, owner, tf = term[order], owner[order], tf[order]
        self.owner = owner
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[owner])
        vocabulary, first = np.unique(term, return_index=True)
        self.first = np.zeros(VOCABULARY, dtype=np.int64)
        self.count = np.zeros(VOCABULARY, dtype=np.int64)
        self.first[vocabulary] = first
        self.count[vocabulary] = np.diff(np.append(first, len(term)))
        self.n = len(pieces)

    def scores(self, piece: int) -> np.ndarray:
        """BM25 of every piece for the distinct tokens of ``piece``."""
        t = self.terms[piece]
        counts = self.count[t]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) - np.repeat(ends - counts - self.first[t], counts)
        return np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n)


def pack_pieces(
    pieces: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW
) -> Iterator[tuple[int, int, int, int, int]]:
    """(piece, start, length, sequence, offset) for every part of every piece.
    Pieces are not empty. Seeds come in the given order; equal scores go to the
    earlier piece."""
    index = InvertedIndex(pieces, idf, mean_length)
    unused = np.ones(len(pieces), dtype=bool)
    sequence, seed, start, nxt = 0, None, 0, 0
    while True:
        if seed is None:
            while nxt < len(pieces) and not unused[nxt]:
                nxt += 1
            if nxt == len(pieces):
                return
            seed, start = nxt, 0
            unused[seed] = False
        length = min(window, len(pieces[seed]) - start)
        yield seed, start, length, sequence, 0
        filled, rest = length, None
        if start + length < len(pieces[seed]):
            rest = (seed, start + length)
        elif filled < window:
            candidates = np.flatnonzero(unused)
            if len(candidates):
                scores = index.scores(seed)[candidates]
                for c in candidates[np.argsort(-scores, kind="stable")]:
                    part = min(window - filled, len(pieces[c]))
                    unused[c] = False
                    yield int(c), 0, part, sequence, filled
                    filled += part
                    if part < len(pieces[c]):
                        rest = (int(c), part)
                    if filled == window:
                        break
        sequence += 1
        seed, start = rest if rest else (None, 0)


def _shards(batches, shard_tokens: int) -> Iterator[list[tuple]]:
    """Rows (key, nth, n, begin, tail) of a range in shards of ``shard_tokens``.
    A last shard of less than half joins the one before it."""
    ready, shard, held = None, [], 0
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("key", "nth", "n", "begin", "tail"))):
            shard.append(row)
            held += len(row[4]) // ID_BYTES
            if held >= shard_tokens:
                if ready:
                    yield ready
                ready, shard, held = shard, [], 0
    if ready and held * 2 < shard_tokens:
        ready, shard = ready + shard, []
    yield from (x for x in (ready, shard) if x)


def _range_packer(idf: np.ndarray, mean_length: float, window: int, shard_tokens: int):
    """Sequence numbers hold the range, the shard (20 bits) and the sequence (24)."""

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 20
        for at, shard in enumerate(_shards(batches, shard_tokens)):
            shard.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            number = (first + at) << 24
            pieces = [np.frombuffer(r[4], dtype="<u2") for r in shard]
            rows = [
                (shard[i][0], shard[i][3] + start, length, crc32(pieces[i][start : start + length]),
                 shard[i][2], number + sequence, offset)
                for i, start, length, sequence, offset in pack_pieces(pieces, idf, mean_length, window)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in zip(*rows)], _COLUMNS
            )

    return pack


def _whole_windows(window: int):
    """Windows that one document fills alone. Their sequence numbers are below
    zero: task number, then a running number."""

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = -(TaskContext.get().partitionId() << 32)
        for batch in batches:
            out = []
            for key, n, ids in zip(*(batch[c].to_pylist() for c in ("key", "n", "ids"))):
                tokens = np.frombuffer(ids, dtype="<u2")
                for start in range(0, n - n % window, window):
                    number -= 1
                    out.append(
                        (key, start, window, crc32(tokens[start : start + window]), n, number, 0)
                    )
            columns = zip(*out) if out else [[]] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns], _COLUMNS
            )

    return cut


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """One row per piece of a document: ``doc_id``, ``start``, ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is the ids of its text (null: empty) and the end id. Every id is
    in exactly one piece; a sequence holds at most ``window`` ids, without gaps,
    and only the last sequence of a shard is shorter. A seed's neighbours are
    those of its shard; pieces of similar content share one wherever they come
    from. Repeated rows are packed once each; a null document id stays null. An
    empty table gives an empty result.
    """
    keyed = packed(docs).select(
        field(id_col).cast("bigint").alias("key"), text_of(text_col).alias("text")
    )
    # ``nth`` tells rows of one id apart; it is written, so it never changes.
    tokens = written(
        counted_tokens(keyed).withColumn("nth", F.monotonically_increasing_id()), "tokens"
    )
    tail = F.col("n") % window
    n_docs, n_rests, tails = tokens.agg(
        F.count(F.lit(1)), F.count_if(tail > 0), F.coalesce(F.sum(tail), F.lit(0))
    ).first()
    df = document_frequencies(tokens)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    n_shards = max(1, math.ceil(tails / SHARD_TOKENS))
    rests = tokens.where(tail > 0).select(
        "key", "nth", "n", (F.col("n") - tail).alias("begin"),
        F.expr(f"substring(ids, cast((n - n % {window}) * {ID_BYTES} + 1 as int))").alias("tail"),
    )
    if n_shards > 1:
        coded = written(with_codes(rests, idf, n_rests), "codes")
    else:
        # One shard sees every piece: the order says nothing.
        coded = rests.withColumn("code", F.lit(0).cast("bigint"))
    ranges = coded.repartitionByRange(math.ceil(n_shards / SHARDS_PER_RANGE), "code", "nth")
    packer = _range_packer(idf, tails / max(n_docs, 1), window, SHARD_TOKENS)
    remainders = ranges.sortWithinPartitions("code", "nth").mapInArrow(packer, PIECES)
    whole = tokens.where(F.col("n") >= window).select("key", "n", "ids")
    windows = whole.mapInArrow(_whole_windows(window), PIECES)
    return remainders.unionByName(windows).withColumnRenamed("key", "doc_id")
