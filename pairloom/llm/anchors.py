"""Removal of passages that a smaller document has too, by fixed-block anchors.

The words of every document are cut into blocks that do not overlap, the anchors,
each half a window long, so that a window of any reference document holds one of
its anchors whole. Every rolling stretch of that length in every document probes
the anchors. Where a stretch and an anchor of two documents meet, the hit is
extended: the windows that hold it are compared by 80 bits and more of their words, and a
window that also starts in a smaller document is a repeat. Repeats that touch
join into maximal ones, and their words go.

What a batch of texts can tell by itself it does not send: of a stretch or window
found in several documents of a batch only the smallest one is asked about, so a
passage that a third of all documents share sends one entry per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import field, packed, text_batches, text_of, with_keys, written
from pairloom.llm.minhash import mix

WINDOW = 50
# About so many bytes of text per bucket. A batch deals its entries to so many at
# most, more are reached in a second dealing, so that rows hold many entries.
BUCKET_BYTES = 16 << 20
BUCKETS_AT_ONCE = 2_048
_ENTRIES, _DOCS = 1 << 20, 60_000
# Of a bucket, about so many are put in groups at once.
_AT_ONCE = 1 << 19
# Rows hold the entries of many documents: an Arrow batch is cut by bytes, not rows.
_SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_U = np.uint64
_NULL_KEY = (1 << 63) - 1
# Odd bases of the rolling hashes (fixed values).
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base & _MASK, dtype=_U)
        known[0] = 1
        known = _POWERS[base] = np.cumprod(known, dtype=_U)
    return known[:n]


class _Stretches:
    """Hashes of any stretch of a row of numbers, from running sums."""

    def __init__(self, numbers: np.ndarray, base: int):
        n = len(numbers)
        self.power = _powers(base, n + 1)
        terms = numbers.astype(_U)
        terms += _U(1)
        terms *= _powers(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.power[start])


@dataclass
class _Words:
    """The hashes of the words of a batch of texts, and the first and last word of
    each text."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, raw: list[bytes]) -> _Words:
        # A space after every text ends its last word.
        data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
        white = _WHITE[data]
        change = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(white) and not white[0]:
            change = np.concatenate([[0], change])
        start, end = change[::2], change[1::2]
        ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
        begins = ends - [len(r) + 1 for r in raw]
        hashes = _Stretches(data, _BYTE_BASE).of(start, end)
        return cls(hashes, np.searchsorted(start, begins), np.searchsorted(start, ends))

    def stretches(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first word, and text, of every stretch of ``length`` words."""
        counts = np.maximum(self.last - self.first - length + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(self.first, counts) + nth, text


def _utf8(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


class _Groups:
    """Entries with equal numbers, and the least and the largest key of each group."""

    def __init__(self, numbers: list[np.ndarray], keys: np.ndarray):
        if len(numbers) == 1:
            self.order = np.argsort(numbers[0])
        else:
            self.order = np.lexsort(numbers[::-1])
        new = np.zeros(len(keys), dtype=bool)
        new[:1] = True
        for x in numbers:
            x = x[self.order]
            new[1:] |= x[1:] != x[:-1]
        self.begins = np.flatnonzero(new)
        self.group = np.cumsum(new, dtype=np.int32) - 1
        self.keys = keys[self.order]
        self.least = np.minimum.reduceat(self.keys, self.begins)
        self.most = np.maximum.reduceat(self.keys, self.begins)

    def any(self, flags: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(flags[self.order], self.begins)

    def of_least(self) -> np.ndarray:
        """An entry of each group with its least key."""
        at = np.flatnonzero(self.keys == self.least[self.group])
        found = np.empty(len(self.begins), dtype=np.int64)
        found[self.group[at]] = at
        return self.order[found]


def _by_key(keys: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The hashes of each key as bytes."""
    order = np.argsort(keys, kind="stable")
    keys, h = keys[order], h[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    for at, end in zip(begins, np.append(begins[1:], len(keys))):
        yield int(keys[at]), h[at:end].tobytes()


# Entries of one bucket: 64-bit numbers or their upper halves, what goes with each, and
# the number of its document in ``docs``. Rows with a ``key`` are answers already.
_SENT = "bucket int, key bigint, docs binary, low binary, high binary, doc binary"
_FOUND = "key bigint, hashes binary"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields)],
        [name for name, _ in fields],
    )


def _bucket_of(low: np.ndarray, n_buckets: int) -> np.ndarray:
    # By the lower half, which the entries need not say again.
    return (((low & _U(0xFFFFFFFF)) * _U(n_buckets)) >> _U(32)).astype(np.int32)


def _packed(bucket, columns: list[np.ndarray], doc, keys) -> list[tuple]:
    """Entries packed by bucket, one row each, with the keys they speak of."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    rows = []
    for part in np.split(order, cuts):
        spoken, local = np.unique(doc[part], return_inverse=True)
        rows.append((
            int(bucket[len(rows) and cuts[len(rows) - 1]]), None, keys[spoken].tobytes(),
            *(c[part].tobytes() for c in columns), local.astype(np.uint16).tobytes(),
        ))
    return rows


def _answered(keys: np.ndarray, h: np.ndarray, n_buckets: int) -> list[tuple]:
    return [(key % n_buckets, key, None, found, None, None) for key, found in _by_key(keys, h)]


def _upper(h: np.ndarray) -> np.ndarray:
    return (h >> _U(32)).astype(np.uint32)


def _probes(block: int, n_buckets: int):
    """Every stretch of ``block`` words, with a mark where it is an anchor. Stretches
    of several documents of the batch are hits as far as those go. An anchor is
    asked for by the upper half of its hash and its bucket: a false hit costs a
    comparison, no result."""

    def send(batches):
        for batch in text_batches(batches, 3 << 20):
            keys = batch["key"].to_numpy()
            words = _Words.of(_utf8(batch["text"]))
            start, text = words.stretches(block)
            if not len(start):
                continue
            h = _Stretches(words.hashes, _WORD_BASES[0]).of(start, start + block)
            anchor = (start - words.first[text]) % block == 0
            same = _Groups([h], keys[text])
            several = (same.most > same.least)[same.group]
            at = same.of_least()
            yield _rows(
                _answered(same.keys[several], _upper(h[same.order][several]), n_buckets)
                + _packed(
                    _bucket_of(h[at], n_buckets), [_upper(h[at]), same.any(anchor)], text[at], keys
                ),
                _SENT,
            )

    return send


def _gathered(batches, kinds) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(numbers, keys) of all entries of each bucket, which come together, and the
    answers that come with them as rows."""
    at, held = None, []

    def whole():
        *numbers, keys = (np.concatenate(c) for c in zip(*held))
        held.clear()
        return numbers, keys

    for batch in batches:
        answers = []
        for bucket, key, docs, low, high, doc in zip(*(c.to_pylist() for c in batch.columns)):
            if key is not None:
                answers.append((key, low))
                continue
            if bucket != at and held:
                yield whole()
            at = bucket
            keys = np.frombuffer(docs, np.int64)[np.frombuffer(doc, np.uint16)]
            held.append((np.frombuffer(low, kinds[0]), np.frombuffer(high, kinds[1]), keys))
        yield answers
    if held:
        yield whole()


def _in_parts(numbers: list[np.ndarray], keys: np.ndarray) -> Iterator[tuple]:
    """The entries of a bucket in parts; those with equal numbers share one."""
    n = -(-len(keys) // _AT_ONCE)
    if n <= 1:
        yield numbers, keys
        return
    part = numbers[0] % n
    for i in range(n):
        at = np.flatnonzero(part == i)
        yield [x[at] for x in numbers], keys[at]


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return _rows(list(_by_key(*(np.concatenate(c) for c in zip(*found)))), _FOUND)


def _hits(batches):
    """Stretches that are an anchor somewhere and found in more than one document."""
    for found in _gathered(batches, _PROBE_KINDS):
        if isinstance(found, list):
            yield _rows(found, _FOUND)
            continue
        hits = []
        for (h, anchor), keys in _in_parts(*found):
            same = _Groups([h], keys)
            hit = ((same.most > same.least) & same.any(anchor))[same.group]
            hits.append((same.keys[hit], h[same.order[hit]]))
        yield _joined(hits)


def _repeats(batches):
    """Windows that a smaller document has."""
    for found in _gathered(batches, _WINDOW_KINDS):
        if isinstance(found, list):
            yield _rows(found, _FOUND)
            continue
        repeats = []
        for (low, high), keys in _in_parts(*found):
            same = _Groups([low, high], keys)
            repeated = same.keys > same.least[same.group]
            repeats.append((same.keys[repeated], low[same.order[repeated]]))
        yield _joined(repeats)


def _is_in(h: np.ndarray, parts: list[bytes], kind) -> np.ndarray:
    return np.isin(h, np.frombuffer(b"".join(parts), kind))


def _windows_around(window: int, block: int, n_buckets: int):
    """Every window that holds a hit whole. Of windows of several documents of the
    batch, all but the smallest document's are repeats."""

    def send(batches):
        for batch in text_batches(batches, 3 << 20):
            keys, found = batch["key"].to_numpy(), batch["found"].to_pylist()
            words = _Words.of(_utf8(batch["text"]))
            near, far = (_Stretches(words.hashes, b) for b in _WORD_BASES)
            start, text = words.stretches(block)
            h = _upper(near.of(start, start + block))
            ends = np.searchsorted(text, np.arange(len(keys)), side="right")
            hit, at = np.zeros(len(words.hashes) + 1, dtype=np.int64), 0
            for parts, end in zip(found, ends):
                hit[start[at:end]] = _is_in(h[at:end], parts, np.uint32)
                at = end
            before = np.concatenate([[0], np.cumsum(hit)])
            start, text = words.stretches(window)
            holds = before[start + window - block + 1] > before[start]
            start, text = start[holds], text[holds]
            if not len(start):
                continue
            low = far.of(start, start + window)
            high = (near.of(start, start + window) >> _U(48)).astype(np.uint16)
            same = _Groups([low, high], keys[text])
            repeated = same.keys > same.least[same.group]
            at = same.of_least()
            yield _rows(
                _answered(same.keys[repeated], low[same.order][repeated], n_buckets)
                + _packed(
                    _bucket_of(near.of(start[at], start[at] + window), n_buckets),
                    [low[at], high[at]], text[at], keys,
                ),
                _SENT,
            )

    return send


def _without(window: int, text_col: str):
    """Texts without the words of repeated windows."""

    def remove(batches):
        for batch in text_batches(batches, 3 << 20):
            raw = _utf8(batch["row"].field(text_col))
            found = batch["found"].to_pylist()
            asked = [i for i, parts in enumerate(found) if parts]
            words = _Words.of([raw[i] for i in asked])
            low = _Stretches(words.hashes, _WORD_BASES[1])
            split = [r.split() for r in raw]
            removed, spans = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
            for i, first, last in zip(asked, words.first, words.last):
                start = np.arange(first, last - window + 1)
                if not len(start):
                    continue
                repeated = np.flatnonzero(_is_in(low.of(start, start + window), found[i], _U))
                depth = np.zeros(last - first + 1, dtype=np.int64)
                depth[repeated] += 1
                depth[repeated + window] -= 1
                gone = np.cumsum(depth)[:-1] > 0
                removed[i] = gone.sum()
                spans[i] = (gone[1:] & ~gone[:-1]).sum() + gone[0]
                split[i] = list(compress(split[i], (~gone).tolist()))
            kept = [b" ".join(w) for w in split]
            n_words = np.array([len(w) for w in split], dtype=np.int64) + removed
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(n_words), pa.array(removed), pa.array(spans),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                ["row", "n_words", "n_removed", "n_spans", "kept"],
            )

    return remove


def _dealt_again(kinds, n_parts: int):
    """Entries of each bucket dealt to ``n_parts`` buckets by their first number."""

    def deal(batches):
        at, held, n, n_docs = None, [], 0, 0

        def flushed():
            *numbers, keys = (np.concatenate(c) for c in zip(*held))
            spoken, doc = np.unique(keys, return_inverse=True)
            part = _bucket_of(numbers[0].astype(_U), n_parts)
            return _rows(_packed(at * n_parts + part, numbers, doc, spoken), _SENT)

        for batch in batches:
            answers = []
            for bucket, key, docs, low, high, doc in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None:
                    answers.append((bucket * n_parts, key, None, low, None, None))
                    continue
                if held and (bucket != at or n >= _ENTRIES or n_docs >= _DOCS - len(docs) // 8):
                    yield flushed()
                    held, n, n_docs = [], 0, 0
                at = bucket
                keys = np.frombuffer(docs, np.int64)
                by = keys[np.frombuffer(doc, np.uint16)]
                held.append((np.frombuffer(low, kinds[0]), np.frombuffer(high, kinds[1]), by))
                n, n_docs = n + len(by), n_docs + len(keys)
            yield _rows(answers, _SENT)
        if held:
            yield flushed()

    return deal


_PROBE_KINDS, _WINDOW_KINDS = (np.uint32, bool), (_U, np.uint16)


def _answers(sent: DataFrame, judge, kinds, dealing: tuple[int, int]) -> DataFrame:
    """What the batches found themselves and what ``judge`` finds in each bucket."""
    n_first, n_parts = dealing
    dealt = sent.repartition(n_first, "bucket").sortWithinPartitions("bucket")
    if n_parts > 1:
        dealt = (
            dealt.mapInArrow(_dealt_again(kinds, n_parts), _SENT)
            .repartition(n_first * n_parts, "bucket")
            .sortWithinPartitions("bucket")
        )
    found = dealt.mapInArrow(judge, _FOUND)
    return found.groupBy("key").agg(F.collect_list("hashes").alias("found"))


def remove_shared_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``row`` (the document's row), ``n_words``, ``n_removed``, ``n_spans`` (maximal
    runs of removed words) and ``kept``, the words that stay joined by one space.

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller id; windows are those of the input. Words are split at
    ASCII white space. A null text has no words; a null id is larger than any
    other, and rows with equal ids are not smaller than each other. Ids that are
    not integers are ranked first, rows of one such id by their text. An empty table
    gives an empty result.
    """
    block = window // 2
    if block < 1:
        raise ValueError("a window needs at least two words")
    if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        key = F.coalesce(field(id_col).cast("bigint"), F.lit(_NULL_KEY))
        rows = packed(docs).select(key.alias("key"), "row")
    else:
        rows = with_keys(docs, id_col, text_col).select("key", "row")
    texts = rows.select("key", text_of(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(32, -(-size // BUCKET_BYTES))
    dealing = (min(n_buckets, BUCKETS_AT_ONCE), -(-n_buckets // BUCKETS_AT_ONCE))

    probes = texts.mapInArrow(_probes(block, dealing[0]), _SENT)
    hits = written(_answers(probes, _hits, _PROBE_KINDS, dealing), "hits", _SMALL_BATCHES)
    around = texts.join(hits, "key").mapInArrow(_windows_around(window, block, dealing[0]), _SENT)
    repeats = written(
        _answers(around, _repeats, _WINDOW_KINDS, dealing), "repeats", _SMALL_BATCHES
    )
    kind = dict(rows.dtypes)["row"]
    return rows.join(repeats, "key", "left").select("row", "found").mapInArrow(
        _without(window, text_col),
        f"row {kind}, n_words bigint, n_removed bigint, n_spans bigint, kept string",
    )
