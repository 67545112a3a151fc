"""Removal of repeated byte strings by prefix-free parsing.

Rolling-hash triggers: the position of the least rolling hash among those of one
string of ``length`` bytes is a trigger, so every string holds the trigger that
it alone determines. The phrase of a trigger reaches as far as any string whose
trigger it is. Phrases seen once cannot hold a repeated string and drop out
after one count of their triggers; of equal phrases the first in corpus order
stands in the dictionary, and all others are repeats as a whole. What remains is
the dictionary: the strings of phrases that share a trigger but differ are put
in order by their content, then by the place of their phrase in the corpus, and
all but the first of equal ones are repeats too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import text_batches, with_keys, written
from pairloom.llm.minhash import mix

LENGTH = 100
TRIGGER = 32
# Positions of one pass over a text; the low bits of a sort key hold them.
_SLICE = 1 << 20
_PLACE_BITS = np.uint64(24)
_U = np.uint64
_MASK = (1 << 64) - 1
# Odd bases of the rolling hashes (fixed values).
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
# Triggers above this share of a sample are dealt over several tasks.
HEAVY_SHARE = 1 / 4_000
SAMPLE_SHARE = 1 / 64
# Phrases of one trigger that one task compares.
CROWD = 32_768


class Rolling:
    """Hashes of any substring of a byte array, from running sums."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        self.power = _powers(base, n + 1)
        inverse = _powers(pow(base, -1, 1 << 64), n + 1)
        sums = (data.astype(_U) + _U(1)) * inverse[:n]
        self.sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(sums, dtype=_U)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.power[start])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base & _MASK, dtype=_U)
        known[0] = 1
        known = _POWERS[base] = np.cumprod(known, dtype=_U)
    return known[:n]


def _triggers_of_strings(rolling: Rolling, n: int, length: int, trigger: int) -> np.ndarray:
    """For every start of a string of ``length``, the place of its trigger: the
    least hash, the leftmost of equal ones."""
    grams = n - trigger + 1
    start = np.arange(grams)
    h = rolling.of(start, start + trigger)
    h = (h >> _PLACE_BITS << _PLACE_BITS) | start.astype(_U)
    least, reach, want = h, 1, length - trigger + 1
    while reach * 2 <= want:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < want:
        least = np.minimum(least[: len(least) - (want - reach)], least[want - reach :])
    return (least & _U((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, trigger: int):
    """For pieces of a buffer of texts: (rolling of the piece, its offset, starts
    of strings in the piece, their triggers, text number of each string)."""
    margin = length
    for at in range(0, len(data), _SLICE):
        lo, hi = max(0, at - margin), min(len(data), at + _SLICE + 2 * margin)
        if hi - lo < length:
            continue
        rolling = Rolling(data[lo:hi], _BASES[0])
        trig = _triggers_of_strings(rolling, hi - lo, length, trigger)
        s = np.arange(at - lo, min(at + _SLICE - lo, len(trig)))
        text = np.searchsorted(starts, s + lo, side="right") - 1
        fits = s + lo + length <= ends[text]
        s, text = s[fits], text[fits]
        yield rolling, lo, s, trig[s], text


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    starts = ends - [len(r) for r in raw]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), starts, ends


def _phrases(length: int, trigger: int):
    """Every trigger of every text once, with hashes of trigger and phrase."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            keys = batch["key"].to_numpy()
            data, starts, ends = _buffer(batch["text"].to_pylist())
            # Searches skip empty texts: they start where the next one does.
            last = -1
            for rolling, lo, s, trig, text in _slices(data, starts, ends, length, trigger):
                if not len(s):
                    continue
                new = np.append(True, (trig[1:] != trig[:-1]) | (text[1:] != text[:-1]))
                at, of = trig[new], text[new]
                if at[0] + lo == last:
                    at, of = at[1:], of[1:]
                if not len(at):
                    continue
                last = int(at[-1]) + lo
                left = np.maximum(at - (length - trigger), starts[of] - lo)
                right = np.minimum(at + length, ends[of] - lo)
                phrase = rolling.of(left, right)
                shape = ((at - left) << 32 | (right - left)).astype(_U)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rolling.of(at, at + trigger).view(np.int64)),
                        pa.array(mix(phrase ^ mix(shape + _U(1))).view(np.int64)),
                        pa.array(keys[of]),
                        pa.array((at + lo - starts[of]).astype(np.int32)),
                    ],
                    ["trigger", "phrase", "key", "at"],
                )

    return parse


_CONTEXT_SCHEMA = "trigger bigint, key bigint, at int, crowded boolean, lead int, content binary"


def _contexts(length: int, trigger: int):
    """The bytes of the listed phrases."""
    reach = length - trigger

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            out: list[list] = [[] for _ in range(6)]
            for key, text, listed in zip(*(batch[c].to_pylist() for c in ("key", "text", "listed"))):
                raw = text.encode("utf-8", "surrogatepass")
                for one in listed:
                    at = one["at"]
                    lo = max(0, at - reach)
                    row = (one["trigger"], key, at, one["crowded"], at - lo, raw[lo : at + length])
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)],
                ["trigger", "key", "at", "crowded", "lead", "content"],
            )

    return cut


def _own_strings(contents: list[bytes], leads: np.ndarray, length: int, trigger: int):
    """The strings of each phrase whose trigger is the phrase's own: (phrase
    number, start in the phrase, two hashes)."""
    ends = np.cumsum([len(c) for c in contents])
    starts = ends - [len(c) for c in contents]
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    parts = []
    for rolling, lo, s, trig, of in _slices(data, starts, ends, length, trigger):
        own = trig + lo == starts[of] + leads[of]
        s, of = s[own], of[own]
        other = Rolling(data[lo : lo + len(rolling.sums) - 1], _BASES[1])
        parts.append((of, s + lo - starts[of], rolling.of(s, s + length), other.of(s, s + length)))
    if not parts:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, _U),) * 2
    return tuple(np.concatenate(c) for c in zip(*parts))


def _later_strings(length: int, trigger: int):
    """Rows sorted by trigger and place to the stretches of strings that an
    earlier phrase of the same trigger holds too. The strings of a trigger are
    put in order by content, then by place: the first of equal ones stays."""

    def stretches(rows: list[np.ndarray]) -> pa.RecordBatch:
        trig, key, at, lead, content = rows
        of, start, h1, h2 = _own_strings(list(content), lead, length, trigger)
        order = np.lexsort((of, h2, h1, trig[of]))
        same = np.zeros(len(order), dtype=bool)
        a, b = order[1:], order[:-1]
        same[a] = (trig[of[a]] == trig[of[b]]) & (h1[a] == h1[b]) & (h2[a] == h2[b])
        keep = np.lexsort((start, of))
        keep = keep[same[keep]]
        of, start = of[keep], start[keep]
        if not len(of):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["key", "start", "end"])
        begins = np.append(True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1))[: len(of)]
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(of)) - 1
        base = (at - lead)[of[first]].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key[of[first]]),
                pa.array(base + start[first]),
                pa.array(base + start[last] + length),
            ],
            ["key", "start", "end"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        names = ("trigger", "key", "at", "lead", "content")
        for batch in text_batches(batches):
            rows = [batch[c].to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows)]
            # The last trigger may go on in the next batch.
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield stretches([c[:cut] for c in rows])
            held = [c[cut:] for c in rows]
        if held is not None:
            yield stretches(held)

    return work


def _strings(length: int, trigger: int):
    """All strings of crowded phrases, with 128 bits of hash each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1 << 20):
            lead = batch["lead"].to_numpy()
            of, start, h1, h2 = _own_strings(batch["content"].to_pylist(), lead, length, trigger)
            at = batch["at"].to_numpy()[of] - lead[of] + start
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                    pa.array(batch["key"].to_numpy()[of]), pa.array(at.astype(np.int32)),
                ],
                ["h1", "h2", "key", "at"],
            )

    return cut


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        out = []
        for key, text, spans in zip(
            batch["key"].to_pylist(), batch["text"].to_pylist(), batch["spans"]
        ):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            n = len(raw)
            if spans.is_valid and len(spans.values):
                flat = spans.values.flatten()
                start, end = np.maximum(flat[0].to_numpy(), 0), np.minimum(flat[1].to_numpy(), n)
                depth = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
                gone = np.cumsum(depth)[:n] > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
                out.append((key, n, int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            else:
                out.append((key, n, 0, 0, hashlib.sha256(raw.tobytes()).hexdigest()))
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("key", "n_bytes", "n_removed", "n_spans", "kept_sha256"), r)) for r in out],
            schema=pa.schema(
                [("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                 ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
            ),
        )


def _heavy_triggers(keyed: DataFrame, parse) -> list[int]:
    """Triggers of a large share of a sample of texts: they are spread over
    tasks. They are repeated for certain, being seen twice at least."""
    sample = keyed.select("key", "text").sample(False, SAMPLE_SHARE, 23)
    counts = written(
        sample.mapInArrow(parse, _PHRASE_SCHEMA)
        .dropDuplicates(["trigger", "key", "at"]).groupBy("trigger").count(), "sample-triggers"
    )
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(20, int(total * HEAVY_SHARE))
    return [r[0] for r in counts.where(F.col("count") >= least).select("trigger").collect()]


_PHRASE_SCHEMA = "trigger bigint, phrase bigint, key bigint, at int"


def repeated_spans(keyed: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """``key``, ``start``, ``end`` of stretches whose bytes lie in strings of
    ``length`` bytes that also start earlier (smaller key, or same key and
    earlier start). Stretches may overlap and may pass the ends of the text."""
    reach = length - trigger
    parse = _phrases(length, trigger)
    heavy = _heavy_triggers(keyed, parse)
    phrases = keyed.select("key", "text").mapInArrow(parse, _PHRASE_SCHEMA)
    is_heavy = F.col("trigger").isin(heavy) if heavy else F.lit(False)
    salt = F.when(is_heavy, F.pmod(F.xxhash64("key", "at"), F.lit(1 << 10))).otherwise(F.lit(0))
    together = Window.partitionBy("trigger", "salt")
    counted = phrases.withColumn("salt", salt.cast("int")).withColumn("n", F.count(F.lit(1)).over(together))
    seen = written(
        counted.where((F.col("n") > 1) | is_heavy).select(
            "trigger", "phrase", "key", "at", F.when(~is_heavy, F.col("n")).alias("n")
        ),
        "repeated-triggers",
    )
    place = F.struct("key", "at")
    # The parse: of equal phrases the first in corpus order.
    firsts = seen.groupBy("trigger", "phrase").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("m"), F.max("n").alias("n")
    )
    firsts = written(firsts, "dictionary")
    copies = seen.select("trigger", "phrase", "key", "at").join(
        firsts.where("m > 1").select("trigger", "phrase", "first"), ["trigger", "phrase"]
    ).where(place != F.col("first"))
    whole = copies.select(
        "key", (F.col("at") - reach).alias("start"), (F.col("at") + length).alias("end")
    )
    # Phrases that share their trigger with another phrase.
    differing = firsts.where("n is null or m < n").select("trigger", "first.key", "first.at")
    sizes = differing.groupBy("trigger").agg(F.count(F.lit(1)).alias("size"))
    crowd = sizes.where(F.col("size") > CROWD).select("trigger", F.lit(True).alias("crowded"))
    alone = sizes.where("size = 1").select("trigger")
    differing = (
        differing.join(alone, "trigger", "left_anti")
        .join(crowd, "trigger", "left")
        .withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    )
    listed = differing.groupBy("key").agg(
        F.collect_set(F.struct("at", "trigger", "crowded")).alias("listed")
    )
    contexts = written(
        keyed.select("key", "text").join(listed, "key").mapInArrow(
            _contexts(length, trigger), _CONTEXT_SCHEMA
        ),
        "contexts",
    )
    few = contexts.where("not crowded").repartition("trigger").dropDuplicates(["trigger", "key", "at"])
    few = few.sortWithinPartitions("trigger", "key", "at")
    parts = few.select("trigger", "key", "at", "lead", "content").mapInArrow(
        _later_strings(length, trigger), "key bigint, start bigint, end bigint"
    )
    # Triggers with very many phrases: their strings are compared one by one,
    # by joins that no group can overload.
    strings = written(
        contexts.where("crowded").mapInArrow(
            _strings(length, trigger), "h1 bigint, h2 bigint, key bigint, at int"
        ),
        "strings",
    )
    order = strings.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("m"))
    later = strings.join(order.where("m > 1"), ["h1", "h2"]).where(place != F.col("first"))
    more = later.select("key", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    return whole.unionByName(parts).unionByName(more)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
) -> DataFrame:
    """One row per row of ``docs``: ``row``, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256``.

    A byte of the UTF-8 text (null: empty) is removed when a string of ``length``
    bytes that covers it also starts earlier: in a document of smaller id, or
    earlier in the same one. Strings never cross documents; overlaps count;
    strings are judged on the input. Null ids come last, and rows that share id
    and text are one document. An empty table gives an empty result.
    """
    keyed = with_keys(docs, id_col, text_col)
    spans = repeated_spans(keyed, length)
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    lists = written(lists, "spans")
    digests = keyed.select("key", "text").join(lists, "key", "left").mapInArrow(
        _removed, "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
    return keyed.select("key", "row").join(digests.dropDuplicates(["key"]), "key").drop("key")
