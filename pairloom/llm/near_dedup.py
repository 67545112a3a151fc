"""Near-duplicate classes of documents: DartMinHash signatures, banded joining,
exact verification, connected components.

Documents with the same shingle set are folded into one first. In each bucket of
a band the most connected document leads, and only leader and member are
compared: a bucket of any size costs one pair per member. What stays open
afterwards (pairs of one bucket that are in different classes) is compared too
where the differences from the leader leave it possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import KEY_FILTER, text_batches, with_keys, written
from pairloom.llm.components import connected_components
from pairloom.llm.minhash import DartMinHash, mix

WORDS = 5
SIMILARITY = 0.8
# A pair at similarity 0.8 meets in no band once in 2 700, at 0.85 in 200 000.
BANDS, ROWS_PER_BAND = 26, 6
_CACHE = 400_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, cache: dict[bytes, int], n_words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n_words`` words (split at
    ASCII white space). A shorter text is one shingle; no words give none."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(cache) > _CACHE:
        cache.clear()
    get, ids = cache.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    h = np.array(ids, dtype=np.uint64)
    n = min(n_words, len(h))
    run = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        run = run * _PRIME + h[i : len(h) - n + 1 + i]
    return np.unique(mix(run + np.uint64(n)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    darts, cache = DartMinHash(BANDS * ROWS_PER_BAND), {}
    powers = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(ROWS_PER_BAND)], dtype=np.uint64)
    salts = np.arange(1, BANDS + 1, dtype=np.uint64) * _PRIME
    for batch in text_batches(batches):
        keys, n, d1, d2, bands = [], [], [], [], []
        for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
            s = shingle_hashes(text, cache)
            keys.append(key)
            n.append(len(s))
            d1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
            d2.append(int(mix(s + _PRIME).sum(dtype=np.uint64).astype(np.int64)))
            if not len(s):
                bands.append([])
                continue
            sig = darts.signature(s).reshape(BANDS, ROWS_PER_BAND)
            bands.append(mix((sig * powers).sum(axis=1, dtype=np.uint64) + salts).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()),
                pa.array(n, pa.int64()),
                pa.array(d1, pa.int64()),
                pa.array(d2, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            ["key", "n", "d1", "d2", "bands"],
        )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[bytes, int] = {}
    for batch in text_batches(batches):
        sets = [shingle_hashes(t, cache).view(np.int64) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["key"], pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"]
        )


def _verified(
    pairs: DataFrame, sets: DataFrame, least: float, differences: bool = False
) -> DataFrame:
    """``pairs`` (a, b) whose exact Jaccard similarity ``sim`` is at least
    ``least``; with set sizes and the symmetric difference where asked for. Sizes
    alone rule some out before the sets are fetched."""
    n = F.size("shingles")
    sizes = sets.select("key", n.alias("n"))
    fitting = (
        pairs.join(sizes.select(F.col("key").alias("a"), F.col("n").alias("na")), "a")
        .join(sizes.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
        .where(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb"))
        .select("a", "b")
    )
    both = fitting.join(
        sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b"
    ).join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    scored = both.withColumn("sim", shared / (F.size("sa") + F.size("sb") - shared))
    scored = scored.where(F.col("sim") >= least)
    if not differences:
        return scored.select("a", "b", "sim")
    diff = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
    return scored.select(
        "a", "b", "sim", F.size("sa").alias("na"), F.size("sb").alias("nb"), diff.alias("diff")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs``: ``row``, ``class_key``, ``class_id`` and
    ``kept``.

    Two documents are linked when their sets of five-word shingles have a Jaccard
    similarity of at least ``similarity``; a class is a connected component, its
    id is its smallest document id, and that document stays. A text without words
    (null, empty) is in a class of its own; one with fewer than five words is one
    shingle. Null ids come last; rows that share id and text are one document. An
    empty table gives an empty result.
    """
    keyed = with_keys(docs, id_col, text_col)
    signed = written(
        keyed.select("key", "text").mapInArrow(
            _signatures, "key bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"
        ),
        "signatures",
    )
    content = ["n", "d1", "d2"]
    # One document per distinct shingle set; copies fold map-side. Written, so
    # that the copies of one text can be split in the join.
    reps = written(
        signed.where("n > 0").groupBy(*content).agg(F.min("key").alias("rep")), "representatives"
    )
    folded = written(
        signed.join(reps, content, "left").select(
            "key", F.coalesce("rep", "key").alias("rep"), "n",
            F.when(F.col("key") == F.col("rep"), F.col("bands")).alias("bands"),
        ),
        "folded",
    )
    rows = folded.where("bands is not null").select("key", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = written(rows.join(shared, "bucket"), "members")
    # Leaders: the documents that meet the most others.
    ties = members.groupBy("key").agg(F.sum("m").alias("meets"))
    members = written(members.join(ties, "key"), "ranked-members")
    leaders = members.groupBy("bucket").agg(
        F.max(F.struct("meets", F.negative("key").alias("minus"))).alias("top")
    ).select("bucket", F.negative("top.minus").alias("leader"))
    led = written(members.join(leaders, "bucket").select("bucket", "key", "n", "leader"), "led")
    # Spark derives a key filter only from a side that has a condition; n is
    # never 0 here.
    involved = led.where("n > 0").select("key")
    sets = written(
        keyed.select("key", "text").join(involved, "key", "left_semi").mapInArrow(
            _shingles, "key bigint, shingles array<bigint>"
        ).dropDuplicates(["key"]),
        "shingles",
        KEY_FILTER,
    )
    star = led.where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b"))
    # A pair of sets below 2 * similarity - 1 cannot matter: by the triangle
    # inequality no member of the leader's class is then linked to the other.
    useful = max(0.0, 2 * similarity - 1)
    sims = written(_verified(star.distinct(), sets, useful, differences=True), "sims")
    edges = sims.where(F.col("sim") >= similarity).select("a", "b")
    labels = written(connected_components(edges), "labels")
    more = _near_pairs(sims, labels, similarity).unionByName(
        _far_pairs(led, sims, sets, labels, similarity)
    )
    more = written(more.distinct(), "open-pairs")
    if not more.isEmpty():
        found = _verified(more, sets, similarity)
        edges = written(edges.unionByName(found.select("a", "b")), "edges")
        labels = written(connected_components(edges), "labels")
    classes = folded.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select(
        "key", F.coalesce("label", "rep").alias("class_key")
    )
    classes = classes.dropDuplicates(["key"])
    own_id = F.col("row").getField(id_col)
    joined = keyed.select("key", "row").join(classes, "key")
    # Ids of the documents that stand for others; written, so that a large class
    # can be split in the join.
    heads = classes.where("key <> class_key").select("class_key").distinct()
    names = keyed.select(F.col("key").alias("class_key"), own_id.alias("head_id"))
    names = written(names.join(heads, "class_key", "left_semi").dropDuplicates(["class_key"]), "heads")
    kept = F.col("key") == F.col("class_key")
    return joined.join(names, "class_key", "left").select(
        "row",
        "class_key",
        F.when(kept, own_id).otherwise(F.col("head_id")).alias("class_id"),
        kept.alias("kept"),
    )


def _near_pairs(sims: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs of two documents led by one leader c that may be linked although
    one of them, x, is not linked to c.

    With D the difference from c, |Dx| > q (|x| + |c|), q = (1 - s) / (1 + s). So
    x and y share more than t = (|Dy| + q (|c| - |y|)) / 2 elements of Dy, and x
    holds one of the |Dy| - floor(t) rarest: a pair needs a rare edit in common,
    and copies with edits of their own never meet.
    """
    q = (1 - similarity) / (1 + similarity)
    loose = F.col("sim") < similarity
    open_leaders = sims.where(loose).select("a").distinct()
    edits = sims.join(open_leaders, "a", "left_semi").select(
        "a", "b", loose.alias("loose"), F.size("diff").alias("size"), F.col("nb").alias("n"),
        # A little more than needed, against rounding.
        (F.size("diff") - F.floor((F.size("diff") + q * (F.col("na") - F.col("nb"))) / 2 - 1e-9)).alias("first"),
        F.explode("diff").alias("e"),
    )
    return _sharing_rare(edits, labels, similarity)


def _far_pairs(
    led: DataFrame, sims: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float
) -> DataFrame:
    """Pairs with a member so far from its leader that it can only be linked to
    members of a bucket that are not linked to the leader either.

    They are told apart by whole sets, as differences from an empty leader: of a
    set of n, a linked one shares at least s n elements, hence one of the
    n - s n + 1 rarest. Members that have only a common passage never meet.
    """
    known = sims.select(F.col("a").alias("leader"), F.col("b").alias("key"), "sim")
    apart = (
        led.where("key <> leader")
        .join(known, ["leader", "key"], "left")
        .where(F.col("sim").isNull() | (F.col("sim") < similarity))
        .select("bucket", "key", F.col("sim").isNull().alias("far"))
    )
    open_buckets = apart.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.max("far").alias("any"))
    open_buckets = open_buckets.where("m > 1 and any").select("bucket")
    concerned = apart.join(open_buckets, "bucket", "left_semi").groupBy("key").agg(F.max("far").alias("loose"))
    n = F.size("shingles")
    elements = sets.join(concerned, "key").select(
        F.lit(0).cast("long").alias("a"), F.col("key").alias("b"), "loose",
        n.alias("size"), n.alias("n"),
        (n - F.ceil(similarity * n - 1e-9) + 1).alias("first"),
        F.explode("shingles").alias("e"),
    )
    return _sharing_rare(elements, labels, similarity)


def _sharing_rare(edits: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of two classes, one of them ``loose``, that share one of the
    ``first`` rarest elements of the other and may be linked.

    Linked sets share at least m = (|Dx| + |Dy| - q (|x| + |y|)) / 2 elements. The
    rarest that they share leaves m - 1 behind it on either side, which bounds
    its place in both orders.
    """
    q = (1 - similarity) / (1 + similarity)
    edits = written(edits, "edits")
    often = edits.groupBy("a", "e").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    rarity = Window.partitionBy("a", "b").orderBy("often", "e")
    # Elements seen once have no partner but count in the order.
    ranked = edits.join(often, ["a", "e"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    ranked = ranked.withColumn("nth", F.row_number().over(rarity)).where("often > 1")
    ranked = ranked.withColumn("rare", F.col("nth") <= F.col("first")).where("loose or rare")
    classes = labels.select(F.col("node").alias("b"), "label")
    ranked = ranked.join(classes, "b", "left").withColumn("label", F.coalesce("label", "b"))
    ranked = written(
        ranked.select("a", "b", "loose", "rare", "size", "n", "e", "nth", "label"), "rare-edits"
    )
    x, y = ranked.where("loose").alias("x"), ranked.where("rare").alias("y")
    least = (F.col("x.size") + F.col("y.size") - q * (F.col("x.n") + F.col("y.n"))) / 2 - 1e-9
    met = x.join(
        y,
        (F.col("x.a") == F.col("y.a"))
        & (F.col("x.e") == F.col("y.e"))
        & (F.col("x.label") != F.col("y.label"))
        # Of two loose ones either holds a rare element of the other.
        & (~F.col("y.loose") | (F.col("x.rare") & (F.col("x.b") < F.col("y.b"))))
        & (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9)
        & (F.col("x.size") - F.col("x.nth") + 1 >= least)
        & (F.col("y.size") - F.col("y.nth") + 1 >= least),
    )
    return met.select(
        F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")
    ).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with the columns of ``docs``."""
    return near_duplicates(docs, id_col, text_col).where("kept").select("row.*")
