"""Blocking: which record pairs are worth comparing at all.

Each channel gives a record zero or more block keys; two records are a
candidate pair when they share a key in some channel. The channels are not
joined one by one: a table is exploded once to *memberships*
``(entity_id, tokens, channel, block_key)`` and one equi-join on
``(channel, block_key)`` serves all of them.

The pair lists returned by :func:`candidate_pairs` are as long as the block
sizes multiply to. The batch jobs do not build them: they call
:func:`pairloom.operators.topk.top_candidates`, which finds the same best
candidates without listing the pairs of a hot block.
"""

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators.skew import (
    PAIRS_PER_TASK,
    broadcast_if_small,
    heavy_blocks,
    join_split,
    salted_join,
)
from pairloom.operators.staging import stage

# Channel names and the rare-gram limit.
NAME, ADDRESS, POSTAL, HOUSE_NAME = "name", "address", "postal", "house_name"
KEY_CHANNELS = [NAME, ADDRESS, POSTAL, HOUSE_NAME]
RARE_GRAM = "rare_gram"
RARE_GRAM_MAX_DOC_FREQ = 0.001

# Different grams of normalized text: 26 letters, 10 digits and the space.
MAX_GRAMS = 37**text.GRAM_LENGTH

BLOCK = ["channel", "block_key"]


def _block_keys(empty_keys: str) -> dict[str, Column]:
    """Block key per channel, NULL where a record has none.

    Records without a postal code or house number carry the empty string.
    ``empty_keys='keep'`` lets them share a block, ``'drop'`` gives them none.
    """
    if empty_keys not in ("keep", "drop"):
        raise ValueError(f"empty_keys must be 'keep' or 'drop', not {empty_keys!r}")

    def filled(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    house, postal = F.col("house_number"), F.col("postal_code")
    if empty_keys == "drop":
        house, postal = filled(house), filled(postal)
    return {
        NAME: filled(F.col("name_norm")),
        ADDRESS: filled(F.col("address_norm")),
        POSTAL: postal,
        # House numbers hold digits only, so the first space ends them.
        HOUSE_NAME: F.concat(house, F.lit(" "), text.first_token(F.col("name_norm"))),
    }


def key_memberships(
    normalized: DataFrame, channels: list[str] = KEY_CHANNELS, empty_keys: str = "keep"
) -> DataFrame:
    keys = _block_keys(empty_keys)
    blocks = F.array(
        *[F.struct(F.lit(c).alias("channel"), keys[c].alias("block_key")) for c in channels]
    )
    # Tokens are computed before the explode: once per record, not per key.
    return (
        normalized.select(
            "entity_id", text.tokens(F.col("name_norm")).alias("tokens"), blocks.alias("blocks")
        )
        .select("entity_id", "tokens", F.explode("blocks").alias("b"))
        .select("entity_id", "tokens", "b.channel", "b.block_key")
        .where(F.col("block_key").isNotNull())
    )


def gram_rows(normalized: DataFrame) -> DataFrame:
    """``(entity_id, gram)``, one row per gram occurrence."""
    return normalized.select("entity_id", F.explode(text.grams(F.col("name_norm"))).alias("gram"))


def entity_total(normalized: DataFrame) -> DataFrame:
    return normalized.agg(F.count_distinct("entity_id").alias("n_entities"))


def gram_document_frequency(normalized: DataFrame) -> DataFrame:
    """``(gram, df)``: distinct entities whose name contains the gram."""
    # Few input files may hold all rows: they are dealt to all tasks first.
    names = normalized.select("entity_id", "name_norm").repartition("entity_id")
    alone, many = _by_repeats(names, "repeated-gram")

    def grams(df: DataFrame) -> DataFrame:
        distinct = F.array_distinct(text.grams(F.col("name_norm")))
        # An inner explode would have Spark filter by the grams' number before the
        # rows are dealt, and compute the names once per gram for it.
        rows = df.select("entity_id", distinct.alias("grams"))
        rows = rows.select("entity_id", F.explode_outer("grams").alias("gram"))
        return rows.where(F.col("gram").isNotNull())

    # A row of an id of its own is counted as it comes: the map side holds one entry
    # per gram, not one per gram and entity.
    counted = grams(alone).groupBy("gram").agg(F.count("entity_id").alias("df"))
    if many is None:
        return counted
    others = grams(many).groupBy("gram").agg(F.count_distinct("entity_id").alias("df"))
    return counted.unionByName(others).groupBy("gram").agg(F.sum("df").alias("df"))


def _is_rare(s1: DataFrame, max_doc_freq: float) -> Column:
    total = entity_total(s1).scalar()
    return F.col("df").cast("double") / total < F.lit(max_doc_freq)


def rare_grams(s1: DataFrame, max_doc_freq: float = RARE_GRAM_MAX_DOC_FREQ) -> DataFrame:
    return gram_document_frequency(s1).where(_is_rare(s1, max_doc_freq)).select("gram")


def frequent_grams(s1: DataFrame, max_doc_freq: float = RARE_GRAM_MAX_DOC_FREQ) -> DataFrame:
    """``(gram)``: the grams of S1 names that are *not* rare, written once, as
    every rare-gram join reads them.

    This is the smaller side of the split, small enough to broadcast: an entity
    has about as many grams as its name has letters, so at most (mean grams per
    name / ``max_doc_freq``) grams can reach that frequency, and normalized
    text bounds the table at ``MAX_GRAMS`` short rows however many entities
    there are. Readers check the count before they broadcast it.
    """
    frequent = gram_document_frequency(s1).where(~_is_rare(s1, max_doc_freq))
    return stage(frequent.select("gram"), "frequent-grams")


def gram_memberships(normalized: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rare-gram memberships of either side. A gram that no S1 name has passes
    here and finds no partner in the block join."""
    name = F.col("name_norm")
    return (
        normalized.select(
            "entity_id",
            text.tokens(name).alias("tokens"),
            F.array_distinct(text.grams(name)).alias("grams"),
        )
        .select(
            "entity_id",
            "tokens",
            F.lit(RARE_GRAM).alias("channel"),
            F.explode("grams").alias("block_key"),
        )
        .join(frequent.withColumnRenamed("gram", "block_key"), "block_key", "left_anti")
        .select("entity_id", "tokens", *BLOCK)
    )


def memberships(
    s1: DataFrame,
    other: DataFrame,
    channels: list[str],
    empty_keys: str = "keep",
    max_doc_freq: float = RARE_GRAM_MAX_DOC_FREQ,
    frequent: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Memberships of both sides. ``frequent`` takes a ready result of
    :func:`frequent_grams`, for callers with several targets."""
    sides = [[], []]
    keyed = [c for c in channels if c != RARE_GRAM]
    if RARE_GRAM in channels:
        if frequent is None:
            frequent = frequent_grams(s1, max_doc_freq)
        frequent = broadcast_if_small(frequent, MAX_GRAMS)
    for side, df in zip(sides, (s1, other)):
        if keyed:
            side.append(key_memberships(df, keyed, empty_keys))
        if RARE_GRAM in channels:
            side.append(gram_memberships(df, frequent))
    left, right = [reduce(DataFrame.unionByName, side) for side in sides]
    return left, right


def candidate_pairs(
    s1: DataFrame,
    other: DataFrame,
    channels: list[str],
    empty_keys: str = "keep",
    max_doc_freq: float = RARE_GRAM_MAX_DOC_FREQ,
    pairs_per_task: int = PAIRS_PER_TASK,
    with_tokens: bool = False,
) -> DataFrame:
    """Distinct ``(s1_id, other_id)`` sharing a block in any of ``channels``.

    The output lists every pair of every block, so it grows with the product
    of the block sizes. Large blocks are dealt over many tasks. Pairs of ids that
    one row has are listed in the first block they share only, so they are never
    shuffled to be made distinct; those of ids that several rows have are.
    ``with_tokens`` adds the name tokens ``a`` and ``b``, for every row of the ids.
    """
    frequent = frequent_grams(s1, max_doc_freq) if RARE_GRAM in channels else None
    ones, many = _by_repeats(s1, "repeated-s1")
    other_ones, other_many = _by_repeats(other, "repeated-other")
    parts = [
        _listed_once(ones, other_ones, channels, empty_keys, frequent, pairs_per_task, with_tokens)
    ]
    listed = [] if many is None else [(many, other)]
    listed += [] if other_many is None else [(ones, other_many)]
    for first, second in listed:
        left, right = memberships(
            first, second, channels, empty_keys, max_doc_freq, frequent
        )
        left = left.select(*BLOCK, F.col("entity_id").alias("s1_id"))
        right = right.select(*BLOCK, F.col("entity_id").alias("other_id"))
        heavy = heavy_blocks(left, right, BLOCK, pairs_per_task)
        pairs = join_split(left, right, BLOCK, F.col("s1_id"), F.col("other_id"), heavy.calm)
        pairs = pairs.select("s1_id", "other_id").distinct()
        parts.append(with_name_tokens(pairs, first, second) if with_tokens else pairs)
    return reduce(DataFrame.unionByName, parts)


def with_name_tokens(pairs: DataFrame, s1: DataFrame, other: DataFrame) -> DataFrame:
    """Add the name tokens ``a`` and ``b`` to listed pairs."""
    left = s1.select(F.col("entity_id").alias("s1_id"), text.tokens(F.col("name_norm")).alias("a"))
    right = other.select(
        F.col("entity_id").alias("other_id"), text.tokens(F.col("name_norm")).alias("b")
    )
    return salted_join(pairs.join(left, "s1_id"), right, ["other_id"], F.col("s1_id"))


def _listed_once(
    s1: DataFrame,
    other: DataFrame,
    channels: list[str],
    empty_keys: str,
    frequent: DataFrame | None,
    pairs_per_task: int,
    with_tokens: bool,
) -> DataFrame:
    """The pairs of two tables without repeated ids. A membership knows the blocks of
    its record that come before its own: a pair that shares one of them is left to it."""
    keyed = list(dict.fromkeys(c for c in channels if c != RARE_GRAM))
    if frequent is not None:
        frequent = broadcast_if_small(frequent, MAX_GRAMS)
    # Nothing comes before the blocks of a single key channel.
    earlier = keyed if frequent is not None else keyed[:-1]
    names = [f"key_{i}" for i in range(len(earlier))]

    def side(df: DataFrame, row_id: str, tokens: str, mark: str) -> DataFrame:
        keys = _block_keys(empty_keys)
        own = [keys[c].alias(f"{mark}_{n}") for c, n in zip(earlier, names)]
        carried = [F.col("entity_id").alias(row_id), *own]
        if with_tokens:
            carried.append(text.tokens(F.col("name_norm")).alias(tokens))
        columns = [row_id, *[f"{mark}_{n}" for n in names], *([tokens] if with_tokens else [])]
        parts = []
        if keyed:
            blocks = [
                F.struct(F.lit(c).alias("channel"), keys[c].alias("block_key")) for c in keyed
            ]
            rows = df.select(*carried, F.explode(F.array(*blocks)).alias("block"))
            rows = rows.select(*columns, "block.channel", "block.block_key")
            rows = rows.where(F.col("block_key").isNotNull())
            if frequent is not None:
                none = F.array().cast("array<string>")
                rows = rows.withColumns({f"{mark}_grams": none, f"{mark}_bits": F.lit(0).cast("long")})
            parts.append(rows)
        if frequent is not None:
            rare = (
                gram_memberships(df, frequent)
                .groupBy("entity_id")
                .agg(F.sort_array(F.collect_list("block_key")).alias("rare"))
            )
            rows = df.select(*carried).join(
                rare, F.col(row_id).eqNullSafe(F.col("entity_id"))
            )
            rows = rows.select(*columns, "rare", F.posexplode("rare").alias("nth", "block_key"))
            before = F.slice("rare", F.lit(1), F.col("nth"))
            rows = rows.select(
                *columns,
                F.lit(RARE_GRAM).alias("channel"),
                "block_key",
                before.alias(f"{mark}_grams"),
                _bits(before).alias(f"{mark}_bits"),
            )
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    left, right = side(s1, "s1_id", "a", "l"), side(other, "other_id", "b", "r")
    heavy = heavy_blocks(left, right, BLOCK, pairs_per_task)
    pairs = join_split(left, right, BLOCK, F.col("s1_id"), F.col("other_id"), heavy.calm)
    for i, (channel, n) in enumerate(zip(earlier, names)):
        later = [c for c in channels if c not in keyed[: i + 1]]
        shared = F.col(f"l_{n}").isNotNull() & F.col(f"l_{n}").eqNullSafe(F.col(f"r_{n}"))
        pairs = pairs.where(~(F.col("channel").isin(later) & shared))
    if frequent is not None:
        # Few pairs have a bit in common without a gram; only for them and for the
        # repeats the grams themselves are compared.
        apart = F.col("l_bits").bitwiseAND(F.col("r_bits")) == 0
        pairs = pairs.where(apart | ~F.arrays_overlap("l_grams", "r_grams"))
    return pairs.select("s1_id", "other_id", *(["a", "b"] if with_tokens else []))


def _bits(grams: Column) -> Column:
    """One of 64 bits per gram, by its hash."""
    return F.aggregate(
        grams,
        F.lit(0).cast("long"),
        lambda done, gram: done.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(gram), F.lit(64)))
        ),
    )


def _product(a: str, b: str) -> Column:
    """Of two counts, as a decimal: pairs of large blocks pass 64 bits."""
    return (F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")).cast("decimal(38,0)")


def block_sizes(
    s1: DataFrame,
    other: DataFrame,
    channels: list[str] = KEY_CHANNELS,
    empty_keys: str = "keep",
) -> DataFrame:
    """``(channel, block_key, n_s1, n_other, n_pairs)`` of every shared block,
    from counts alone."""
    left, right = memberships(s1, other, channels, empty_keys)
    n_s1 = left.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n_s1"))
    n_other = right.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n_other"))
    return n_s1.join(n_other, BLOCK).withColumn("n_pairs", _product("n_s1", "n_other"))


def _by_repeats(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id no other row has, and the rest, if there is any."""
    # Dealt by id before they are counted, so that no task holds the ids of all rows.
    counted = df.select("entity_id").repartition("entity_id").groupBy("entity_id").count()
    repeated = stage(counted.where("count > 1").select(F.col("entity_id").alias("_id")), label)
    if repeated.isEmpty():
        return df, None
    same = df["entity_id"].eqNullSafe(repeated["_id"])
    return df.join(repeated, same, "left_anti"), df.join(repeated, same, "left_semi")


def candidate_count(s1: DataFrame, other: DataFrame, empty_keys: str = "keep") -> DataFrame:
    """``n_pairs``: distinct ``(s1_id, other_id)`` of the four key channels. Pairs of
    ids that one row has are counted without listing them; those of ids that
    several rows have, whose rows may share different keys, are listed.
    """
    ones, many = _by_repeats(s1, "repeated-s1")
    other_ones, other_many = _by_repeats(other, "repeated-other")
    parts = [_count_of_single_rows(ones, other_ones, empty_keys)]
    listed = [] if many is None else [(many, other)]
    listed += [] if other_many is None else [(ones, other_many)]
    for left, right in listed:
        pairs = candidate_pairs(left, right, KEY_CHANNELS, empty_keys)
        parts.append(pairs.agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n_pairs")))
    total = reduce(DataFrame.unionByName, parts)
    return total.agg(F.sum("n_pairs").cast("decimal(38,0)").alias("n_pairs"))


def _count_of_single_rows(s1: DataFrame, other: DataFrame, empty_keys: str) -> DataFrame:
    """Inclusion-exclusion: a pair is in several channels at once exactly when
    both records share the composite of those channels' keys, so every
    intersection is a sum of products of group counts."""
    subsets = [s for r in range(1, 5) for s in combinations(KEY_CHANNELS, r)]

    def grouped(df: DataFrame, count_name: str) -> DataFrame:
        keys = _block_keys(empty_keys)
        composites = F.array(
            *[
                F.struct(
                    F.lit(i).alias("subset"),
                    F.lit(1 if len(s) % 2 else -1).alias("sign"),
                    # A NULL part makes the whole key NULL; lengths keep the
                    # parts of two different keys from running together.
                    F.concat(
                        *[F.concat(F.length(keys[c]).cast("string"), F.lit(":"), keys[c]) for c in s]
                    ).alias("key"),
                )
                for i, s in enumerate(subsets)
            ]
        )
        return (
            df.select(F.explode(composites).alias("c"))
            .select("c.*")
            .where(F.col("key").isNotNull())
            .groupBy("subset", "sign", "key")
            .agg(F.count(F.lit(1)).alias(count_name))
        )

    both = grouped(s1, "n_s1").join(grouped(other, "n_other"), ["subset", "sign", "key"])
    pairs = _product("n_s1", "n_other")
    return both.agg(
        F.coalesce(
            F.sum(F.when(F.col("sign") > 0, pairs).otherwise(-pairs)), F.lit(0).cast("decimal(38,0)")
        ).alias("n_pairs")
    )
