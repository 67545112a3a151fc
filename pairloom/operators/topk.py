"""The best candidates of every S1 record, without listing hot blocks.

A pair is ranked by the number of shared name tokens (unknown last), then by
the other record's id. The best ``k`` over all blocks are among the best ``k``
of each block, so blocks can be treated one by one:

* A block with few records on the other side is joined as it is.
* A *hot* block goes through an index of token subsets. If ``b`` is one of the
  best of ``a`` and ``S`` is the set of tokens they share, then every record
  containing ``S`` with a smaller id than ``b`` ranks above ``b``; hence ``b``
  is one of the ``k`` smallest ids listed under ``S``. Looking up every subset
  of ``a``'s tokens in an index that lists ``k`` ids per subset therefore finds
  all of the best candidates, each under exactly the tokens it shares. Other
  records may turn up with too few shared tokens, but only where ``k`` better
  ones are listed. Work grows with the rows, not with their product.
* Names with very many tokens have too many subsets; in hot blocks they meet
  the records they share a token with through a token join instead, and the
  rest through the index entry of the empty subset.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators.blocking import (
    BLOCK,
    KEY_CHANNELS,
    RARE_GRAM,
    RARE_GRAM_MAX_DOC_FREQ,
    memberships,
    with_name_tokens,
)
from pairloom.operators.ranked import best_of_blocks
from pairloom.operators.skew import (
    PAIRS_PER_TASK,
    ROWS_PER_TASK,
    dealt_sides,
    heavy_blocks,
    heavy_keys,
    salted_join,
)
from pairloom.operators.staging import stage

# Fixed value: candidates kept per S1 record and target source.
TOP_K = 25

# Rows of one S1 id whose lists are merged in memory.
ROWS_PER_ID = 256

# Index entries that are not token subsets. Tokens are lower case.
_ANY = "ANY"
_NO_NAME = "NO_NAME"


def token_overlap_pairs(pairs: DataFrame, s1: DataFrame, other: DataFrame) -> DataFrame:
    """Add ``token_overlap`` to listed pairs. Pairs that carry their tokens ``a`` and
    ``b`` need no join; a null id has no record and gives no row in either case."""
    named = (
        pairs.where(F.col("s1_id").isNotNull() & F.col("other_id").isNotNull())
        if {"a", "b"} <= set(pairs.columns)
        else with_name_tokens(pairs, s1, other)
    )
    overlap = text.token_overlap(F.col("a"), F.col("b"))
    return named.select("s1_id", "other_id", overlap.alias("token_overlap"))


def cut(scored: DataFrame, k: int = TOP_K, group: list[str] = ["s1_id"]) -> DataFrame:
    """The ``k`` best distinct ``other_id`` per ``group``.

    A pair found through several blocks has the same rank each time, so a
    dense rank keeps the copies together and they are dropped after the cut:
    the rank limit is applied before the shuffle as well as after it.
    """
    return _within(scored, k, group).distinct()


def _within(scored: DataFrame, k: int, group: list[str]) -> DataFrame:
    best = Window.partitionBy(*group).orderBy(F.desc_nulls_last("token_overlap"), "other_id")
    ranked = scored.withColumn("_rank", F.dense_rank().over(best))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def top_candidates(
    s1: DataFrame,
    other: DataFrame,
    k: int = TOP_K,
    channels: list[str] = [*KEY_CHANNELS, RARE_GRAM],
    empty_keys: str = "keep",
    max_doc_freq: float = RARE_GRAM_MAX_DOC_FREQ,
    frequent: DataFrame | None = None,
    hot_block_rows: int = 512,
    max_subset_tokens: int = 10,
    pairs_per_task: int = PAIRS_PER_TASK,
    rows_per_task: int = ROWS_PER_TASK,
    rows_per_id: int = ROWS_PER_ID,
) -> DataFrame:
    """``(s1_id, other_id, token_overlap)``: at most ``k`` rows per S1 record."""
    left, right = memberships(s1, other, channels, empty_keys, max_doc_freq, frequent)
    # Written: counting, listing and the index would each compute them again.
    left, right = stage(left, "memberships-s1"), stage(right, "memberships-other")
    blocks = heavy_blocks(
        left, right, BLOCK, pairs_per_task, hot_block_rows, "coalesce(size(tokens), 0)"
    )
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    repeated = heavy_keys(ids, ["s1_id"], rows_per_id)
    if blocks.hot is None:
        return _best_of_lists(_listed_best(left, right, k, blocks.calm), k, repeated)
    listed = _listed_best(
        blocks.outside(left, BLOCK), blocks.outside(right, BLOCK), k, blocks.calm
    )
    indexed = _indexed_best(
        blocks.within(left, BLOCK),
        blocks.within(right, BLOCK),
        k,
        max_subset_tokens,
        rows_per_task,
        blocks.most_rows,
        any_wide=blocks.widest > max_subset_tokens,
    )
    return _best_of_lists(listed.unionByName(indexed), k, repeated)


# A list of candidates is ordered by ``at``: minus the overlap, past 0 if it is unknown.
_UNKNOWN = 1


def _at(overlap: Column) -> Column:
    return F.coalesce(-overlap, F.lit(_UNKNOWN))


def _best(df: DataFrame, entries: Column, k: int, *columns: str) -> DataFrame:
    """``columns`` and ``best``, the ``k`` best of an array of ``(at, other_id)``."""
    ordered = df.select(*columns, F.sort_array(entries).alias("entries"))
    # Sorted, equal entries are neighbours.
    distinct = F.filter(
        "entries", lambda e, i: (i == 0) | ~F.get("entries", i - 1).eqNullSafe(e)
    )
    return ordered.select(*columns, F.slice(distinct, 1, k).alias("best"))


def _as_lists(df: DataFrame, *columns: str) -> DataFrame:
    """``best`` as two arrays: side by side the small numbers pack well."""
    return df.select(
        *columns,
        F.col("best.at").alias("at"),
        F.col("best.other_id").alias("ids"),
    )


def _as_rows(lists: DataFrame) -> DataFrame:
    rows = lists.select("s1_id", F.explode(F.arrays_zip("at", "ids")).alias("e"))
    overlap = F.when(F.col("e.at") != _UNKNOWN, -F.col("e.at"))
    return rows.select("s1_id", F.col("e.ids").alias("other_id"), overlap.alias("token_overlap"))


def _best_of_lists(lists: DataFrame, k: int, repeated: DataFrame | None) -> DataFrame:
    """The ``k`` best per S1 id of its blocks' lists. They cross the shuffle and are
    merged as lists; those of an id that very many rows have are merged in parts."""
    keys = ["s1_id"]
    if repeated is not None:
        repeated = F.broadcast(repeated.select(F.col("s1_id").alias("_id"), "_p"))
        same = lists["s1_id"].eqNullSafe(repeated["_id"])
        part = F.pmod(F.xxhash64("at", "ids"), F.coalesce("_p", F.lit(1)))
        lists = lists.join(repeated, same, "left").withColumn("_part", part).drop("_id", "_p")
        keys = ["s1_id", "_part"]
    entries = F.transform(
        F.arrays_zip("at", "ids"),
        lambda e: F.struct(e["at"].alias("at"), e["ids"].alias("other_id")),
    )
    # Dealt first: gathering before the shuffle would sort all lists once more.
    gathered = (
        lists.repartition(*keys)
        .groupBy(*keys)
        .agg(F.flatten(F.collect_set(entries)).alias("entries"))
    )
    rows = _as_rows(_as_lists(_best(gathered, F.col("entries"), k, "s1_id"), "s1_id"))
    # The best of an id that was merged in one part are distinct already.
    return _within(rows, k, ["s1_id"]) if repeated is None else cut(rows, k)


def _listed_best(
    left: DataFrame, right: DataFrame, k: int, heavy: DataFrame | None
) -> DataFrame:
    """Per S1 record and block the list of the best. The other side of a block that
    is not hot is short, so its pairs are ranked where the block lies: written out
    they would be sorted by the record, once for every block."""
    left = left.select(*BLOCK, F.col("entity_id").alias("s1_id"), "tokens")
    right = right.select(*BLOCK, F.col("entity_id").alias("other_id"), "tokens")
    keys = BLOCK
    if heavy is not None:
        heavy = heavy.withColumn("_q", F.lit(1))
        left, right = dealt_sides(left, right, BLOCK, F.col("s1_id"), F.lit(0), heavy)
        keys = [*BLOCK, "_i"]
    return best_of_blocks(left, right, keys, k, _UNKNOWN)


def _subsets(tokens: Column) -> Column:
    """Every subset of sorted ``tokens`` as a string, each member led by a
    space; the empty set is the empty string."""
    return F.aggregate(
        tokens,
        F.array(F.lit("")),
        lambda done, token: F.concat(
            done, F.transform(done, lambda s: F.concat(s, F.lit(" "), token))
        ),
    )


def _smallest_ids(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    """Rows of the ``k`` smallest distinct ids: copies of an id count once."""
    first = Window.partitionBy(*group).orderBy("other_id")
    return rows.withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= k).drop("_n")


def _entries(tokens: str, max_tokens: int, if_named: str, if_nameless: list[str]) -> Column:
    """Index entries of one record, exploded."""
    col = F.col(tokens)
    subsets = F.when(F.size(col) <= max_tokens, _subsets(col)).otherwise(F.array(F.lit("")))
    named = F.concat(subsets, F.array(F.lit(if_named)))
    nameless = F.array(*[F.lit(e) for e in if_nameless])
    return F.explode(F.when(col.isNull(), nameless).otherwise(named))


def _entry_size(entry: Column) -> Column:
    """Tokens in a subset; NULL for the other entries."""
    spaces = F.length(entry) - F.length(F.replace(entry, F.lit(" ")))
    return F.when(~entry.isin(_ANY, _NO_NAME), spaces)


def _indexed_best(
    left: DataFrame,
    right: DataFrame,
    k: int,
    max_tokens: int,
    rows_per_task: int,
    most_rows: int,
    any_wide: bool,
) -> DataFrame:
    """``most_rows`` is the S1 size of the largest hot block. Tables are
    written out where counting hot keys or joining wide names would compute
    them a second time."""

    def kept(df: DataFrame, label: str) -> DataFrame:
        return stage(df, label) if any_wide or most_rows > rows_per_task else df

    by_entry, by_name = [*BLOCK, "entry"], [*BLOCK, "a"]
    # Records of one block with the same name are interchangeable but for the
    # id: the other side keeps k of them, the S1 side is ranked once per name.
    right = kept(
        _smallest_ids(
            right.select(*BLOCK, F.col("tokens").alias("b"), F.col("entity_id").alias("other_id")),
            [*BLOCK, "b"],
            k,
        ),
        "hot-records",
    )
    names = kept(left.select(*BLOCK, F.col("tokens").alias("a")).distinct(), "hot-names")

    # A nameless record is found under both extra entries; a named one looks
    # past its subsets for nameless records, a nameless one for any record.
    entries = right.select(*BLOCK, "other_id", _entries("b", max_tokens, _ANY, [_NO_NAME, _ANY]).alias("entry"))
    index = kept(
        _smallest_ids(entries, by_entry, k).groupBy(*by_entry).agg(F.collect_set("other_id").alias("ids")),
        "subset-index",
    )
    probes = names.withColumn("entry", _entries("a", max_tokens, _NO_NAME, [_ANY]))
    found = salted_join(probes, index, by_entry, F.col("a"), rows_per_task, most_rows).select(
        *by_name, _entry_size(F.col("entry")).alias("shared"), "ids"
    )
    if any_wide:
        found = found.unionByName(_wide_pairs(names, right, k, max_tokens, rows_per_task))

    # The lists of a name are never written out as rows: they would be many times the
    # best. Where one subset alone lists k ids, smaller ones have nothing to add.
    gathered = (
        found.repartition(*by_name)
        .groupBy(*by_name)
        .agg(F.collect_list(F.struct("shared", "ids")).alias("lists"))
    )
    full = F.filter("lists", lambda e: F.size(e["ids"]) >= k)
    enough = F.coalesce(F.array_max(F.transform(full, lambda e: e["shared"])), F.lit(-1))
    useful = F.filter(
        "lists", lambda e: (F.col("enough") < 0) | F.coalesce(e["shared"] >= F.col("enough"), F.lit(False))
    )
    entries = F.flatten(
        F.transform(
            useful,
            lambda e: F.transform(
                e["ids"],
                lambda i: F.struct(i.alias("other_id"), _at(e["shared"]).alias("at")),
            ),
        )
    )
    # A record's largest subset found is its exact overlap if it is among the best:
    # see the module's notes. It is the first of the record's entries in this order.
    ordered = (
        gathered.withColumn("enough", enough)
        .withColumn("entries", F.sort_array(entries))
        .select(*by_name, "entries")
    )
    first = F.filter(
        "entries",
        lambda e, i: (i == 0) | (F.get("entries", i - 1)["other_id"] != e["other_id"]),
    )
    swapped = F.transform(first, lambda e: F.struct(e["at"].alias("at"), e["other_id"].alias("other_id")))
    best = kept(_as_lists(_best(ordered, swapped, k, *by_name), *by_name), "hot-best")

    owners = left.select(*BLOCK, F.col("tokens").alias("a"), F.col("entity_id").alias("s1_id"))
    # An equi-join would lose NULL tokens, so the name is joined as text.
    name_key = F.coalesce(F.array_join("a", " "), F.lit(_NO_NAME))
    return salted_join(
        owners.withColumn("name_key", name_key).drop("a"),
        best.withColumn("name_key", name_key).drop("a"),
        [*BLOCK, "name_key"],
        F.col("s1_id"),
        rows_per_task,
        most_rows,
    ).select("s1_id", "at", "ids")


def _wide_pairs(
    names: DataFrame, right: DataFrame, k: int, max_tokens: int, rows_per_task: int
) -> DataFrame:
    """Pairs of a hot block that share a token and have a name on either side
    with more than ``max_tokens`` tokens, in the shape of index findings."""
    by_token = [*BLOCK, "token"]
    left_tokens = names.withColumn("token", F.explode("a"))
    right_tokens = right.withColumn("token", F.explode("b"))
    wide_a, wide_b = F.size("a") > max_tokens, F.size("b") > max_tokens
    pairs = salted_join(
        right_tokens, left_tokens.where(wide_a), by_token, F.col("other_id"), rows_per_task
    ).unionByName(
        salted_join(
            left_tokens.where(~wide_a), right_tokens.where(wide_b), by_token, F.col("a"), rows_per_task
        )
    )
    overlap = text.token_overlap(F.col("a"), F.col("b"))
    scored = pairs.select(*BLOCK, "a", "other_id", overlap.alias("token_overlap"))
    # Their overlaps are exact: the best of a name are enough.
    return cut(scored, k, [*BLOCK, "a"]).select(
        *BLOCK, "a", F.col("token_overlap").alias("shared"), F.array("other_id").alias("ids")
    )
