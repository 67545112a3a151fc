"""Features of candidate pairs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.similarity import fuzzy_scores
from pairloom.operators.skew import salted_join
from pairloom.schemas import FEATURE_COLUMNS, FUZZY_SCORES, MATCH_FLAGS

_COMPARED = ["name_norm", "address_norm", "postal_code", "house_number", "country"]
_TEXTS = ["s1_name", "other_name", "s1_addr", "other_addr"]


def attach_records(pairs: DataFrame, s1: DataFrame, other: DataFrame) -> DataFrame:
    """Both records of each pair as structs ``a`` and ``b``. An S1 record has a
    bounded number of candidates; a record of the other side may be the
    candidate of very many, so its ids are salted where they are hot."""
    compared = F.struct(*_COMPARED)
    left = s1.select(F.col("entity_id").alias("s1_id"), compared.alias("a"))
    right = other.select(F.col("entity_id").alias("other_id"), compared.alias("b"))
    # Hashed, the records are the side held in memory, a partition at a time; a merge
    # would sort the pairs, many times as many and as wide.
    left, right = left.hint("shuffle_hash"), right.hint("shuffle_hash")
    named = pairs.join(left, "s1_id")
    return salted_join(named, right, ["other_id"], F.col("s1_id"), counted=pairs)


def exact_features(pairs: DataFrame, s1: DataFrame, other: DataFrame) -> DataFrame:
    """Seven three-valued flags plus the texts the string scores read."""

    def same(column: str) -> Column:
        return F.col(f"a.{column}") == F.col(f"b.{column}")

    def same_known(column: str) -> Column:
        return same(column) & F.col(f"a.{column}").isNotNull()

    def missing(side: str) -> Column:
        address = F.col(f"{side}.address_norm")
        return address.isNull() | (address == "")

    flags = [
        same("name_norm"),
        same("address_norm"),
        same_known("postal_code"),
        same_known("house_number"),
        same("country"),
        missing("a"),
        missing("b"),
    ]
    return attach_records(pairs.select("s1_id", "other_id"), s1, other).select(
        "s1_id",
        "other_id",
        *[flag.alias(name) for flag, name in zip(flags, MATCH_FLAGS)],
        F.col("a.name_norm").alias("s1_name"),
        F.col("b.name_norm").alias("other_name"),
        F.col("a.address_norm").alias("s1_addr"),
        F.col("b.address_norm").alias("other_addr"),
    )


def add_fuzzy_scores(exact: DataFrame) -> DataFrame:
    """Replace the four texts by the four string scores."""
    scores = fuzzy_scores(*[F.col(c) for c in _TEXTS])
    return (
        exact.withColumn("_scores", scores)
        .drop(*_TEXTS)
        .select("s1_id", "other_id", *MATCH_FLAGS, *[f"_scores.{c}" for c in FUZZY_SCORES])
    )


def pair_features(pairs: DataFrame, s1: DataFrame, other: DataFrame) -> DataFrame:
    return add_fuzzy_scores(exact_features(pairs, s1, other))


def merge_similarity(features: DataFrame, similarity: DataFrame | None) -> DataFrame:
    """Add ``cosine_sim``; 0 for a pair the similarity table does not list, or
    where there is no such table."""
    if similarity is None:
        return features.withColumn("cosine_sim", F.lit(0.0))
    return features.join(
        similarity.select("s1_id", "other_id", F.col("cosine_sim").cast("double")),
        ["s1_id", "other_id"],
        "left",
    ).withColumn("cosine_sim", F.coalesce("cosine_sim", F.lit(0.0)))


def fill_missing(features: DataFrame) -> DataFrame:
    """All model inputs as doubles, unknown values as 0."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURE_COLUMNS}
    return features.withColumns(filled)


def stack(*targets: DataFrame) -> DataFrame:
    """Rows of all target sources, one below the other."""
    stacked = targets[0]
    for target in targets[1:]:
        stacked = stacked.unionByName(target)
    return stacked
