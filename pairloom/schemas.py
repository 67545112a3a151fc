"""Fixed column contracts shared by the operators."""

from pyspark.sql import types as T

# Column names and id prefixes of the files the jobs exchange.
ENTITY_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]
MATCHING_HEADER = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_HEADER = ["source1_entity_id", "candidate_entity_ids"]
PRIMARY_PREFIX = "S1-"
TARGET_PREFIXES = ["S2-", "S3-"]

# Model inputs, in the order the vector assembler reads them.
MATCH_FLAGS = [
    "name_exact",
    "address_exact",
    "postal_match",
    "house_match",
    "country_match",
    "s1_addr_missing",
    "other_addr_missing",
]
FUZZY_SCORES = ["name_lev", "name_token_sort", "addr_lev", "addr_token_sort"]
FEATURE_COLUMNS = MATCH_FLAGS + FUZZY_SCORES + ["cosine_sim"]


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# All source columns are read as strings: an all-digit id or address must not
# turn into a number.
ENTITY = _strings(ENTITY_COLUMNS)
TRUTH = _strings(TRUTH_COLUMNS)
SIMILARITY = T.StructType(
    [
        T.StructField("s1_id", T.StringType()),
        T.StructField("other_id", T.StringType()),
        T.StructField("cosine_sim", T.FloatType()),
    ]
)
