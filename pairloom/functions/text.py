"""Column expressions for business names and addresses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal-form words and patterns the results depend on.
LEGAL_FORMS = r"\b(inc|incorporated|ltd|limited|llc|corp|corporation|pvt|private|co)\b"
KEPT_CHARACTERS = "[^a-z0-9 ]"
LEADING_DIGITS = r"^[\t\n\f\r ]*([0-9]+)"
POSTAL_DIGITS = "([0-9]{5,6})"
GRAM_LENGTH = 4


def _lower(col: Column) -> Column:
    # Spark lower-cases the dotted capital I to two code points; one plain "i"
    # is wanted, otherwise the combining dot would become a stray space.
    return F.lower(F.translate(col, "İ", "i"))


def name_norm(name: Column) -> Column:
    """Lower case, spell out ``&``, blank every other sign. Inner runs of
    spaces stay as they are."""
    spelled = F.replace(_lower(name), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, KEPT_CHARACTERS, " "))


def name_core(normalized_name: Column) -> Column:
    """A normalized name without its legal-form words."""
    return F.trim(F.regexp_replace(normalized_name, LEGAL_FORMS, ""))


def address_norm(address: Column) -> Column:
    return F.trim(F.regexp_replace(_lower(address), KEPT_CHARACTERS, " "))


def house_number(address: Column) -> Column:
    """Leading digits; the empty string when there are none."""
    return F.regexp_extract(address, LEADING_DIGITS, 1)


def postal_code(address: Column) -> Column:
    """First run of five or six digits; the empty string when there is none."""
    return F.regexp_extract(address, POSTAL_DIGITS, 1)


def first_token(normalized: Column) -> Column:
    return F.split_part(normalized, F.lit(" "), F.lit(1))


def tokens(normalized: Column) -> Column:
    """Distinct space-separated tokens in sorted order. A double space yields
    the empty token, which counts like any other."""
    return F.sort_array(F.array_distinct(F.split(normalized, " ")))


def token_overlap(left_tokens: Column, right_tokens: Column) -> Column:
    """Number of distinct shared tokens; NULL when either side is NULL."""
    return F.array_size(F.array_intersect(left_tokens, right_tokens))


def grams(normalized: Column) -> Column:
    """All character 4-grams by position, duplicates kept; NULL for text that
    is too short to have one."""
    return F.when(
        F.length(normalized) >= GRAM_LENGTH,
        F.transform(
            F.sequence(F.lit(1), F.length(normalized) - F.lit(GRAM_LENGTH - 1)),
            lambda i: F.substr(normalized, i, F.lit(GRAM_LENGTH)),
        ),
    )


def sorted_words(text: Column) -> Column:
    """Whitespace-separated words sorted and joined by one space."""
    words = F.array_remove(F.split(text, r"[\s\x1c-\x1f]+"), "")
    return F.array_join(F.sort_array(words), " ")
