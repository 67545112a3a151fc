"""Rule checks on id-list files before they are handed on.

Input are numbered text lines ``(file, line_no, value)``; every rule is a
filter, join or aggregate over them. The result is a findings table
``(file, rule, severity, n, examples)``; a file passes when no finding is an
error.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.schemas import PRIMARY_PREFIX, TARGET_PREFIXES
from pairloom.sources.readers import is_blank

# Fixed value: examples shown per rule.
MAX_EXAMPLES = 5

ERROR, WARNING = "error", "warning"
FINDINGS = "file string, rule string, severity string, n long, examples array<string>"


def header_problem(header: str, expected: list[str]) -> str | None:
    """Rule broken by a header line, if any; such a file is not read further."""
    if "\t" not in header and "," in header:
        return "comma_separated"
    if [column.strip().lower() for column in header.split("\t")] != expected:
        return "wrong_header"
    return None


def parse_rows(lines: DataFrame) -> DataFrame:
    """``(file, line_no, s1_id, ids)`` of the body lines with a tab. The list is what
    follows the first tab; blank text is the empty list."""
    tab = F.instr("value", "\t")
    rest = F.substr(F.col("value"), tab + 1)
    none = F.array().cast("array<string>")
    return lines.where((F.col("line_no") > 1) & (tab > 0)).select(
        "file",
        "line_no",
        F.substr(F.col("value"), F.lit(1), tab - 1).alias("s1_id"),
        F.when(is_blank(rest), none).otherwise(F.split(rest, ",")).alias("ids"),
    )


def malformed_lines(lines: DataFrame) -> DataFrame:
    """Non-blank body lines without a tab."""
    return lines.where(
        (F.col("line_no") > 1) & (F.instr("value", "\t") == 0) & ~is_blank(F.col("value"))
    )


def list_statistics(rows: DataFrame) -> DataFrame:
    empty = F.size("ids") == 0
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(empty).alias("n_empty"),
        F.count_if(~empty).alias("n_nonempty"),
    )


def last_lists(rows: DataFrame) -> DataFrame:
    """``(s1_id, ids)``: of a repeated entity the last row counts."""
    return rows.groupBy("s1_id").agg(F.max_by("ids", F.struct("file", "line_no")).alias("ids"))


def offenders(
    rows: DataFrame,
    lines: DataFrame,
    required: DataFrame,
    valid_ids: DataFrame | None = None,
) -> DataFrame:
    """``(rule, offender)``, distinct. ``required`` and ``valid_ids`` hold an
    ``entity_id`` column; without ``valid_ids`` unknown ids are not looked for."""
    seen = rows.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    needed = required.select(F.col("entity_id").alias("s1_id")).distinct()
    listed = rows.select(F.explode("ids").alias("id")).distinct()
    own = F.col("id").startswith(PRIMARY_PREFIX)
    target = reduce(Column.__or__, [F.col("id").startswith(p) for p in TARGET_PREFIXES])
    bad_line = F.concat(F.col("line_no").cast("string"), F.lit(": "), F.rtrim("value"))

    found = {
        "malformed_row": malformed_lines(lines).select(bad_line),
        "duplicate_row": seen.where("n > 1").select("s1_id"),
        "repeated_id": rows.where(F.size("ids") != F.size(F.array_distinct("ids")))
        .select("s1_id")
        .distinct(),
        "self_match": listed.where(own).select("id"),
        "wrong_prefix": listed.where(~own & ~target).select("id"),
        "missing_row": needed.join(seen, "s1_id", "left_anti").select("s1_id"),
        "unexpected_row": seen.join(needed, "s1_id", "left_anti").select("s1_id"),
    }
    if valid_ids is not None:
        known = valid_ids.select(F.col("entity_id").alias("id"))
        found["unknown_id"] = listed.where(target).join(known, "id", "left_anti").select("id")
    labelled = [
        df.toDF("offender").select(F.lit(rule).alias("rule"), "offender")
        for rule, df in found.items()
    ]
    return reduce(DataFrame.unionByName, labelled)


def outside_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(rule, offender)``: entities matched to an id that is not among their
    candidates. Inputs are parsed rows of the two files."""
    allowed = last_lists(candidates).withColumnRenamed("ids", "allowed")
    none = F.array().cast("array<string>")
    extra = F.array_except("ids", F.coalesce("allowed", none))
    return (
        last_lists(matched)
        .join(allowed, "s1_id", "left")
        .where(F.size(extra) > 0)
        .select(F.lit("outside_candidates").alias("rule"), F.col("s1_id").alias("offender"))
    )


def findings(offending: DataFrame, file: str, severity: str = ERROR) -> DataFrame:
    """Count and the first five offenders per rule. The five are cut by rank,
    before the shuffle and after it, so no rule's offenders are gathered."""
    first = Window.partitionBy("rule").orderBy("offender")
    shown = (
        offending.withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= MAX_EXAMPLES)
        .groupBy("rule")
        .agg(F.array_sort(F.collect_list("offender")).alias("examples"))
    )
    counted = offending.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(shown, "rule").select(
        F.lit(file).alias("file"), "rule", F.lit(severity).alias("severity"), "n", "examples"
    )
