"""Data-quality job for the two id-list files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import quality
from pairloom.operators.features import stack
from pairloom.operators.staging import path_exists, stage
from pairloom.schemas import CANDIDATE_HEADER, MATCHING_HEADER
from pairloom.sources.readers import ids_of_lines, read_lines


def validate(
    spark: SparkSession,
    matching: str,
    source1: str,
    candidates: str | None = None,
    targets: list[str] | None = None,
    check_ids: bool = False,
) -> DataFrame:
    """Findings of all rules; see :mod:`pairloom.operators.quality`.

    ``source1`` names the entities that need a row. With ``check_ids`` the
    listed ids must also occur in ``targets``.
    """

    def note(file: str, rule: str, severity: str) -> DataFrame:
        return spark.createDataFrame([(file, rule, severity, 1, [])], quality.FINDINGS)

    if not path_exists(spark, source1):
        return note(source1, "file_not_found", quality.ERROR)
    broken = [p for p in [source1, matching, candidates, *(targets or [])] if p and not _is_utf8(spark, p)]
    if broken:
        return stack(*[note(p, "not_utf8", quality.ERROR) for p in broken])

    results = []
    valid_ids = None
    absent = [t for t in targets or [] if not path_exists(spark, t)]
    if not check_ids:
        results.append(note(source1, "ids_not_checked", quality.WARNING))
    elif absent or not targets:
        results.append(note(absent[0] if absent else "targets", "ids_not_checked", quality.WARNING))
    else:
        valid_ids = stack(*[ids_of_lines(read_lines(spark, t)) for t in targets]).distinct()
    required = ids_of_lines(read_lines(spark, source1))

    def check(path: str, header: list[str]) -> DataFrame | None:
        lines = read_lines(spark, path)
        # One header per part file; a second distinct one cannot be right too.
        headers = lines.where("line_no = 1").select("value").distinct().limit(2).collect()
        problems = [quality.header_problem(h["value"], header) for h in headers]
        problem = next(filter(None, problems), None) if headers else "empty_file"
        if problem:
            results.append(note(path, problem, quality.ERROR))
            return None
        rows = quality.parse_rows(lines)
        offending = stage(quality.offenders(rows, lines, required, valid_ids), "offenders")
        results.append(quality.findings(offending, path))
        return rows

    matched = listed = None
    if path_exists(spark, matching):
        matched = check(matching, MATCHING_HEADER)
    else:
        results.append(note(matching, "file_not_found", quality.ERROR))
    if candidates and path_exists(spark, candidates):
        listed = check(candidates, CANDIDATE_HEADER)
    elif candidates:
        results.append(note(candidates, "file_not_found", quality.WARNING))
    if matched is not None and listed is not None:
        outside = stage(quality.outside_candidates(matched, listed), "offenders")
        results.append(quality.findings(outside, matching, quality.WARNING))
    return stack(*results)


def passed(findings: DataFrame) -> bool:
    return findings.where(F.col("severity") == quality.ERROR).isEmpty()


def _is_utf8(spark: SparkSession, path: str) -> bool:
    """A missing file passes here; another rule reports it."""
    if not path_exists(spark, path):
        return True
    return spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()
