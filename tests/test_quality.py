import pytest

from pairloom.operators import quality
from pairloom.plans.validate import passed, validate
from pairloom.sources.readers import ids_of_lines, read_lines

SOURCE = "entity_id\tbusiness_name\n"
MATCHING = "source1_entity_id\tmatched_entity_ids\n"
CANDIDATES = "source1_entity_id\tcandidate_entity_ids\n"
BAD = (
    MATCHING
    + "S1-1\tS2-1,S2-1\n"
    + "S1-1\tS3-1\n"
    + "S1-2\tS1-9,X-1,S2-99\n"
    + "S1-7\t\n"
    + "no tab here\n"
    + "\n"
)


@pytest.fixture
def files(tmp_path):
    def write(**contents):
        paths = {}
        for name, content in contents.items():
            paths[name] = str(tmp_path / f"{name}.tsv")
            data = content if isinstance(content, bytes) else content.encode()
            (tmp_path / f"{name}.tsv").write_bytes(data)
        return paths

    return write


@pytest.fixture
def check(spark, files):
    """Findings as {rule: (severity, n, examples)}."""

    def run(targets=("s2", "s3"), **contents):
        contents.setdefault("source1", SOURCE + "S1-1\ta\n S1-2 \tb\n\nS1-3\tc\n")
        contents.setdefault("s2", SOURCE + "S2-1\tx\n")
        contents.setdefault("s3", SOURCE + "S3-1\tx\n")
        options = {k: contents.pop(k) for k in ("check_ids",) if k in contents}
        paths = files(**contents)
        found = validate(
            spark,
            paths["matching"],
            paths["source1"],
            paths.get("candidates"),
            [paths[t] for t in targets],
            **options,
        )
        return {r.rule: (r.severity, r.n, r.examples) for r in found.collect()}, found

    return run


def test_every_rule(check):
    found, table = check(matching=BAD, check_ids=True)
    assert found == {
        "malformed_row": ("error", 1, ["6: no tab here"]),
        "duplicate_row": ("error", 1, ["S1-1"]),
        "repeated_id": ("error", 1, ["S1-1"]),
        "self_match": ("error", 1, ["S1-9"]),
        "wrong_prefix": ("error", 1, ["X-1"]),
        "unknown_id": ("error", 1, ["S2-99"]),
        "missing_row": ("error", 1, ["S1-3"]),
        "unexpected_row": ("error", 1, ["S1-7"]),
    }
    assert not passed(table)


def test_good_files_pass(check):
    good = MATCHING + "S1-1\tS2-1,S3-1\nS1-2\t\nS1-3\t  \n"
    found, table = check(matching=good, candidates=good.replace("matched", "candidate"), check_ids=True)
    assert found == {} and passed(table)


def test_id_check_is_optional(check):
    found, table = check(matching=MATCHING + "S1-1\tS2-99\nS1-2\t\nS1-3\t\n")
    assert found == {"ids_not_checked": ("warning", 1, [])} and passed(table)


def test_missing_target_turns_the_id_check_off(spark, files):
    paths = files(source1=SOURCE + "S1-1\ta\n", matching=MATCHING + "S1-1\tS2-99\n")
    found = validate(spark, paths["matching"], paths["source1"], targets=["/none.tsv"], check_ids=True)
    assert [(r.rule, r.severity) for r in found.collect()] == [("ids_not_checked", "warning")]


@pytest.mark.parametrize(
    "content, rule",
    [
        ("", "empty_file"),
        ("source1_entity_id,matched_entity_ids\nS1-1,S2-1\n", "comma_separated"),
        ("id\tids\nS1-1\tS2-1\n", "wrong_header"),
    ],
)
def test_header_faults_stop_the_file(check, content, rule):
    found, _ = check(matching=content, check_ids=True)
    assert found == {rule: ("error", 1, [])}


def test_header_is_stripped_and_lower_cased(check):
    content = " Source1_Entity_ID \tMATCHED_entity_ids\nS1-1\t\nS1-2\t\nS1-3\t\n"
    assert check(matching=content, check_ids=True)[0] == {}


def test_bytes_that_are_no_text(check):
    found, _ = check(matching=MATCHING.encode() + b"S1-1\t\xff\xfe\n", check_ids=True)
    assert found == {"not_utf8": ("error", 1, [])}


def test_missing_files(spark, files):
    paths = files(source1=SOURCE + "S1-1\ta\n", matching=MATCHING + "S1-1\tS2-1\n")

    def rules(*args):
        return {(r.rule, r.severity) for r in validate(spark, *args).collect()}

    assert rules(paths["matching"], "/none.tsv") == {("file_not_found", "error")}
    off = ("ids_not_checked", "warning")
    assert rules("/none.tsv", paths["source1"]) == {off, ("file_not_found", "error")}
    assert rules(paths["matching"], paths["source1"], "/none.tsv") == {
        off,
        ("file_not_found", "warning"),
    }


def test_matches_outside_candidates(check):
    found, table = check(
        matching=MATCHING + "S1-1\tS2-1\nS1-2\tS2-1\nS1-3\tS2-1\n",
        candidates=CANDIDATES + "S1-1\tS2-1,S3-1\nS1-2\t\nS1-2\tS3-1\nS1-3\tS3-1\nS1-3\tS2-1\n",
        check_ids=True,
    )
    assert found["outside_candidates"] == ("warning", 1, ["S1-2"])
    assert found["duplicate_row"] == ("error", 2, ["S1-2", "S1-3"])


def test_trailing_comma_and_further_tabs(check):
    found, _ = check(matching=MATCHING + "S1-1\tS2-1,\nS1-2\tS2-1\tx\nS1-3\t\n", check_ids=True)
    assert found == {
        "wrong_prefix": ("error", 1, [""]),
        "unknown_id": ("error", 1, ["S2-1\tx"]),
    }


def test_examples_are_the_first_five(spark, check):
    rows = "".join(f"S1-x{i:03}\t\n" for i in range(200))
    found, _ = check(matching=MATCHING + "S1-1\t\nS1-2\t\nS1-3\t\n" + rows, check_ids=True)
    assert found == {"unexpected_row": ("error", 200, [f"S1-x{i:03}" for i in range(5)])}


def test_line_numbers_over_many_splits_and_files(spark, tmp_path):
    for name in ("a.tsv", "b.tsv"):
        lines = [f"{name} {i} " + "x" * (i % 90) for i in range(1, 4001)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 8000
    for r in rows:
        name, number = r.value.split(" ")[:2]
        assert (r.file.endswith(name), r.line_no) == (True, int(number))


def test_line_endings_and_ids(spark, tmp_path):
    (tmp_path / "ids.tsv").write_bytes(b"entity_id\tname\r\n a \tx\r\n\r\n\x1c \nb\tx\n\tno id\na\ty")
    ids = ids_of_lines(read_lines(spark, str(tmp_path / "ids.tsv")))
    assert sorted(r.entity_id for r in ids.collect()) == ["", "a", "b"]


def test_statistics(spark, tmp_path):
    (tmp_path / "m.tsv").write_text(MATCHING + "S1-1\tS2-1\nS1-2\t\nS1-3\t \t\nbroken\n")
    rows = quality.parse_rows(read_lines(spark, str(tmp_path / "m.tsv")))
    assert tuple(quality.list_statistics(rows).first()) == (3, 2, 1)
