import os

import pytest

from pairloom.operators import features, truth
from pairloom.operators.skew import salted_join
from pairloom.operators.staging import shared_folder
from pairloom.schemas import FEATURE_COLUMNS, MATCH_FLAGS
from pairloom.sources.writers import write_fuzzy_features

SCHEMA = (
    "entity_id string, name_norm string, address_norm string, postal_code string, "
    "house_number string, country string"
)


@pytest.fixture(scope="module")
def pair_of(spark):
    def build(a, b):
        left = spark.createDataFrame([("S1-1", *a)], SCHEMA)
        right = spark.createDataFrame([("S2-1", *b)], SCHEMA)
        pairs = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, other_id string")
        return pairs, left, right

    return build


@pytest.mark.parametrize(
    "a, b, flags",
    [
        (
            ("acme", "1 main", "12345", "1", "US"),
            ("acme", "1 main", "12345", "1", "US"),
            (True, True, True, True, True, False, False),
        ),
        # An S1 record without a code is no match; a missing one opposite is unknown.
        (
            (None, None, None, None, None),
            ("acme", "", "12345", "", "US"),
            (None, None, False, False, None, True, True),
        ),
        (
            ("acme", "x", "12345", "1", "US"),
            (None, None, None, None, None),
            (None, None, None, None, None, False, True),
        ),
        # Empty codes match each other.
        (("", "", "", "", "US"), ("", "", "", "", "FR"), (True, True, True, True, False, True, True)),
    ],
)
def test_flags_are_three_valued(pair_of, a, b, flags):
    row = features.exact_features(*pair_of(a, b)).first()
    assert tuple(row[f] for f in MATCH_FLAGS) == flags


def test_missing_values_become_zero(pair_of):
    pairs = pair_of((None,) * 5, ("acme", None, None, None, None))
    merged = features.merge_similarity(features.pair_features(*pairs), None)
    row = features.fill_missing(merged).first()
    assert [row[c] for c in FEATURE_COLUMNS] == [0, 0, 0, 0, 0, 1, 1, 0, 0, 100, 100, 0]


def test_pair_without_similarity_scores_zero(spark, rows_of):
    pairs = spark.createDataFrame([("a", "x"), ("a", "y")], "s1_id string, other_id string")
    similarity = spark.createDataFrame(
        [("a", "x", 0.5), ("b", "x", 0.9)], "s1_id string, other_id string, cosine_sim float"
    )
    assert rows_of(features.merge_similarity(pairs, similarity)) == [("a", "x", 0.5), ("a", "y", 0.0)]


def test_salted_join_equals_plain_join(spark, rows_of):
    many = spark.range(300).selectExpr("id", "if(id % 3 = 0, 'hot', string(id % 10)) AS k")
    few = spark.createDataFrame([("hot", 1), ("1", 2), ("2", 3), ("7", 4)], "k string, v int")
    salted = salted_join(many, few, ["k"], many["id"], rows_per_task=20)
    assert rows_of(salted, "id", "v") == rows_of(many.join(few, "k"), "id", "v")
    bounded = salted_join(many, few, ["k"], many["id"], most_rows=300)
    assert rows_of(bounded, "id", "v") == rows_of(salted, "id", "v")


@pytest.fixture(scope="module")
def exact(spark, normalized):
    some = ", ".join(f"'S2-{i}'" for i in (1, 2, 4, 5, 7))
    pairs = normalized["s1"].selectExpr("entity_id AS s1_id", f"explode(array({some})) AS other_id")
    return features.exact_features(pairs, normalized["s1"], normalized["s2"])


def test_parts_resume_and_keep_results(spark, exact, rows_of, tmp_path):
    path = str(tmp_path / "fuzzy")
    first = rows_of(write_fuzzy_features(exact, path, n_parts=3))
    assert first == rows_of(features.add_fuzzy_scores(exact))
    (folder,) = (tmp_path / "fuzzy").iterdir()
    stamps = {p: p.stat().st_mtime_ns for p in folder.glob("part=*/*.parquet")}
    assert stamps

    # A second run finds every part; one without its mark is written anew.
    (folder / "part=1" / "_SUCCESS").unlink()
    assert rows_of(write_fuzzy_features(exact, path, n_parts=3)) == first
    kept = {p for p in stamps if p.exists() and p.stat().st_mtime_ns == stamps[p]}
    assert kept and all("part=1" not in str(p) for p in kept)

    # Other input goes to another folder.
    fewer = exact.where("s1_id <> 'S1-1'")
    assert rows_of(write_fuzzy_features(fewer, path, n_parts=3)) == [r for r in first if r[0] != "S1-1"]
    assert len(list((tmp_path / "fuzzy").iterdir())) == 2


def test_labels_leave_rows_by_s1_id_where_they_lie(spark, rows_of):
    pairs = [("a", "x"), ("a", "y"), ("b", "x"), ("c", None), (None, "x"), ("a", "x")]
    lists = [("a", "x,z"), ("a", "x"), ("b", ""), ("c", "y"), (None, "x"), ("d", None)]
    truths = spark.createDataFrame(lists, "source1_entity_id string, matched_entity_ids string")
    rows = spark.createDataFrame(pairs, "s1_id string, other_id string").repartition(3, "s1_id")
    labelled = truth.add_labels(rows.hint("merge"), truths)
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    # One for the rows as given, one or two for the truth; none by the pair.
    assert not [x for x in plan.splitlines() if "Exchange" in x and "s1_id" in x and "other_id" in x]
    assert labelled.schema["label"].dataType.simpleString() == "int"
    assert rows_of(labelled) == sorted(
        [(*p, int(p == ("a", "x"))) for p in pairs], key=repr
    )


def test_pairs_are_not_sorted_with_their_texts(spark, tmp_path):
    """the records are hashed, and the parts are no folders of the stored pairs."""
    records = spark.createDataFrame([("x", "a b", "c", "1", "2", "US")], SCHEMA)
    pairs = spark.createDataFrame([("x", "x")], "s1_id string, other_id string")
    exact = features.exact_features(pairs, records, records)
    plan = exact._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan
    before = set(os.listdir(_local(shared_folder(spark))))
    assert write_fuzzy_features(exact, str(tmp_path / "f"), n_parts=2).count() == 1
    (stored,) = set(os.listdir(_local(shared_folder(spark)))) - before
    files = os.listdir(os.path.join(_local(shared_folder(spark)), stored))
    assert not [f for f in files if f.startswith("part=")]


def _local(folder):
    return folder.removeprefix("file:")
