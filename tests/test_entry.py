"""The registered queries: the cheap ones are compared with their SQL here."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

CHEAP = [
    "normalize_s3",
    "normalize_documents",
    "extract_pages",
    "normalize_counts",
    "block_union",
    "block_union_count",
    "gram_df",
    "topk_candidates",
    "fuzzy_addr_token_sort",
    "embedding_topk",
    "decision_grid",
    "fold_assign_check",
    "validate_matching",
    "validate_subset",
    "validate_files",
    "sample_rows",
]


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in order] for r in rows), key=repr)


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, sf_dir, sql, name):
    df = contract.queries()[name](spark, sf_dir)
    cursor = sql.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, cursor.fetchall())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["source1_entity_id", "candidate_entity_ids"] and df.count() == 150


def test_training_queries_end_with_the_jobs_own_boosting(spark, sf_dir):
    scores = contract.queries()["oof_scores"](spark, sf_dir)
    assert scores.count() == contract.queries()["pair_labels"](spark, sf_dir).count()
    assert scores.where("score <= 0 or score >= 1").isEmpty()
    matched = contract.queries()["train_and_infer"](spark, sf_dir)
    assert matched.count() == 150 and matched.where("matched_entity_ids IS NOT NULL").count() > 100
