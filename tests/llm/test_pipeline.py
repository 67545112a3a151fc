"""The pipeline and the registered queries of the training-data operators."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from pairloom.llm import queries


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf_dir).collect()
        kept.append(rows)
        if "text" in (rows[0].asDict() if rows else {}):
            docs = spark.createDataFrame(rows, docs.schema)
    return kept


def test_stages(stages):
    raw, good, exact, near, mixed, packed = stages
    assert set(good) <= set(raw) and len(good) < len(raw)
    norm = lambda r: " ".join((r.text or "").split())
    assert len({norm(r) for r in exact}) == len(exact) == len({norm(r) for r in good})
    assert set(near) <= set(exact)
    assert set(mixed) <= set(near) and max(Counter(mixed).values()) <= 3
    assert {p.doc_id for p in packed} == {r.doc_id for r in mixed}


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    run = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r.doc_id, r.ids_crc32, r.start) for r in run.collect() if r.start == 0) .keys()
    assert run.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    sql = connection.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(sql.columns)
    expected = sql.select(*[f'"{c}"' for c in got.columns]).fetchall()
    rounded = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert Counter(map(rounded, map(tuple, got.collect()))) == Counter(map(rounded, expected))
