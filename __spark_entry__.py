
from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

import oracle_queries  # noqa: E402
from pairloom import fixtures  # noqa: E402
from pairloom.functions import text  # noqa: E402
from pairloom.operators import (  # noqa: E402
    blocking,
    decision,
    evaluation,
    features,
    folds,
    model,
    output,
    quality,
    topk,
    truth,
    vectors,
)
from pairloom.operators.normalize import cap_rows, normalize, row_counts  # noqa: E402
from pairloom.operators.staging import shared_folder, stage, stage_spread  # noqa: E402
from pairloom.plans.config import JobConfig  # noqa: E402
from pairloom.plans.infer import infer  # noqa: E402
from pairloom.plans.train import train  # noqa: E402
from pairloom.plans.validate import validate  # noqa: E402
from pairloom.shipping import ship_package  # noqa: E402
from pairloom.schemas import CANDIDATE_HEADER, FUZZY_SCORES, MATCHING_HEADER  # noqa: E402
from pairloom.sources import readers, writers  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"
TARGETS = ["s2", "s3"]
RULE = {"threshold": 0.5, "margin": 0.25, "singleton_cap": 0.4}

def _normalized(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    sources = ["s1", *TARGETS]
    return {s: normalize(fixtures.entities(spark, sf_dir, s)) for s in sources}


def _stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Normalized tables written first, as the jobs do: blocking reads them
    several times, in files enough for all cores."""
    return {s: stage_spread(df, s) for s, df in _normalized(spark, sf_dir).items()}


def _truth_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.true_sets(fixtures.ground_truth(spark, sf_dir))


def _rounded(column: str, digits: int = 6) -> Column:
    return F.round(column, digits).alias(column)


def _by_target(make: Callable[[dict[str, DataFrame], str], DataFrame]) -> Query:
    """Run ``make`` for both targets and stack the results."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = _stored(spark, sf_dir)
        return features.stack(
            *[make(tables, t).select(F.lit(t).alias("target"), "*") for t in TARGETS]
        )

    return run


# -- normalization ---------------------------------------------------------


def _normalize_source(source: str) -> Query:
    return lambda spark, sf_dir: normalize(fixtures.entities(spark, sf_dir, source))


def _normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fixtures.table(spark, sf_dir, "documents").select(
        "doc_id", text.name_norm(F.col("text")).alias("name_norm")
    )
    return documents.withColumn("name_core", text.name_core(F.col("name_norm")))


def _extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, html = fixtures.table(spark, sf_dir, "pages"), F.col("html")
    return pages.select(
        "page_id",
        text.house_number(html).alias("house_number"),
        text.postal_code(html).alias("postal_code"),
        text.address_norm(F.col("url")).alias("address_norm"),
    )


# -- blocking --------------------------------------------------------------


def _channel_pairs(channels: list[str], empty_keys: str = "keep") -> Query:
    return _by_target(
        lambda tables, t: blocking.candidate_pairs(tables["s1"], tables[t], channels, empty_keys)
    )


ALL_CHANNELS = [*blocking.KEY_CHANNELS, blocking.RARE_GRAM]


def _long_pairs(df: DataFrame) -> DataFrame:
    return df.withColumn("n_pairs", F.col("n_pairs").cast("long"))


def _gram_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _normalized(spark, sf_dir)
    return features.stack(*[blocking.gram_rows(t) for t in tables.values()])


def _top(tables: dict[str, DataFrame], target: str) -> DataFrame:
    if "frequent" not in tables:
        tables["frequent"] = blocking.frequent_grams(tables["s1"])
    return topk.top_candidates(tables["s1"], tables[target], frequent=tables["frequent"])


def _stored_top(tables: dict[str, DataFrame], target: str) -> DataFrame:
    """As the jobs do: the candidates are written before features read them."""
    return stage(_top(tables, target), "candidates")


def _token_overlap(tables: dict[str, DataFrame], target: str) -> DataFrame:
    pairs = blocking.candidate_pairs(
        tables["s1"], tables[target], ALL_CHANNELS, with_tokens=True
    )
    return topk.token_overlap_pairs(pairs, tables["s1"], tables[target])


# -- features --------------------------------------------------------------


def _exact(tables: dict[str, DataFrame], target: str) -> DataFrame:
    pairs = _stored_top(tables, target)
    return features.exact_features(pairs, tables["s1"], tables[target])


def _exact_source(target: str) -> Query:
    return lambda spark, sf_dir: _exact(_stored(spark, sf_dir), target)


def _stacked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model inputs of both targets, with cosines of letter counts."""
    tables = _stored(spark, sf_dir)
    parts = []
    for t in TARGETS:
        pair_features = features.add_fuzzy_scores(_exact(tables, t))
        parts.append(features.merge_similarity(pair_features, _letter_neighbours(tables, t)))
    return features.fill_missing(features.stack(*parts))


def _rounded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacked_features(spark, sf_dir).withColumns(
        {c: F.round(c, 6) for c in features.FEATURE_COLUMNS}
    )


def _fuzzy(score: str) -> Query:
    return _by_target(
        lambda tables, t: features.add_fuzzy_scores(_exact(tables, t)).select(
            "s1_id", "other_id", _rounded(score)
        )
    )


# -- vectors ---------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _letter_vectors(normalized: DataFrame) -> DataFrame:
    """Unit vectors of letter counts: an encoder that SQL can repeat."""
    texts = vectors.embedding_text(normalized, partial=True)
    counts = F.array(
        *[
            (F.length("text") - F.length(F.replace("text", F.lit(c)))).cast("double")
            for c in LETTERS
        ]
    )
    return texts.select("entity_id", "country", vectors.unit_length(counts).alias("vector"))


def _letter_neighbours(tables: dict[str, DataFrame], target: str) -> DataFrame:
    return vectors.nearest(_letter_vectors(tables["s1"]), _letter_vectors(tables[target]))


def _embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.stack(
        *[vectors.embedding_text(t) for t in _normalized(spark, sf_dir).values()]
    )


def _embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("entity_id"),
        F.col("label").alias("country"),
        vectors.unit_length(F.col("embedding")).alias("vector"),
    )
    return vectors.nearest(rows, rows).withColumn("cosine_sim", F.round("cosine_sim", 6))


def _text_encoder_topk(tables: dict[str, DataFrame], target: str) -> DataFrame:
    left, right = (vectors.embedding_text(tables[s]) for s in ("s1", target))
    encoder = vectors.fit_text_encoder(features.stack(left, right))
    return vectors.nearest(
        vectors.encode_with_model(left, encoder), vectors.encode_with_model(right, encoder)
    )


def _merge_cosine(tables: dict[str, DataFrame], target: str) -> DataFrame:
    pairs = _top(tables, target).select("s1_id", "other_id")
    merged = features.merge_similarity(pairs, _letter_neighbours(tables, target))
    return merged.withColumn("cosine_sim", F.round("cosine_sim", 6))


# -- labels, scores, decision ----------------------------------------------


def _ground_truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.true_pairs(fixtures.ground_truth(spark, sf_dir))


def _ground_truth_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth_sets(spark, sf_dir).select(
        "s1_id",
        F.array_join(F.array_sort("matched"), ",").alias("matched"),
        F.size("matched").cast("long").alias("n_true"),
    )


def _all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _stored(spark, sf_dir)
    return features.stack(*[_top(tables, t) for t in TARGETS])


def _pair_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _all_candidates(spark, sf_dir).select("s1_id", "other_id")
    return truth.add_labels(pairs, fixtures.ground_truth(spark, sf_dir))


def _overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in score that SQL can repeat: shared tokens over the larger
    number of tokens."""
    tables = _stored(spark, sf_dir)
    parts = []
    for t in TARGETS:
        pairs = features.attach_records(_stored_top(tables, t), tables["s1"], tables[t])
        a, b = (text.tokens(F.col(f"{side}.name_norm")) for side in "ab")
        share = text.token_overlap(a, b) / F.greatest(F.size(a), F.size(b))
        score = F.round(F.coalesce(share, F.lit(0.0)), 4)
        parts.append(pairs.select("s1_id", "other_id", score.alias("score")))
    return features.stack(*parts)


def _decision_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.apply_decision(_overlap_scores(spark, sf_dir), **RULE)


def _entity_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluation.entity_scores(
        _decision_apply(spark, sf_dir), _truth_sets(spark, sf_dir)
    )
    return scores.withColumn("f0_5", F.round("f0_5", 6))


def _round_quality(df: DataFrame) -> DataFrame:
    measures = ["macro_f0_5", "singleton_f0_5", "pooled_precision", "pooled_recall"]
    return df.withColumns({m: F.round(m, 6) for m in measures})


def _macro_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_quality(
        evaluation.evaluate(_decision_apply(spark, sf_dir), _truth_sets(spark, sf_dir))
    )


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.decision_grid(_overlap_scores(spark, sf_dir), _truth_sets(spark, sf_dir))


def _decision_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_quality(_grid(spark, sf_dir)).drop("cell")


def _decision_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_quality(decision.best_cell(_grid(spark, sf_dir))).drop("cell")


# -- model -----------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.add_labels(
        _stacked_features(spark, sf_dir), fixtures.ground_truth(spark, sf_dir)
    )


def _fold_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and pairs of each fold, and the most folds an entity is in."""
    pairs = stage(_all_candidates(spark, sf_dir), "pairs")
    dealt = stage(folds.balanced_folds(pairs, "s1_id", model.N_FOLDS), "folds")
    placed = pairs.join(dealt, "s1_id")
    in_folds = placed.groupBy("s1_id").agg(F.count_distinct("fold").alias("n"))
    return (
        placed.groupBy("fold")
        .agg(F.count_distinct("s1_id").alias("n_entities"), F.count(F.lit(1)).alias("n_pairs"))
        .join(in_folds.agg(F.max("n").alias("max_folds")))
    )


def _oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.fit_folds(_labelled(spark, sf_dir))[1]


def _ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written: training and scoring both read it.
    labelled = stage(_labelled(spark, sf_dir), "labelled")
    models, _ = model.fit_folds(labelled)
    return model.ensemble_scores(labelled.drop("label"), models)


# -- output and checks -----------------------------------------------------


def _matching_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1 = fixtures.entities(spark, sf_dir, "s1")
    return output.id_lists(s1, _decision_apply(spark, sf_dir), MATCHING_HEADER[1])


def _candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1 = fixtures.entities(spark, sf_dir, "s1")
    return output.id_lists(s1, _all_candidates(spark, sf_dir), CANDIDATE_HEADER[1])


def _submission(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.sql(
        oracle_queries.SUBMISSION.replace("FROM customer", "FROM {customer}"),
        customer=fixtures.table(spark, sf_dir, "customer"),
    )
    return lines, quality.parse_rows(lines)


def _joined_examples(found: DataFrame) -> DataFrame:
    return found.withColumn("examples", F.array_join("examples", " | "))


def _validate_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, rows = _submission(spark, sf_dir)
    s1, s2, s3 = (fixtures.entities(spark, sf_dir, s) for s in ("s1", "s2", "s3"))
    offending = quality.offenders(rows, lines, s1, features.stack(s2, s3))
    return _joined_examples(quality.findings(offending, "matching_results"))


def _validate_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _submission(spark, sf_dir)
    lists = fixtures.ground_truth(spark, sf_dir)
    candidates = lists.select(
        F.lit("").alias("file"),
        F.lit(1).alias("line_no"),
        F.col("source1_entity_id").alias("s1_id"),
        F.split("matched_entity_ids", ",").alias("ids"),
    )
    outside = quality.outside_candidates(rows, candidates)
    return _joined_examples(quality.findings(outside, "matching_results", quality.WARNING))


def _one_file(lines: DataFrame, path: str) -> str:
    """``value`` in the order of ``line_no`` as a folder with one text file."""
    lines.repartition(1).sortWithinPartitions("line_no").select("value").write.text(path)
    return path


def _validate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over files: one with faults sown into its rows, and one more for
    each rule about whole files."""
    folder, paths = _new_folder(spark), _entity_files(spark, sf_dir)
    body = _submission(spark, sf_dir)[0].where("line_no > 1").select("line_no", "value")
    gt = fixtures.ground_truth(spark, sf_dir)
    listed = gt.select(
        F.lit(2).alias("line_no"),
        F.concat_ws("\t", "source1_entity_id", "matched_entity_ids").alias("value"),
    )

    def file(name: str, header: str, rows: DataFrame) -> str:
        first = spark.createDataFrame([(1, header)], "line_no long, value string")
        return _one_file(first.unionByName(rows), f"{folder}/{name}")

    good, stray_byte = "\t".join(MATCHING_HEADER), F.unhex(F.lit("E9")).cast("string")
    matching = file("matching_results", good, body)
    candidates = file("candidates", "\t".join(CANDIDATE_HEADER), listed)
    broken = {
        "comma": file("comma", ",".join(MATCHING_HEADER), body),
        "renamed": file("renamed", good.upper() + "x", body),
        "blank": _one_file(body.where("line_no < 0"), f"{folder}/blank"),
        "absent": f"{folder}/absent",
        "latin": file("latin", good, body.withColumn("value", F.concat("value", stray_byte))),
    }
    targets = [paths[t] for t in TARGETS]
    found = [validate(spark, matching, paths["s1"], candidates, targets, check_ids=True)]
    found += [
        # The warning that ids are not checked is shown once.
        validate(spark, path, paths["s1"]).where(
            F.lit(name == "comma") | (F.col("rule") != "ids_not_checked")
        )
        for name, path in broken.items()
    ]
    name = F.regexp_extract("file", "([a-z0-9_]+)$", 1)
    return _joined_examples(features.stack(*found)).withColumn("file", name)


def _sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoke-run cap, the feature of this query."""
    tables = {s: fixtures.entities(spark, sf_dir, s) for s in ("s1", *TARGETS)}
    return features.stack(
        *[cap_rows(df, 100).select(F.lit(s).alias("table_name"), "*") for s, df in tables.items()]
    )


def _validate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.list_statistics(_submission(spark, sf_dir)[1])


# -- files and jobs --------------------------------------------------------


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _entity_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The entity tables and the ground truth as tab-separated files."""
    folder = _new_folder(spark)
    tables = {s: fixtures.entities(spark, sf_dir, s) for s in ("s1", *TARGETS)}
    tables["truth"] = fixtures.ground_truth(spark, sf_dir)
    for name, df in tables.items():
        df.write.options(sep="\t", header=True, quote="", emptyValue="").csv(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in tables}


def _read_entity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _entity_files(spark, sf_dir)
    return features.stack(*[readers.read_entities(spark, paths[s]) for s in ("s1", *TARGETS)])


def _read_truth_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_truth(spark, _entity_files(spark, sf_dir)["truth"])


def _read_id_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate lists written as a file and parsed again line by line."""
    folder = _new_folder(spark)
    writers.write_id_lists(_candidate_lists(spark, sf_dir), folder)
    rows = quality.parse_rows(readers.read_lines(spark, folder))
    return rows.select("s1_id", F.array_join("ids", ",").alias("ids"))


def _read_id_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _entity_files(spark, sf_dir)
    return features.stack(
        *[readers.ids_of_lines(readers.read_lines(spark, paths[s])) for s in ("s1", *TARGETS)]
    )


def _read_similarity_file(tables: dict[str, DataFrame], target: str) -> DataFrame:
    spark = tables["s1"].sparkSession
    folder = _new_folder(spark)
    writers.write_similarity(_letter_neighbours(tables, target), folder)
    stored = readers.read_similarity(spark, folder)
    return stored.withColumn("cosine_sim", F.round(F.col("cosine_sim").cast("double"), 6))


def _resumable_features(tables: dict[str, DataFrame], target: str) -> DataFrame:
    folder = _new_folder(tables["s1"].sparkSession)
    scored = writers.write_fuzzy_features(_exact(tables, target), folder, n_parts=2)
    return scored.withColumns({c: F.round(c, 6) for c in FUZZY_SCORES})


def _train_and_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both jobs, file to file: the matches of the training entities."""
    paths, output_folder = _entity_files(spark, sf_dir), _new_folder(spark)
    config = JobConfig(
        sources={s: paths[s] for s in ("s1", *TARGETS)},
        truth=paths["truth"],
        output=output_folder,
        fuzzy_parts=1,
    )
    train(spark, config)
    matching, _ = infer(spark, config)
    return readers.read_truth(spark, matching)


QUERIES: dict[str, Query] = {
    "read_entity_files": _read_entity_files,
    "read_truth_file": _read_truth_file,
    "read_id_list_file": _read_id_list_file,
    "read_id_column": _read_id_column,
    "read_similarity_file": _by_target(_read_similarity_file),
    "resumable_features": _by_target(_resumable_features),
    "train_and_infer": _train_and_infer,
    "normalize_s1": _normalize_source("s1"),
    "normalize_s2": _normalize_source("s2"),
    "normalize_s3": _normalize_source("s3"),
    "normalize_documents": _normalize_documents,
    "extract_pages": _extract_pages,
    "normalize_counts": lambda spark, sf_dir: row_counts(_normalized(spark, sf_dir)),
    "block_name": _channel_pairs([blocking.NAME]),
    "block_address": _channel_pairs([blocking.ADDRESS]),
    "block_postal": _channel_pairs([blocking.POSTAL]),
    "block_postal_nonempty": _channel_pairs([blocking.POSTAL], "drop"),
    "block_house_name": _channel_pairs([blocking.HOUSE_NAME]),
    "block_union": _channel_pairs(blocking.KEY_CHANNELS),
    "block_union_count": _by_target(
        lambda tables, t: _long_pairs(blocking.candidate_count(tables["s1"], tables[t]))
    ),
    "block_sizes": _by_target(
        lambda tables, t: _long_pairs(blocking.block_sizes(tables["s1"], tables[t]))
    ),
    "gram_explode": _gram_explode,
    "entity_total": lambda spark, sf_dir: blocking.entity_total(_normalized(spark, sf_dir)["s1"]),
    "gram_df": lambda spark, sf_dir: blocking.gram_document_frequency(
        _normalized(spark, sf_dir)["s1"]
    ),
    "rare_grams": lambda spark, sf_dir: blocking.rare_grams(_normalized(spark, sf_dir)["s1"]),
    "block_rare_gram": _channel_pairs([blocking.RARE_GRAM]),
    "block_all": _channel_pairs(ALL_CHANNELS),
    "token_overlap": _by_target(_token_overlap),
    "topk_candidates": _by_target(_top),
    "topk_count": _by_target(
        lambda tables, t: _top(tables, t).agg(F.count(F.lit(1)).alias("n_rows"))
    ),
    "exact_features_s2": _exact_source("s2"),
    "exact_features_s3": _exact_source("s3"),
    "fuzzy_name_ratio": _fuzzy("name_lev"),
    "fuzzy_name_token_sort": _fuzzy("name_token_sort"),
    "fuzzy_addr_ratio": _fuzzy("addr_lev"),
    "fuzzy_addr_token_sort": _fuzzy("addr_token_sort"),
    "features_stacked": _rounded_features,
    "embedding_text": _embedding_text,
    "embedding_topk": _embedding_topk,
    "entity_topk": _by_target(
        lambda tables, t: _letter_neighbours(tables, t).withColumn(
            "cosine_sim", F.round("cosine_sim", 6)
        )
    ),
    "text_encoder_topk": _by_target(_text_encoder_topk),
    "merge_cosine": _by_target(_merge_cosine),
    "ground_truth_pairs": _ground_truth_pairs,
    "ground_truth_sets": _ground_truth_sets,
    "pair_labels": _pair_labels,
    "fold_assign_check": _fold_check,
    "oof_scores": _oof_scores,
    "ensemble_scores": _ensemble_scores,
    "decision_apply": _decision_apply,
    "entity_f05": _entity_f05,
    "macro_f05": _macro_f05,
    "decision_grid": _decision_grid,
    "decision_best": _decision_best,
    "matching_results": _matching_results,
    "candidate_pairs": _candidate_lists,
    "validate_matching": _validate_matching,
    "validate_subset": _validate_subset,
    "validate_statistics": _validate_statistics,
    "validate_files": _validate_files,
    "sample_rows": _sample_rows,
}


def _shipped_first(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the candidates of every S1 record, as sorted id lists."""
    return queries()["candidate_pairs"](spark, SMOKE_DIR)


# The training-data operators and their pipeline, where they are installed.
LLM_ORACLES: dict[str, str] = {}
try:
    import corpus_pipeline  # noqa: E402
    from pairloom.llm import queries as llm_queries  # noqa: E402
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "pairloom.llm"):
        raise
else:
    QUERIES |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    LLM_ORACLES = llm_queries.ORACLES


def queries() -> dict[str, Query]:
    return {name: _shipped_first(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return oracle_queries.oracles() | LLM_ORACLES
