"""Seconds per stage on the fixture tables; prints one JSON line.

Each stage starts from the stored output of the one before, as in the jobs,
and its result is computed completely but thrown away.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from pairloom import fixtures  # noqa: E402
from pairloom.operators import (  # noqa: E402
    blocking,
    decision,
    features,
    model,
    topk,
    truth,
    vectors,
)
from pairloom.operators.normalize import normalize  # noqa: E402
from pairloom.operators.staging import stage  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

seconds: dict[str, float] = {}


def clock(name: str, make) -> None:
    start = time.perf_counter()
    result = make()
    if isinstance(result, DataFrame):
        result.write.format("noop").mode("overwrite").save()
    seconds[name] = round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("pairloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sources = ["s1", "s2", "s3"]
    raw = {s: stage(fixtures.entities(spark, SF_DIR, s), s) for s in sources}

    clock("normalize", lambda: features.stack(*[normalize(df) for df in raw.values()]))
    tables = {s: stage(normalize(df), s) for s, df in raw.items()}
    s1, targets = tables["s1"], [tables["s2"], tables["s3"]]

    def both(make) -> DataFrame:
        return features.stack(*[make(target) for target in targets])

    for channel in [*blocking.KEY_CHANNELS, blocking.RARE_GRAM]:
        clock(
            f"block_{channel}",
            lambda c=channel: both(lambda t: blocking.candidate_pairs(s1, t, [c])),
        )
    clock("block_union_count", lambda: both(lambda t: blocking.candidate_count(s1, t)))

    def top() -> DataFrame:
        frequent = blocking.frequent_grams(s1)
        return both(lambda t: topk.top_candidates(s1, t, frequent=frequent))

    clock("top_candidates", top)
    candidates = [stage(topk.top_candidates(s1, t), "candidates") for t in targets]

    def exact() -> DataFrame:
        parts = [features.exact_features(c, s1, t) for c, t in zip(candidates, targets)]
        return features.stack(*parts)

    clock("exact_features", exact)
    exact_rows = stage(exact(), "exact")
    clock("fuzzy_features", lambda: features.add_fuzzy_scores(exact_rows))
    fuzzy_rows = stage(features.add_fuzzy_scores(exact_rows), "fuzzy")

    texts = [vectors.embedding_text(df) for df in tables.values()]

    def encode() -> DataFrame:
        encoder = vectors.fit_text_encoder(features.stack(*texts))
        return features.stack(*[vectors.encode_with_model(t, encoder) for t in texts])

    clock("encode_text", encode)
    encoder = vectors.fit_text_encoder(features.stack(*texts))
    encoded = [stage(vectors.encode_with_model(t, encoder), "vectors") for t in texts]

    def nearest() -> DataFrame:
        return features.stack(*[vectors.nearest(encoded[0], other) for other in encoded[1:]])

    clock("vector_topk", nearest)
    similar = stage(nearest(), "similar")

    clock("merge_cosine", lambda: features.merge_similarity(fuzzy_rows, similar))
    gold = stage(fixtures.ground_truth(spark, SF_DIR), "truth")
    labelled = stage(
        truth.add_labels(features.merge_similarity(fuzzy_rows, similar), gold), "labelled"
    )
    trained: list[DataFrame] = []

    def fit() -> DataFrame:
        trained.append(stage(model.fit_folds(labelled)[1], "scores"))
        return trained[0]

    clock("train_folds", fit)
    scores = trained[0]
    sets = truth.true_sets(gold)
    clock("decision_grid", lambda: decision.decision_grid(scores, sets))
    clock("decision_apply", lambda: decision.apply_decision(scores, 0.5, 0.1, 0.5))

    spark.stop()
    print(
        json.dumps(
            {
                "metric": "stage_seconds_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
