import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.operators import blocking, ranked, skew, topk
from pairloom.operators.blocking import KEY_CHANNELS, RARE_GRAM

SCHEMA = (
    "entity_id string, name_norm string, address_norm string, house_number string, "
    "postal_code string"
)
ALL = [*KEY_CHANNELS, RARE_GRAM]


def brute_top(left, right, k):
    best = []
    for a in left:
        ranked = []
        for b in right:
            shares = (
                (a[1] and a[1] == b[1])
                or (a[4] is not None and a[4] == b[4])
                or (
                    a[3] is not None
                    and a[3] == b[3]
                    and None not in (a[1], b[1])
                    and a[1].split(" ")[0] == b[1].split(" ")[0]
                )
            )
            if shares:
                known = None not in (a[1], b[1])
                n = len(set(a[1].split(" ")) & set(b[1].split(" "))) if known else None
                ranked.append((-(n if known else -1), b[0], n))
        best += [(a[0], b, n) for _, b, n in sorted(ranked, key=lambda r: r[:2])[:k]]
    return sorted(best, key=repr)


def random_rows(prefix, n, seed):
    """A third of the rows share the empty postal code, names repeat, some are
    missing, empty, doubly spaced or very long."""
    rng = random.Random(seed)
    words = ["inc", "acme", "foods", "co", "steel", "blue", "river", ""]
    rows = []
    for i in range(n):
        name = " ".join(rng.choices(words, weights=[8, 4, 3, 3, 1, 1, 1, 1], k=rng.randint(1, 5)))
        name = rng.choice([name] * 8 + [None, "", " ".join(f"w{j}" for j in range(rng.randint(5, 9)))])
        postal = rng.choice(["", "", "11111", "22222", "33333", None])
        rows.append((f"{prefix}-{i}", name, None, rng.choice(["", "1", "2", None]), postal))
    return rows


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"hot_block_rows": 3},
        {"hot_block_rows": 3, "max_subset_tokens": 2},
        {"hot_block_rows": 10, "pairs_per_task": 20},
        {"hot_block_rows": 3, "max_subset_tokens": 4, "rows_per_task": 5, "pairs_per_task": 10},
    ],
)
def test_against_brute_force(spark, rows_of, options):
    left, right = random_rows("S1", 60, 1), random_rows("S2", 80, 2)
    found = topk.top_candidates(
        spark.createDataFrame(left, SCHEMA),
        spark.createDataFrame(right, SCHEMA),
        k=5,
        channels=KEY_CHANNELS,
        **options,
    )
    assert rows_of(found) == brute_top(left, right, 5)


@pytest.mark.parametrize(
    "options",
    [
        {"hot_block_rows": 2},
        # Blocks that are calm but heavy must not crowd out hot ones.
        {"hot_block_rows": 25, "pairs_per_task": 20},
    ],
)
def test_more_hot_blocks_than_can_be_broadcast(spark, rows_of, monkeypatch, options):
    monkeypatch.setattr(skew, "MAX_HEAVY_KEYS", 2)
    left, right = random_rows("S1", 60, 3), random_rows("S2", 80, 4)
    frames = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    found = topk.top_candidates(
        *frames, k=5, channels=KEY_CHANNELS, max_subset_tokens=4, **options
    )
    assert rows_of(found) == brute_top(left, right, 5)


def test_hot_blocks_come_before_larger_calm_ones(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HEAVY_KEYS", 1)
    rows = [("calm",)] * 40 + [("hot",)] * 2 + [("warm",)]
    left = spark.createDataFrame(rows, "k string")
    right = spark.createDataFrame([("calm",)] * 3 + [("hot",)] * 6 + [("warm",)] * 5, "k string")
    blocks = skew.heavy_blocks(left, right, ["k"], pairs_per_task=10, hot_rows=4)
    assert {r.k for r in blocks.within(left, ["k"]).collect()} == {"hot", "warm"}
    assert {r.k for r in blocks.outside(left, ["k"]).collect()} == {"calm"}


def test_hot_block_of_nameless_records(spark, rows_of):
    """Names unknown on one side only, on both, and nowhere else to match."""
    left = [(f"S1-{i}", None if i % 2 else "acme inc", None, None, "") for i in range(20)]
    right = [(f"S2-{i}", None if i % 3 else "acme co", None, None, "") for i in range(30)]
    frames = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    for names in ("true", "name_norm IS NULL"):
        found = topk.top_candidates(
            frames[0].where(names), frames[1].where(names), k=4, channels=KEY_CHANNELS, hot_block_rows=2
        )
        kept = [[r for r in rows if names == "true" or r[1] is None] for rows in (left, right)]
        assert rows_of(found) == brute_top(*kept, 4)


@pytest.mark.parametrize("target", ["s2", "s3"])
def test_hot_index_equals_listing_all_pairs(normalized, rows_of, target):
    s1, other = normalized["s1"], normalized[target]
    pairs = blocking.candidate_pairs(s1, other, ALL, max_doc_freq=0.05)
    listed = topk.cut(topk.token_overlap_pairs(pairs, s1, other), 10)
    found = topk.top_candidates(s1, other, k=10, max_doc_freq=0.05, hot_block_rows=4)
    assert rows_of(found) == rows_of(listed)
    per_entity = found.groupBy("s1_id").count().agg(F.max("count")).first()[0]
    assert per_entity <= 10


def test_token_overlap(spark):
    def one(name):
        return spark.createDataFrame([("x", name)], "entity_id string, name_norm string")

    pairs = spark.createDataFrame([("x", "x")], "s1_id string, other_id string")
    for a, b, n in [("a  b  c", "x  a  a", 2), (None, "a", None), ("", "", 1), ("a", "b", 0)]:
        assert topk.token_overlap_pairs(pairs, one(a), one(b)).first()["token_overlap"] == n


def test_result_does_not_depend_on_partitions(spark, normalized, rows_of):
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(rows_of(topk.top_candidates(normalized["s1"], normalized["s3"], k=3)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_rank_limit_runs_before_the_shuffle(normalized):
    plan = topk.top_candidates(normalized["s1"], normalized["s2"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_repeated_ids_do_not_depend_on_the_block_size(spark):
    schema = "entity_id string, name_norm string, name_core string, address_norm string, house_number string, postal_code string, country string"
    row = lambda i, n: (i, n, n, None, "", "", "US")
    s1 = spark.createDataFrame([row("S1-1", "a b")], schema)
    other = spark.createDataFrame([row("S2-1", "a b")] * 5 + [row("S2-2", "a b"), row("S2-3", "a b")], schema)
    frequent = spark.createDataFrame([], "gram string")
    results = [
        {r.other_id for r in topk.top_candidates(s1, other, k=2, frequent=frequent, hot_block_rows=n).collect()}
        for n in (1, 4, 512, 10**9)
    ]
    assert results == [{"S2-1", "S2-2"}] * 4


def test_counts_past_64_bits(spark):
    big = spark.createDataFrame([(4 * 10**9, 4 * 10**9)], "a bigint, b bigint")
    assert big.select(blocking._product("a", "b")).first()[0] == 16 * 10**18


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_ranked_as_lists(spark, rows_of):
    """No pair is written out before the best are known: F25, F29."""
    left, right = random_rows("S1", 60, 1), random_rows("S2", 80, 2)
    tables = [spark.createDataFrame(rows, SCHEMA) for rows in (left, right)]
    for options in ({}, {"hot_block_rows": 3}):
        found = topk.top_candidates(*tables, k=5, channels=KEY_CHANNELS, **options)
        # The lists of all blocks are ranked: one shuffle by S1 id, of lists.
        dealt = [x for x in _plan(found).splitlines() if "hashpartitioning(s1_id" in x]
        assert dealt and all("REPARTITION" in x for x in dealt)
        assert rows_of(found) == brute_top(left, right, 5)


@pytest.mark.parametrize("hot_block_rows", [512, 3])
def test_ids_of_very_many_rows(spark, rows_of, hot_block_rows):
    left, right = random_rows("S1", 60, 1), random_rows("S2", 80, 2)
    left = [(None if i < 8 else f"S1-{i % 20}", *r[1:]) for i, r in enumerate(left)]
    if hot_block_rows == 512:
        right = [(f"S2-{i % 30}", *r[1:]) for i, r in enumerate(right)]
    tables = [spark.createDataFrame(rows, SCHEMA) for rows in (left, right)]

    def found(rows_per_id):
        return rows_of(
            topk.top_candidates(
                *tables,
                k=5,
                channels=KEY_CHANNELS,
                hot_block_rows=hot_block_rows,
                rows_per_id=rows_per_id,
            )
        )

    by_id = {}
    for a in left:
        for _, b, n in brute_top([a], right, 10_000):
            by_id.setdefault(a[0], set()).add((1 if n is None else -n, b, n))
    best = [(a, b, n) for a, rows in by_id.items() for _, b, n in sorted(rows, key=lambda r: r[:2])[:5]]
    assert found(256) == found(3) == found(1) == sorted(best, key=repr)


def _block_rows(seed):
    rng = random.Random(seed)
    words = ["inc", "acme", "foods", "co", "steel"]

    def rows(n):
        return [
            (
                rng.choice(["a", "a", "b", "c"]),
                rng.choice([None, *[f"r{rng.randint(0, n // 2)}"] * 9]),
                rng.choice([None, [], *[sorted(set(rng.choices(words, k=3)))] * 8]),
            )
            for _ in range(n)
        ]

    left = [*rows(60), ("only left", "x", ["inc"])]
    return left, [*rows(90), ("only right", "y", ["inc"])]


def _best_by_hand(left, right, k, unknown):
    expected = []
    for block, s1_id, a in left:
        near = {
            (unknown if None in (a, b) else -len(set(a) & set(b)), other_id)
            for other, other_id, b in right
            if other == block
        }
        best = sorted(near, key=lambda e: (e[0], e[1] is not None, e[1] or ""))[:k]
        if best:
            expected.append((s1_id, [at for at, _ in best], [i for _, i in best]))
    return sorted(expected, key=repr)


def test_pairs_of_blocks_are_ranked_in_arrays(spark):
    left, right = _block_rows(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kind = "block string, {} string, tokens array<string>"
    batch_rows = spark.conf.get(key)
    # Blocks run through several batches.
    spark.conf.set(key, "7")
    try:
        found = ranked.best_of_blocks(
            spark.createDataFrame(left, kind.format("s1_id")),
            spark.createDataFrame(right, kind.format("other_id")),
            ["block"],
            4,
            1,
        ).collect()
    finally:
        spark.conf.set(key, batch_rows)
    assert sorted(map(tuple, found), key=repr) == _best_by_hand(left, right, 4, 1)


@pytest.mark.parametrize("pairs", [1, 50, 10_000])
def test_pairs_are_ranked_some_at_a_time(monkeypatch, pairs):
    monkeypatch.setattr(ranked, "_PAIRS", pairs)
    left, right = _block_rows(2)
    rows = [(b, False, None, i, t) for b, i, t in right] + [(b, True, i, None, t) for b, i, t in left]
    rows.sort(key=lambda r: (r[0], r[1], r[3] is not None, r[3] or ""))
    block, is_left, s1_id, other_id, tokens = zip(*rows)
    table = pa.table(
        {
            "s1_id": pa.array(s1_id, pa.string()),
            "other_id": pa.array(other_id, pa.string()),
            "tokens": pa.array(tokens, pa.list_(pa.string())),
        }
    )
    number = np.unique(block, return_inverse=True)[1]
    found = [
        tuple(row.values())
        for batch in ranked._lists(table, number, np.array(is_left), 4, 1)
        for row in batch.to_pylist()
    ]
    assert sorted(found, key=repr) == _best_by_hand(left, right, 4, 1)


def test_memberships_are_computed_once(spark, normalized):
    """Counting, listing and the index read them from one written table, and the merged
    lists are not made distinct a second time."""
    top = topk.top_candidates(normalized["s1"], normalized["s2"], hot_block_rows=20)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "name_norm" not in plan
    merged = plan.split("Generate explode(arrays_zip(at")[0]
    assert "Aggregate" not in merged
