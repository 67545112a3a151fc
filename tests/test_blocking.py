from itertools import product

import pytest

from pairloom.operators import blocking, skew, staging, topk
from pairloom.operators.blocking import KEY_CHANNELS, RARE_GRAM

SCHEMA = (
    "entity_id string, name_norm string, address_norm string, house_number string, "
    "postal_code string"
)

ONE = [
    ("S1-1", "acme foods", "1 main st", "1", "12345"),
    ("S1-2", "", "", "", ""),
    ("S1-3", None, None, None, None),
    ("S1-4", "acme  foods", "1 main st", "1", ""),
    ("S1-5", "zeta", "9 side rd", "9", ""),
]
TWO = [
    ("S2-1", "acme foods", "1 main st", "1", "12345"),
    ("S2-2", "", "", "", ""),
    ("S2-3", None, None, None, None),
    ("S2-4", "acme motors", None, None, "12345"),
    ("S2-5", "acme", "1 main street", "1", ""),
]


def brute_pairs(left, right, channels, empty_keys="keep"):
    def keys(row):
        _, name, address, house, postal = row
        found = {}
        if name:
            found["name"] = name
        if address:
            found["address"] = address
        if postal is not None and (postal or empty_keys == "keep"):
            found["postal"] = postal
        if house is not None and name is not None and (house or empty_keys == "keep"):
            found["house_name"] = (house, name.split(" ")[0])
        return found

    return sorted(
        (a[0], b[0])
        for a, b in product(left, right)
        if any(c in keys(a) and keys(a)[c] == keys(b).get(c) for c in channels)
    )


@pytest.fixture(scope="module")
def hand(spark):
    return spark.createDataFrame(ONE, SCHEMA), spark.createDataFrame(TWO, SCHEMA)


@pytest.mark.parametrize("empty_keys", ["keep", "drop"])
@pytest.mark.parametrize("channels", [[c] for c in KEY_CHANNELS] + [KEY_CHANNELS])
def test_channels(hand, rows_of, channels, empty_keys):
    pairs = blocking.candidate_pairs(*hand, channels, empty_keys)
    assert rows_of(pairs) == brute_pairs(ONE, TWO, channels, empty_keys)


@pytest.mark.parametrize("empty_keys", ["keep", "drop"])
def test_count_without_listing(hand, empty_keys):
    expected = len(brute_pairs(ONE, TWO, KEY_CHANNELS, empty_keys))
    assert blocking.candidate_count(*hand, empty_keys).first()["n_pairs"] == expected


def test_count_of_no_pairs(hand):
    s1, other = hand
    assert blocking.candidate_count(s1, other.where("false")).first()["n_pairs"] == 0


@pytest.mark.parametrize("empty_keys", ["keep", "drop"])
def test_count_with_repeated_ids(spark, empty_keys):
    # Rows of one id that share different keys with another record.
    one = [*ONE, ("S1-1", "acme", "9 side rd", "9", ""), ("S1-5", "zeta", "9 side rd", "9", "")]
    two = [*TWO, ("S2-1", "acme foods", "", "", "12345"), ("S2-5", "zeta", None, "9", "99999")]
    for left, right in ((one, two), (one, TWO), (ONE, two)):
        expected = len(set(brute_pairs(left, right, KEY_CHANNELS, empty_keys)))
        tables = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
        assert blocking.candidate_count(*tables, empty_keys).first()["n_pairs"] == expected


def test_unknown_option(hand):
    with pytest.raises(ValueError):
        blocking.key_memberships(hand[0], empty_keys="maybe")


def test_salted_blocks_give_the_same_pairs(hand, rows_of, monkeypatch):
    monkeypatch.setattr(skew, "FEW_ROWS", 2)
    pairs = blocking.candidate_pairs(*hand, KEY_CHANNELS, pairs_per_task=1)
    assert rows_of(pairs) == brute_pairs(ONE, TWO, KEY_CHANNELS)


def test_block_sizes(hand):
    sizes = {(r.channel, r.block_key): r.n_pairs for r in blocking.block_sizes(*hand).collect()}
    assert sizes[("postal", "")] == 3 * 2
    assert sizes[("house_name", "1 acme")] == 2 * 2


def test_grams_keep_occurrences(spark, rows_of):
    df = spark.createDataFrame([("a", "aaaaa"), ("b", "abc"), ("c", None)], "entity_id string, name_norm string")
    assert rows_of(blocking.gram_rows(df)) == [("a", "aaaa"), ("a", "aaaa")]
    assert rows_of(blocking.gram_document_frequency(df)) == [("aaaa", 1)]
    assert blocking.entity_total(df).first()["n_entities"] == 3


def test_rare_grams_need_more_than_a_thousand_entities(spark, normalized):
    assert blocking.rare_grams(normalized["s1"]).isEmpty()
    assert blocking.candidate_pairs(normalized["s1"], normalized["s2"], [RARE_GRAM]).isEmpty()
    rows = spark.range(1001).selectExpr(
        "concat('S1-', id) AS entity_id",
        "CASE WHEN id = 0 THEN 'quux corner' ELSE 'plain name' END AS name_norm",
    )
    rare = {r.gram for r in blocking.rare_grams(rows).collect()}
    assert "quux" in rare and "plai" not in rare
    # A thousand entities: 1/1000 is not below the limit.
    assert blocking.rare_grams(rows.where("entity_id <> 'S1-1000'")).isEmpty()


def test_rare_gram_channel_against_brute_force(normalized, rows_of):
    s1, s3 = normalized["s1"], normalized["s3"]
    limit = 0.02

    def grams(df):
        return {
            r.entity_id: {r.name_norm[i : i + 4] for i in range(len(r.name_norm or "") - 3)}
            for r in df.collect()
        }

    left, right = grams(s1), grams(s3)
    df_count = {}
    for own in left.values():
        for g in own:
            df_count[g] = df_count.get(g, 0) + 1
    rare = {g for g, n in df_count.items() if n / len(left) < limit}
    expected = sorted(
        (a, b) for a, b in product(left, right) if left[a] & right[b] & rare
    )
    assert expected
    pairs = blocking.candidate_pairs(s1, s3, [RARE_GRAM], max_doc_freq=limit)
    assert rows_of(pairs) == expected


def test_frequent_grams_past_the_broadcast_bound(normalized, rows_of, monkeypatch):
    tables = normalized["s1"], normalized["s3"]
    expected = rows_of(blocking.candidate_pairs(*tables, [RARE_GRAM], max_doc_freq=0.02))
    monkeypatch.setattr(blocking, "MAX_GRAMS", 3)
    assert rows_of(blocking.candidate_pairs(*tables, [RARE_GRAM], max_doc_freq=0.02)) == expected


@pytest.mark.parametrize(
    "target, expected",
    [
        ("s2", {"name": 25, "address": 48, "postal": 108, "house_name": 42}),
        ("s3", {"name": 37, "address": 0, "postal": 253, "house_name": 84}),
    ],
)
def test_fixture_counts(normalized, target, expected):
    for channel, n in expected.items():
        assert blocking.candidate_pairs(normalized["s1"], normalized[target], [channel]).count() == n


@pytest.mark.parametrize("channels", [KEY_CHANNELS, [RARE_GRAM], [*KEY_CHANNELS, RARE_GRAM]])
def test_pairs_of_single_rows_are_not_made_distinct(normalized, rows_of, channels):
    tables = normalized["s1"], normalized["s3"]
    pairs = blocking.candidate_pairs(*tables, channels, max_doc_freq=0.02)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [s1_id" not in plan
    each = [blocking.candidate_pairs(*tables, [c], max_doc_freq=0.02) for c in channels]
    expected = {pair for df in each for pair in rows_of(df)}
    assert rows_of(pairs) == sorted(expected, key=repr)


def test_pairs_of_repeated_and_null_ids(spark, rows_of):
    one = [*ONE, ONE[0], ("S1-1", "acme", "9 side rd", "9", ""), (None, "acme", None, "1", ""), (None, "acme", None, "1", "")]
    two = [*TWO, TWO[0], ("S2-1", "zeta", None, "9", ""), (None, "acme", None, None, None)]
    tables = spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA)
    for channels in (KEY_CHANNELS, ["postal"], ["house_name"]):
        named = [[(row[0] or "", *row[1:]) for row in rows] for rows in (one, two)]
        found = {(a or None, b or None) for a, b in brute_pairs(*named, channels)}
        expected = sorted(found, key=repr)
        assert rows_of(blocking.candidate_pairs(*tables, channels)) == expected
        listed = topk.token_overlap_pairs(blocking.candidate_pairs(*tables, channels), *tables)
        carried = blocking.candidate_pairs(*tables, channels, with_tokens=True)
        assert rows_of(topk.token_overlap_pairs(carried, *tables)) == rows_of(listed)


def test_gram_counts_hold_no_entry_per_entity(spark, rows_of):
    rows = [("a", "abcdabcd"), ("b", "abcd"), ("c", "abcde"), ("c", "abcd"), (None, "abcd"), (None, "zzzz")]
    df = spark.createDataFrame(rows, "entity_id string, name_norm string")
    counts = dict(rows_of(blocking.gram_document_frequency(df)))
    assert counts == {"abcd": 3, "bcda": 1, "cdab": 1, "dabc": 1, "bcde": 1, "zzzz": 0}
    single = blocking.gram_document_frequency(df.where("entity_id < 'c'"))
    assert "Aggregate [gram" in single._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [entity_id" not in single._jdf.queryExecution().optimizedPlan().toString()


def test_entity_tables_have_files_for_all_cores(spark, monkeypatch):
    monkeypatch.setattr(staging, "ROWS_PER_FILE", 10)
    stored = staging.stage_spread(spark.range(95).coalesce(1).toDF("entity_id"), "spread")
    assert len(stored.inputFiles()) == 10 and stored.distinct().count() == 95
