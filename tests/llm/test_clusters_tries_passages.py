"""Bisector clusters, prefix tries and shared passages against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import anchors, bisectors, common, prefix_trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# -- shared passages -------------------------------------------------------


def brute_passages(rows, window):
    """{(id, text): (n_words, n_removed, kept)}; a null id is the largest."""
    split = [(float("inf") if i is None else i, i, t, WORDS.findall(t or "")) for i, t in rows]
    first = {}
    for order, _, _, w in split:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(order, first.get(key, float("inf")))
    out = {}
    for order, i, t, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < order:
                gone[s : s + window] = [True] * window
        out[i, t] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(11)
    shared = [sentence(rng, n).split() for n in (49, 50, 51, 75, 200)]
    rows = []
    for i in range(120):
        parts = [sentence(rng, rng.randint(0, 60)).split()]
        for passage in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, 20)
            parts += [passage[cut:] if rng.random() < 0.3 else passage, sentence(rng, rng.randint(0, 9)).split()]
        words = [w for p in parts for w in p]
        rows.append((i, rng.choice([" ", "\n", "\t \r\n"]).join(words)))
    # A third of all rows are one text; a text that repeats inside itself; a long one.
    rows += [(500 + i, rows[3][1] + " " + " ".join(shared[4])) for i in range(60)]
    rows += [(700, " ".join(["again"] * 400)), (701, " ".join(["again"] * 300)), (702, sentence(rng, 30_000))]
    rows += [(703, rows[-1][1].replace(" ", "  ")), (704, "é ü " * 120), (705, "é ü " * 90)]
    rows += [(800, None), (801, ""), (802, " \n"), (None, rows[5][1]), (None, None), (5, rows[6][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window", [50, 2, 7])
def test_passages_against_brute_force(spark, passages, window):
    frame = spark.createDataFrame(
        [(i, t, "x", "y", 1) for i, t in passages], "doc_id bigint, text string, row string, found string, key int"
    ).repartition(5)
    got = anchors.remove_shared_passages(frame, window=window).select(
        "row.doc_id", "row.text", "row.found", "n_words", "n_removed", "kept"
    )
    expected = brute_passages(passages, window)
    rows = got.collect()
    assert len(rows) == len(passages)
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept) == expected[r.doc_id, r.text], r.doc_id
        assert r.found == "y"


def test_passages_dealt_in_two_steps_and_over_batches(spark, passages, monkeypatch):
    # With the name of a number's type, as many rows as it takes to see several batches.
    monkeypatch.setattr(anchors, "BUCKETS_AT_ONCE", 3)
    frame = spark.createDataFrame(passages, "doc_id bigint, text string").repartition(7)
    expected = brute_passages(passages, 50)
    for r in anchors.remove_shared_passages(frame).collect():
        assert (r.n_words, r.n_removed, r.kept) == expected[r.row.doc_id, r.row.text]


def test_passages_of_one_word_less_stay_and_spans_are_counted(spark):
    rng = random.Random(2)
    a, b = sentence(rng, 60), sentence(rng, 49)
    rows = [(1, f"{a} {b}"), (2, f"x {a} y {b} z {a}"), (3, b)]
    got = {
        r.id: (r.n_removed, r.n_spans)
        for r in anchors.remove_shared_passages(spark.createDataFrame(rows, "doc_id int, text string"))
        .select(F.col("row.doc_id").alias("id"), "n_removed", "n_spans").collect()
    }
    assert got == {1: (0, 0), 2: (120, 2), 3: (0, 0)}


def test_passages_of_text_ids_and_of_nothing(spark):
    rng = random.Random(3)
    text = sentence(rng, 80)
    rows = [("d2", text), ("d1", text), (None, text), ("d3", "short")]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.row.doc_id: r.n_removed for r in anchors.remove_shared_passages(frame).collect()}
    assert got == {"d1": 0, "d2": 80, None: 80, "d3": 0}
    none = anchors.remove_shared_passages(frame.limit(0))
    assert none.count() == 0 and "kept" in none.columns


# -- bisector clusters -----------------------------------------------------


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(),
                                        np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [
            [sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c
            for n, c in enumerate(centroids)
        ]
    placed = [(i, *nearest(v)) for i, v in kept]
    spread = defaultdict(int)
    for _, d, n in placed:
        spread[n] += d
    return sorted(
        ((i, n, d, spread[n], sum(spread.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
         for i, d, n in placed), key=repr,
    )


def clusters_of(frame, **more):
    return sorted((tuple(r) for r in bisectors.cluster_vectors(frame, **more).collect()), key=repr)


SHAPE = "vec_id bigint, embedding array<float>, cluster string"


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(64).astype(np.float32)]) for i in range(90)]
    # Ties: coarse vectors, many of them the same; repeated and null ids.
    rows += [(200 + i, [float(i % 3)] * 64) for i in range(60)]
    rows += [(300, [0.0] * 64), (300, [1.0] * 64), (None, [0.5] * 64), (301, [-0.001] * 64), (302, [5000.0] * 64)]
    bad = [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 63 + [None]), (404, [float("nan")] * 64),
           (405, [float("inf")] + [0.0] * 63), (406, [1e30] * 64)]
    frame = spark.createDataFrame([(i, v, "own") for i, v in rows + bad], SHAPE).repartition(4)
    assert clusters_of(frame) == brute_clusters(rows, 40, 5)
    assert clusters_of(frame, k=3, rounds=2) == brute_clusters(rows, 3, 2)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [0.25] * 64)]
    frame = spark.createDataFrame([(i, v, "") for i, v in rows], SHAPE)
    assert clusters_of(frame) == brute_clusters(rows, 40, 5)
    assert clusters_of(frame.limit(0)) == []


def test_a_group_of_copies_splits_over_tasks_and_changes_nothing(spark):
    rows = [(i, [0.125] * 64) for i in range(3000)] + [(5000 + i, [float(i)] * 64) for i in range(50)]
    frame = spark.createDataFrame([(i, v, "") for i, v in rows], SHAPE)
    assert clusters_of(frame.repartition(7)) == clusters_of(frame.coalesce(1))


def test_the_tournament_is_exact_at_its_limits():
    rng = np.random.default_rng(1)
    most = bisectors.MOST - 1
    centroids = rng.choice([-most, most, 0, 1], size=(9, 64)).astype(np.int64)
    x = rng.choice([-most, most, most - 1], size=(50, 64)).astype(np.int64)
    cluster, distance = bisectors.Bisectors.of(centroids).nearest(x)
    for row, c, d in zip(x, cluster, distance):
        plain = [sum((int(a) - int(b)) ** 2 for a, b in zip(row, o)) for o in centroids]
        assert (d, c) == (min(plain), plain.index(min(plain)))


# -- prefix tries ----------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        # As % of SQL: the sign of the dividend.
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = plain.get(base, [])[:h] + own[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                children[tuple(path[: d - 1])].add(tuple(path[:d]))
    out = []
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(inside) if len(built[c]) == len(node))
        out.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children[node]),
            sum(not children[n] for n in below),
            sum((len(members[n]) - 1) * len(WORDS.findall(n[-1][1])) for n in below if n),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


TURNS = "conv_id bigint, turn bigint, role string, text string, depth string"


def trie_of(frame):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame).select(prefix_trie.NODE).collect()), key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(21)
    starts = [[("user", "hello there"), ("assistant", "hi  you")], [("user", "hello there")], [("system", "")]]
    rows = []
    for c in [*range(0, 130), -7, -21, -40, 100_000, 100_001]:
        path = list(rng.choice(starts)) if rng.random() < 0.7 else []
        path += [(rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "x y z"]))
                 for _ in range(rng.randint(0 if path else 1, 5))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(path)]
    # A conversation that many share, one turn that all of some share, a long one.
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1150) for t in range(4)]
    rows += [(c, 0, "user", "same") for c in range(2000, 2080)] + [(c, 1, "user", str(c)) for c in range(2000, 2080)]
    rows += [(3000, t, "user", f"long {t % 7}") for t in range(600)]
    rows += [(3001, t, "user", f"long {t % 7}") for t in range(400)]
    rows += [(5, None, "user", "null turn"), (5, None, "user", "null turn"), (6, 0, "a", "bc"), (7, 0, "ab", "c")]
    rows += [(None, 0, "user", "of nobody"), (4000, 3, None, None), (4000, 3, None, None)]
    rng.shuffle(rows)
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "own") for r in rows], TURNS)


def test_trie_against_brute_force(spark, talks):
    assert trie_of(frame_of(spark, talks).repartition(5)) == brute_trie(talks)


def test_trie_with_conversations_over_many_ranges_and_a_full_sketch(spark, talks, monkeypatch):
    # Ranges of 40 rows cut the long conversations; a sketch of few counters
    # proves almost nothing, and nearly every prefix is grouped exactly.
    monkeypatch.setattr(prefix_trie, "ROWS_PER_RANGE", 40)
    monkeypatch.setattr(prefix_trie, "_IDS_PER_PIECE", 7)
    monkeypatch.setattr(prefix_trie, "LEAST_WIDTH", 1 << 6)
    monkeypatch.setattr(prefix_trie, "MOST_WIDTH", 1 << 6)
    monkeypatch.setattr(prefix_trie, "_SLICE", 1 << 5)
    assert trie_of(frame_of(spark, talks)) == brute_trie(talks)


def test_trie_of_little_and_nothing(spark):
    for rows in ([(3, 0, "user", "one")], [(19, 0, "a", "b")], [(40, 1, None, None), (41, 0, "x", "y")]):
        assert trie_of(frame_of(spark, rows)) == brute_trie(rows), rows
    assert trie_of(frame_of(spark, [(1, 0, "a", "b")]).limit(0)) == []
    assert trie_of(frame_of(spark, [(None, 0, "a", "b")])) == []


def test_running_sums_wrap(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), i, rng.randint(-(2**63), 2**63 - 1)) for i in range(300)]
    frame = spark.createDataFrame(rows, "g bigint, i bigint, x bigint").repartition(3)
    total, expected = defaultdict(int), {}
    for g, i, x in sorted(rows):
        total[g] += x
        expected[i] = (total[g] + 2**63) % 2**64 - 2**63
    for per_range in (50, 7):
        prefix_trie.ROWS_PER_RANGE, before = per_range, prefix_trie.ROWS_PER_RANGE
        try:
            got = prefix_trie.running_sums(frame, "g", ["i"], ["x"]).collect()
        finally:
            prefix_trie.ROWS_PER_RANGE = before
        assert {r.i: r.sum_x for r in got} == expected


def test_entries_come_to_a_task_in_small_batches(spark, passages, monkeypatch):
    """Both judging jobs get Arrow batches bounded in bytes, however long rows are."""
    jobs, plain = {}, anchors.written

    def noted(df, label, extra=None):
        jobs[label] = extra or {}
        return plain(df, label, extra)

    monkeypatch.setattr(anchors, "written", noted)
    docs = spark.createDataFrame(passages, "doc_id bigint, text string")
    anchors.remove_shared_passages(docs, window=4).collect()
    assert jobs["hits"] == jobs["repeats"] == anchors._SMALL_BATCHES

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    long_rows = spark.range(300, numPartitions=1).selectExpr("repeat('x', 100000) AS x")
    with common.settings(spark, anchors._SMALL_BATCHES):
        most = max(r.n for r in long_rows.mapInArrow(sizes, "n bigint").collect())
    assert most < 6 << 20


def test_passages_of_buckets_in_parts(spark, passages, monkeypatch):
    rng = np.random.default_rng(3)
    h, keys = rng.integers(0, 400, 2_000).astype(np.uint32), rng.integers(0, 90, 2_000)
    monkeypatch.setattr(anchors, "_AT_ONCE", 300)
    parts = list(anchors._in_parts([h], keys))
    assert len(parts) == 7 and sum(len(k) for _, k in parts) == 2_000
    met = [set(x[0].tolist()) for x, _ in parts]
    assert sum(map(len, met)) == len(set(h.tolist()))
    assert sorted((a, b) for (x,), k in parts for a, b in zip(x, k)) == sorted(zip(h, keys))
    batch = anchors._rows([(0, None, keys.tobytes(), h.tobytes(), np.ones(2_000, bool).tobytes(),
                            np.arange(2_000, dtype=np.uint16).tobytes())], anchors._SENT)
    in_parts = [sorted(b.to_pylist(), key=str) for b in anchors._hits([batch]) if b.num_rows]
    monkeypatch.setattr(anchors, "_AT_ONCE", 1 << 19)
    whole = [sorted(b.to_pylist(), key=str) for b in anchors._hits([batch]) if b.num_rows]
    bag = lambda found: {r["key"]: sorted(np.frombuffer(r["hashes"], np.uint32)) for r in found[0]}
    assert bag(in_parts) == bag(whole) and len(whole) == len(in_parts) == 1
