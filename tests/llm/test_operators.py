"""The training-data operators against brute force on small tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import (
    common,
    conversations,
    exact_dedup,
    importance,
    mixing,
    near_dedup,
    packing,
    repeats,
    selection,
    shards,
    topk,
    urls,
)
from pairloom.llm.components import connected_components
from pairloom.llm.minhash import DartMinHash
from pairloom.llm.tokens import TokenIds, _exact, _fast

SCHEMA = "doc_id bigint, text string, source string, row string, key int, norm string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty and long texts,
    repeated rows and columns named like the operators' own."""
    rng = random.Random(4)
    texts = [words(rng, rng.randint(1, 90)) for _ in range(60)]
    passage = words(rng, 70)
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(100 + i, texts[i].replace(" ", "\n\t", 1)) for i in range(0, 30, 3)]
    for i in range(12):
        w = words(random.Random(9), 80).split()
        w[3 + 5 * i] = "edited"
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, f"{words(rng, 9)} {passage} {words(rng, 9)}") for i in range(8)]
    out += [(400, None), (401, ""), (402, None), (403, " "), (404, words(rng, 30_000)), (405, "aé" * 400)]
    out += [(None, texts[0]), (None, None), (7, "another text with id seven")]
    rng.shuffle(out)
    return [(i, t, None if n % 11 == 0 else f"s{n % 4}", "x", n, "y") for n, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def unique_rows(rows):
    seen = {}
    for r in rows:
        if r[0] is not None:
            seen.setdefault(r[0], r)
    return list(seen.values())


@pytest.fixture(scope="module")
def unique_docs(spark, unique_rows):
    return spark.createDataFrame(unique_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


# -- URL filters -----------------------------------------------------------


def test_urls_against_brute_force(spark):
    hosts = ["example.com", "www.example.com", "a.b.example.com", "notexample.com", "x.net", "net",
             "EXAMPLE.com", "example.com:80", "example.org", "com", "example.com.", ""]
    tails = ["", "/", "/en/", "/en/a?x=1", "/es/1#t", "/fr", "?u=http://example.com/en/", "#/en/"]
    data = [(i, f"http://{h}{t}") for i, (h, t) in enumerate((h, t) for h in hosts for t in tails)]
    data += [(1000, None), (1001, "no scheme/en/"), (1002, ""), (1003, "://example.com/en/"), (5, data[5][1])]
    frame = spark.createDataFrame([(i, u, "h", "r") for i, u in data], "page_id int, url string, host string, range string")
    rules = spark.createDataFrame(
        [*urls.RULES, ("block", "a.b.example.com", ""), ("allow", None, "/"), ("block", "example.com", "/en/")], urls.RULE_COLUMNS
    )
    listed = [*urls.RULES, ("block", "a.b.example.com", "")]

    def judge(url):
        at = -1 if url is None else url.find("://")
        if at < 0:
            return "", "", None, "allow"
        rest = url[at + 3 :]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:end].lower(), rest[end:]
        path = rest.split("?")[0].split("#")[0] if rest.startswith("/") else ""
        fits = [(len(h + p), len(h), v, h + p) for v, h, p in listed
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    got = urls.filter_urls(frame, rules).select("row.page_id", "row.url", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(data)
    for r in got:
        assert tuple(r)[2:] == judge(r.url), r
    none = spark.createDataFrame([], urls.RULE_COLUMNS)
    assert {r.verdict for r in urls.filter_urls(frame, none).collect()} == {"allow"}
    assert urls.filter_urls(frame.limit(0), rules).count() == 0


# -- repeated strings ------------------------------------------------------


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [repeats.CROWD, 2])
def test_repeats_against_brute_force(unique_docs, unique_rows, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    expected = brute_repeats([(r[0], r[1] or "") for r in unique_rows], repeats.LENGTH)
    got = repeats.remove_repeats(unique_docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected


def test_repeats_of_repeated_and_null_ids(docs, rows, no_docs):
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    last = [r for r in got if r.row.doc_id is None and r.row.text]
    assert all(r.n_removed == r.n_bytes for r in last if r.n_bytes >= repeats.LENGTH)
    assert repeats.remove_repeats(no_docs).count() == 0


def test_triggers_across_slices(monkeypatch):
    rng = random.Random(1)
    raw = np.frombuffer(words(rng, 3_000).encode(), dtype=np.uint8)
    ends, starts = np.array([len(raw)]), np.array([0])
    whole = [(lo + t).tolist() for _, lo, s, t, _ in repeats._slices(raw, starts, ends, 100, 32)]
    monkeypatch.setattr(repeats, "_SLICE", 1_000)
    parts = [(lo + t).tolist() for _, lo, s, t, _ in repeats._slices(raw, starts, ends, 100, 32)]
    assert sum(whole, []) == sum(parts, [])


# -- shards and packing ----------------------------------------------------


def test_feistel_is_a_permutation():
    for size in (1, 2, 3, 5, 64, 1_000, 4_097):
        assert sorted(shards.feistel(np.arange(size), size)) == list(range(size))


def test_token_ids_equal_the_reference_library():
    exact = _exact()
    rng, encoder = random.Random(2), TokenIds()
    alphabet = "ab Zé\n\t  .,!'0 9ßüñ’“ -|日я \u0085"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1_500)]
    texts += ["<|endoftext|> x", "it's don't 'll", "a <|endoftext|>"]
    for t in texts:
        expected = exact.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(t), "<u2").tolist() == expected, t


def test_shards_round_trip(spark, docs, rows, no_docs):
    folder = shards.new_folder(spark)
    made = shards.write_training_order(docs, folder, window=64, per_shard=16).collect()
    read = shards.read_training_order(spark, folder).collect()
    n = len(made)
    assert sorted(r.slot for r in read) == list(range(n)) == sorted(r.slot for r in made)
    assert all(r.byte_offset == (r.slot % 16) * 129 and r.shard == r.slot // 16 for r in read)
    by_slot = {r.slot: np.frombuffer(r.ids, "<u2") for r in read}
    stream = [by_slot[r.slot][: r.n_tokens] for r in sorted(made, key=lambda r: r.sequence_id)]
    encoder = TokenIds()
    total = sum(len(encoder.ids(r[1] or "")) // 2 + 1 for r in rows)
    assert sum(map(len, stream)) == total
    texts = "".join(sorted("".join(sorted(_fast().decode(list(np.concatenate(stream)))))))
    assert texts.replace('"', "") == "".join(sorted("".join(r[1] or "" for r in rows)))
    assert shards.read_training_order(spark, folder, n - 20).count() == 20
    empty = shards.new_folder(spark)
    assert shards.write_training_order(no_docs, empty).count() == 0
    assert shards.read_training_order(spark, empty).count() == 0


def test_packing_covers_every_id_once(docs, rows, no_docs):
    pieces = packing.pack_documents(docs, window=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        assert sum(p.length for p in ps) <= 256
    short = [s for s in by_sequence.values() if sum(p.length for p in s) < 256]
    assert len(short) <= 1
    encoder = TokenIds()
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(np.append(np.frombuffer(encoder.ids(r[1] or ""), "<u2"), 1))
    for doc, ps in by_doc.items():
        assert sum(p.length for p in ps) == sum(map(len, texts[doc]))
        if len(texts[doc]) == 1:
            ids, at = texts[doc][0], 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].astype("<u4").tobytes())
                at += p.length
    assert packing.pack_documents(no_docs).count() == 0


def test_packing_finds_the_best_neighbours_across_shards(spark, monkeypatch):
    rng = random.Random(8)
    topics = [words(rng, 25).split() for _ in range(40)]
    common = words(rng, 200).split()
    texts = []
    for i in range(480):
        topic = topics[i % 40]
        texts.append(" ".join(rng.choice(topic) if rng.random() < 0.7 else rng.choice(common) for _ in range(40)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    encoder = TokenIds()
    ids = [np.append(np.frombuffer(encoder.ids(t), "<u2"), 1) for t in texts]
    total = sum(map(len, ids))
    monkeypatch.setattr(packing, "SHARD_TOKENS", total // 16)
    pieces = packing.pack_documents(frame, window=512).collect()
    assert sum(p.length for p in pieces) == total
    shards_of, in_shard = defaultdict(set), defaultdict(int)
    for p in pieces:
        shards_of[p.doc_id].add(p.sequence_id >> 24)
        in_shard[p.sequence_id >> 24] += p.length
    assert len(in_shard) >= 8 and max(in_shard.values()) <= 1.6 * total / 16
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=packing.VOCABULARY)
    index = packing.InvertedIndex(ids, np.log1p((480 - df + 0.5) / (df + 0.5)), total / 480)
    reached = []
    for i in range(480):
        scores = index.scores(i)
        scores[i] = -1
        reached += [bool(shards_of[i] & shards_of[int(j)]) for j in np.argsort(-scores, kind="stable")[:5]]
    assert np.mean(reached) >= 0.6


def test_index_scores_against_the_formula():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(0, 30, n) for n in (5, 40, 17, 3)]
    idf = rng.random(packing.VOCABULARY)
    index = packing.InvertedIndex(pieces, idf, 16.0)
    for q in range(4):
        for d, p in enumerate(pieces):
            norm = packing.K1 * (1 - packing.B + packing.B * len(p) / 16.0)
            tf = {t: (p == t).sum() for t in set(pieces[q].tolist())}
            score = sum(idf[t] * n * (packing.K1 + 1) / (n + norm) for t, n in tf.items() if n)
            assert index.scores(q)[d] == pytest.approx(score)


# -- conversations ---------------------------------------------------------


def test_reply_trees(spark):
    m = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b<#\\", 1.0), (1, 3, 1, "assistant", "c", 5.0),
         (1, 4, 3, "user", None, 0.0), (1, 5, 2, "user", "</turn>\n### user\n", 9.0), (2, 1, None, None, "only", None),
         (3, 1, 9, "user", "lost parent", 0.0), (4, 1, 2, "user", "circle", 0.0), (4, 2, 1, "user", "circle", 0.0)]
    frame = spark.createDataFrame(m, "tree int, node bigint, parent bigint, role string, text string, score double")
    got = conversations.format_trees(frame, paths_per_tree=2)
    turns = conversations.read_turns(F.col("formatted"))
    learned = conversations.masked_text(F.col("formatted"), F.col("mask"))
    out = {(r.tree, r["rank"]): r for r in got.withColumns({"turns": turns, "learned": learned}).collect()}
    assert [tuple(t) for t in out[1, 1].turns] == [("user", "a"), ("assistant", "b<#\\"), ("user", "</turn>\n### user\n")]
    assert out[1, 1].learned == "b<#\\" and out[1, 2].learned == "c"
    assert [tuple(t) for t in out[2, 1].turns] == [("", "only")]
    assert set(out) == {(1, 1), (1, 2), (2, 1), (3, 1)}
    assert conversations.format_trees(frame.limit(0)).count() == 0


def test_branches_into_circles_end_and_are_left_out(spark):
    shape = "tree int, node bigint, parent bigint, role string, text string, score double"
    m = [(1, 1, 2, "u", "x", 9.0), (1, 2, 1, "u", "x", 9.0), (1, 3, 1, "u", "x", 9.0), (1, 4, 3, "u", "x", 9.0),
         (1, 5, None, "u", "root", 0.0), (1, 6, 5, "u", "leaf", 0.0), (2, 1, 1, "u", "own parent", 0.0),
         (2, 2, 1, "u", "x", 0.0)]
    # A long chain with a branch near its root, which has the better mean.
    m += [(3, i, i - 1 if i else None, "u", str(i), float(i == 1)) for i in range(150)] + [(3, 900, 1, "u", "b", 0.0)]
    frame = spark.createDataFrame(m, shape).repartition(3)
    got = conversations.format_trees(frame, paths_per_tree=5).select("tree", "leaf", "rank", "n_turns", "formatted")
    rows = {(r.tree, r["rank"]): (r.leaf, r.n_turns) for r in got.collect()}
    assert rows == {(1, 1): (6, 2), (3, 1): (900, 3), (3, 2): (149, 150)}
    paths = conversations.paths_to_root(frame.where("tree < 3").select("tree", "node", "parent")).collect()
    assert sorted((r.tree, r.leaf, r.node, r.up) for r in paths) == [(1, 6, 5, 1), (1, 6, 6, 0)]
    only = frame.where("tree = 2")
    assert conversations.format_trees(only).count() == 0


def test_null_and_repeated_keys_of_trees(spark):
    turns = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 0, "user", "c"), (None, 1, "assistant", "b")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    read = conversations.read_turns(F.col("formatted"))
    got = conversations.format_trees(conversations.chains(frame)).withColumn("turns", read).collect()
    assert {r.tree: [t.text for t in r.turns] for r in got} == {None: ["a", "b", "b"], 5: ["c"]}
    m = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "user", "z", 9.0), (1, 2, 1, "user", "b", 9.0),
         (1, None, 1, "user", "n", 3.0), (1, None, 1, "user", "n", 3.0), (None, 1, None, "user", "t", 0.0)]
    frame = spark.createDataFrame(m, "tree bigint, node bigint, parent bigint, role string, text string, score double")
    got = conversations.format_trees(frame, paths_per_tree=9).withColumn("turns", read).collect()
    out = sorted(((r.tree, r["rank"], r.leaf, r.n_turns, [t.text for t in r.turns]) for r in got), key=repr)
    assert out == [
        (1, 1, 2, 2, ["a", "b"]), (1, 2, None, 2, ["a", "n"]), (1, 3, None, 2, ["a", "n"]), (None, 1, 1, 1, ["t"])
    ]


def test_deep_chain_needs_few_rounds(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(150)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    r = conversations.format_trees(conversations.chains(frame)).withColumn(
        "turns", conversations.read_turns(F.col("formatted"))
    ).first()
    assert [t.text for t in r.turns] == [f"t{t}" for t in range(150)]


# -- mixing ----------------------------------------------------------------


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    open_, left, target = set(order), float(sum(sizes.values())), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s], left = 3.0 * sizes[s], left - 3 * sizes[s]
        open_ -= over


def test_mixing(docs, rows, no_docs):
    plan = mixing.curriculum(docs).select("row.*", "size", "source_size", "target", "taken", "positions").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    targets, taken = brute_targets(sizes), defaultdict(int)
    assert len(plan) == len(rows)
    for r in plan:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert r.taken <= 3 * r.size and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(r.size for r in plan if r.source == s) / 2 + 1
    again = mixing.curriculum(docs.repartition(5)).select("row.doc_id", "taken").collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, plan))
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.curriculum(no_docs).count() == 0


def test_positions_invert_the_integral(spark):
    for schedule in mixing.SCHEDULES:
        areas = np.linspace(0, 0.999, 50)
        at = [r[0] for r in spark.createDataFrame([(float(a),) for a in areas], "a double").select(
            mixing.training_position(F.col("a"), schedule)).collect()]
        t, w = np.array([k[0] for k in schedule]), np.array([k[1] for k in schedule])
        for a, x in zip(areas, at):
            grid = np.linspace(0, x, 2_001)
            assert np.trapezoid(np.interp(grid, t, w), grid) == pytest.approx(a, abs=1e-5)


# -- duplicates ------------------------------------------------------------


def test_exact_duplicates(docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "choose_ranges", lambda *a: 300)
    groups = defaultdict(list)
    import re
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.row.text or "")
        ids = [i for i in groups[norm] if i is not None]
        assert r.keep_id == (min(ids) if ids else None) and r.group_size == len(groups[norm])
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
        kept[norm] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_one_text_for_all(spark):
    frame = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("same  text").alias("text"))
    got = exact_dedup.exact_duplicates(frame).groupBy("keep_id", "group_size").agg(F.sum(F.col("kept").cast("int"))).collect()
    assert [tuple(r) for r in got] == [(0, 3_000, 1)]


def test_many_repeated_rows_without_id_are_spread(spark, monkeypatch):
    seen = []
    plain = exact_dedup.range_index

    def listed(key, cuts):
        seen.append(cuts)
        return plain(key, cuts)

    monkeypatch.setattr(exact_dedup, "range_index", listed)
    same = spark.range(100_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("same text").alias("text"))
    frame = same.unionByName(spark.createDataFrame([(5, "other"), (5, "other")], same.schema))
    whole = exact_dedup.exact_duplicates(frame)
    got = whole.groupBy("keep_id", "group_size").agg(F.sum(F.col("kept").cast("int"))).collect()
    assert {tuple(r) for r in got} == {(None, 100_000, 1), (5, 2, 1)}
    per_task = whole.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
    assert len(seen[0]) > 200 and per_task[0] < 3_000 and per_task[1] > 200


def brute_classes(rows, least=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= least:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates(unique_docs, unique_rows, docs, rows, no_docs):
    got = near_dedup.near_duplicates(unique_docs).select("row.doc_id", "class_id", "kept").collect()
    expected = brute_classes([(r[0], r[1]) for r in unique_rows])
    assert {r.doc_id: r.class_id for r in got} == expected
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert near_dedup.near_duplicates(docs).count() == len(rows)
    assert near_dedup.drop_near_duplicates(unique_docs).columns == unique_docs.columns
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_of_a_family_without_links_to_its_leader(spark):
    """Many copies with edits of their own around one text: some are linked only
    through others."""
    rng = random.Random(8)
    base = words(rng, 150).split()
    texts = [" ".join(base)]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            p = rng.randrange(len(w))
            w[p : p + 1] = [] if rng.random() < 0.4 else [words(rng, 1)]
        texts.append(" ".join(w))
        v = w[:]
        v[rng.randrange(len(v))] = words(rng, 1)
        texts.append(" ".join(v))
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[j]) for i, j in enumerate(order)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame).select("row.doc_id", "class_id").collect()}
    assert got == brute_classes(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    darts = DartMinHash(2_000)
    e = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a, b = rng.random(300) * 3 + 0.01, rng.random(300) * 3 + 0.01
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (darts.signature(e, a) == darts.signature(e, b)).mean() == pytest.approx(exact, abs=0.05)
    assert (darts.signature(e[:200]) == darts.signature(e[100:])).mean() == pytest.approx(1 / 3, abs=0.05)
    assert (darts.signature(e[:1]) == darts.signature(e[:1])).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5)] + [(200, i) for i in range(201, 230)]
    got = connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in got} == (
        {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in range(200, 230)}
    )


# -- quality ---------------------------------------------------------------


def test_quality_on_held_out_labels(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    learn, hold = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0 and toxic = 0")
    got = importance.quality_scores(docs, learn).select("row.doc_id", "kept").join(hold, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [not r.kept for r in got if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) >= 0.9


def test_quality_against_brute_force(spark, unique_docs, unique_rows):
    labels = [(r[0], r[0] % 3 > 0, r[0] % 7 == 0) for r in unique_rows if r[0] < 200]
    frame = spark.createDataFrame(
        [(i, int(f), int(t)) for i, f, t in labels], "doc_id bigint, quality int, toxic int"
    )
    fold = {r.id: r.fold for r in importance.labelled_sample(frame).collect()}
    found = {r[0]: importance.features(r[1] or "", {}) for r in unique_rows}
    n = importance.BUCKETS

    def model(ids):
        raw, target = np.zeros(n), np.zeros(n)
        for f in found.values():
            np.add.at(raw, f, 1)
        for i in ids:
            np.add.at(target, found[i], 1)
        p = (raw + 0.5) / (raw.sum() + 0.5 * n)
        return np.log((target + 0.5 * n * p) / (target.sum() + 0.5 * n) / p)

    size = lambda i: len(found[i]) + importance.SHRINK
    good = [i for i, f, t in labels if f and not t]
    judged = good + [i for i, f, _ in labels if not f]
    without = [model([i for i in good if fold[i] != k]) for k in range(importance.FOLDS)]
    cutoff = importance._best_cutoff(
        [(without[fold[i]][found[i]].sum() / size(i), i in set(good)) for i in judged]
    )
    whole = model(good)
    weight = {i: whole[f].sum() for i, f in found.items()}
    keys = spark.createDataFrame([(i,) for i in found], "key bigint")
    noise = dict(keys.select("key", importance._gumbel(F.col("key"), 5)).collect())
    drawn = {i: (weight[i] + noise[i]) / size(i) for i in found}
    k = sum(weight[i] / size(i) > cutoff for i in found)
    kept = set(sorted(found, key=lambda i: (-drawn[i], i))[:k])
    got = importance.quality_scores(unique_docs, frame).collect()
    assert 0 < k < len(found) and {r.row.doc_id for r in got if r.kept} == kept
    assert {r.row.doc_id: r.log_weight for r in got} == pytest.approx(weight)
    # The noise tells: the largest scores alone would be other documents.
    assert kept != set(sorted(found, key=lambda i: -weight[i] / size(i))[:k])


def test_quality_edge_cases(spark, docs, rows, no_docs):
    kind = "doc_id bigint, quality int, toxic int"
    none = spark.createDataFrame([], kind)
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 0), (2, None, 0), (3, 0, 0), (3, 1, 0), (4, 1, 0)], kind)
    assert importance.quality_scores(docs, none).where("kept").count() == len(rows)
    assert importance.quality_scores(docs, odd).count() == len(rows)
    assert importance.quality_scores(no_docs, odd).count() == 0
    assert importance.keep_good(docs, odd).columns == docs.columns


def test_one_class_of_labels_keeps_everything(spark, docs, rows):
    for quality in (1, 0):
        labels = spark.createDataFrame([(i, quality, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
        assert importance.quality_scores(docs, labels).where("kept").count() == len(rows)
    assert importance._best_cutoff([(0.3, False), (0.1, False)]) == -float("inf")
    assert importance._best_cutoff([(0.3, True)]) == -float("inf")


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 3)
    monkeypatch.setattr(selection, "BINS", 4)
    rng = random.Random(6)
    data = [(rng.choice([0.5, 1.25, rng.random() * 9]), i) for i in range(200)]
    frame = spark.createDataFrame(data, "s double, k bigint")
    ranked = sorted(data, key=lambda r: (-r[0], r[1]))
    for k in (1, 7, 60, 120, 200, 500):
        assert selection.kth_largest(frame, "s", "k", k) == ranked[min(k, 200) - 1]
    assert selection.kth_largest(frame, "s", "k", 0) is None


# -- top-k -----------------------------------------------------------------


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "BINS", 8)
    rng = random.Random(7)
    data = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.3]) for _ in range(4)], 0) for i in range(160)]
    data += [(i, [0.5, 0.5, 0.5, 0.5], 1) for i in range(200, 290)]
    data += [(300, None, 1), (320, [1.0, None], 1), (340, [float("nan")] * 4, 1), (360, [float("inf")] * 4, 1),
             (None, [0.1] * 4, 1), (380, [0.9, 0.9], 1), (400, [], 1), (21, [0.7] * 4, 1)]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, query_id int")
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=20).collect()
    fine = [(i, np.floor(64 * np.array(v + [0.0] * (4 - len(v))))) for i, v, _ in data
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = set()
    for q, v in fine:
        if q % 20 == 0:
            scored = sorted((-int(v @ c), i) for i, c in fine if i != q)[:20]
            expected |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = topk.top_k(frame.where("vec_id in (20, 40, 60)"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 6


def test_top_k_beside_a_very_long_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "BINS", 16)
    passes = []
    plain = topk._pass

    def listed(pairs, limits, work, schema):
        passes.append(plain(pairs, limits, work, schema))
        return passes[-1]

    monkeypatch.setattr(topk, "_pass", listed)
    rng = np.random.default_rng(3)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 3)))]
    # One very long vector, and repeated rows of one id.
    data += [(1_000, [2.0**14] * 3)] + [(1_001, [0.5, -0.5, 1.0])] * 300
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = topk.top_k(frame, F.col("vec_id") % 100 == 0, k=5).collect()
    fine = [(i, np.floor(64 * np.array(v))) for i, v in data]
    expected = []
    for q, v in fine:
        if q % 100 == 0:
            scored = sorted((-int(v @ c), i) for i, c in fine if i != q)[:5]
            expected += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, got)) == sorted(expected)
    # Passes between the first and the last: each query sends 16 counts at most.
    assert len(passes) > 5
    for counts in passes[1:-1]:
        assert counts.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 16


def test_document_frequencies_come_with_the_tokens(spark):
    rng = random.Random(17)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(120)] + ["", "é日 <|endoftext|>"]
    keyed = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string").repartition(3)
    # Several batches a task: only the last row of a task tells the counts.
    with common.settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "7"}):
        tokens = common.written(packing.counted_tokens(keyed), "tokens")
    assert tokens.where("seen is not null").count() <= 3
    expected, encoder = np.zeros(packing.VOCABULARY), TokenIds()
    for r in tokens.collect():
        ids = encoder.ids(texts[r.key]) + b"\x01\x00"
        assert bytes(r.ids) == ids and r.n == len(ids) // 2
        expected[np.unique(np.frombuffer(ids, "<u2"))] += 1
    assert packing.document_frequencies(tokens).tolist() == expected.tolist()
