"""SQL counterparts of the registered queries, for checking their results."""

from pairloom import fixtures

# The tuning grid, stated here by itself.
SINGLETON_CAPS = [
    0.3,
    0.35,
    0.39999999999999997,
    0.44999999999999996,
    0.49999999999999994,
    0.5499999999999999,
    0.5999999999999999,
    0.6499999999999999,
    0.7,
    0.7499999999999999,
]
THRESHOLDS = [
    0.4,
    0.45,
    0.5,
    0.55,
    0.6,
    0.6499999999999999,
    0.7,
    0.75,
    0.7999999999999999,
    0.8499999999999999,
]
MARGINS = [0.0, 0.05, 0.1, 0.15000000000000002, 0.2, 0.25]

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "

# Lines of an id-list file with faults sown in, from the customer keys.
SUBMISSION = """
SELECT 'matching_results' AS file, c_custkey + 1 AS line_no,
  CASE c_custkey % 60
    WHEN 1 THEN 'no tab here ' || CAST(c_custkey AS STRING)
    WHEN 2 THEN '   '
    WHEN 3 THEN id || chr(9) || 'S2-' || CAST(c_custkey + 1 AS STRING) || ',S2-' || CAST(c_custkey + 1 AS STRING)
    WHEN 4 THEN id || chr(9) || 'S1-' || CAST(c_custkey AS STRING) || ',X-' || CAST(c_custkey AS STRING)
    WHEN 5 THEN id || chr(9) || 'S2-' || CAST(c_custkey + 1000000 AS STRING) || ','
    WHEN 6 THEN 'S1-' || CAST(c_custkey + 2 AS STRING) || chr(9) || 'S3-' || CAST(c_custkey AS STRING)
    WHEN 7 THEN id || 'x' || chr(9)
    WHEN 8 THEN id || chr(9) || 'S2-' || CAST(c_custkey - 1 AS STRING) || chr(9) || 'tail'
    ELSE id || chr(9) || CASE WHEN c_custkey % 3 <> 0 THEN 'S2-' || CAST(c_custkey AS STRING) ELSE ' ' END
  END AS value
FROM (SELECT c_custkey, 'S1-' || CAST(c_custkey AS STRING) AS id FROM customer) AS keyed
"""


def _norm(source: str) -> str:
    return f"""
{source}_norm AS (
  SELECT *, trim(regexp_replace(name_norm,
      '\\b(inc|incorporated|ltd|limited|llc|corp|corporation|pvt|private|co)\\b', '', 'g')) AS name_core
  FROM (SELECT entity_id, business_name AS name_raw, business_address AS address_raw, country,
      {_clean("replace(lower(business_name), '&', ' and ')")} AS name_norm,
      {_clean("lower(business_address)")} AS address_norm,
      regexp_extract(business_address, '^\\s*([0-9]+)', 1) AS house_number,
      regexp_extract(business_address, '([0-9]{{5,6}})', 1) AS postal_code
    FROM {source}))"""


def _clean(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '[^a-z0-9 ]', ' ', 'g'))"


def _target(t: str) -> str:
    """Candidate tables of one target."""

    def channel(condition: str, empty: str = "") -> str:
        return (
            f"SELECT DISTINCT a.entity_id AS s1_id, o.entity_id AS other_id "
            f"FROM s1_norm a JOIN {t}_norm o ON {condition} {empty}"
        )

    first = "split_part(a.name_norm, ' ', 1) = split_part(o.name_norm, ' ', 1)"
    return f"""
{t}_name AS ({channel("a.name_norm = o.name_norm", "WHERE a.name_norm <> ''")}),
{t}_address AS ({channel("a.address_norm = o.address_norm", "WHERE a.address_norm <> ''")}),
{t}_postal AS ({channel("a.postal_code = o.postal_code")}),
{t}_postal_nonempty AS ({channel("a.postal_code = o.postal_code", "WHERE a.postal_code <> ''")}),
{t}_house_name AS ({channel("a.house_number = o.house_number AND " + first)}),
{t}_union AS (SELECT * FROM {t}_name UNION SELECT * FROM {t}_address
  UNION SELECT * FROM {t}_postal UNION SELECT * FROM {t}_house_name),
{t}_rare_gram AS (SELECT DISTINCT g.entity_id AS s1_id, o.entity_id AS other_id
  FROM s1_grams g JOIN rare USING (gram) JOIN {t}_grams o USING (gram)),
{t}_all AS (SELECT * FROM {t}_union UNION SELECT * FROM {t}_rare_gram),
{t}_overlap AS (SELECT s1_id, other_id, CAST(len(list_intersect(
    string_split(a.name_norm, ' '), string_split(o.name_norm, ' '))) AS INT) AS token_overlap
  FROM {t}_all JOIN s1_norm a ON a.entity_id = s1_id JOIN {t}_norm o ON o.entity_id = other_id),
{t}_top AS (SELECT * FROM {t}_overlap QUALIFY row_number() OVER (
    PARTITION BY s1_id ORDER BY token_overlap DESC NULLS LAST, other_id) <= 25),
{t}_exact AS (SELECT s1_id, other_id,
    a.name_norm = o.name_norm AS name_exact,
    a.address_norm = o.address_norm AS address_exact,
    a.postal_code = o.postal_code AND a.postal_code IS NOT NULL AS postal_match,
    a.house_number = o.house_number AND a.house_number IS NOT NULL AS house_match,
    a.country = o.country AS country_match,
    coalesce(a.address_norm, '') = '' AS s1_addr_missing,
    coalesce(o.address_norm, '') = '' AS other_addr_missing,
    a.name_norm AS s1_name, o.name_norm AS other_name,
    a.address_norm AS s1_addr, o.address_norm AS other_addr
  FROM {t}_top JOIN s1_norm a ON a.entity_id = s1_id JOIN {t}_norm o ON o.entity_id = other_id),
{t}_near AS (SELECT a.entity_id AS s1_id, o.entity_id AS other_id,
    round(list_inner_product(a.vector, o.vector), 12) AS cosine_sim
  FROM s1_vectors a JOIN {t}_vectors o ON a.country = o.country
  QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY cosine_sim DESC, other_id) <= 15)"""


def _grams(source: str) -> str:
    return f"""
{source}_grams AS (SELECT entity_id, substr(name_norm, i, 4) AS gram
  FROM (SELECT entity_id, name_norm, unnest(range(1, length(name_norm) - 2)) AS i
    FROM {source}_norm WHERE length(name_norm) >= 4))"""


def _vectors(source: str) -> str:
    counts = ", ".join(f"CAST(length(t) - length(replace(t, '{c}', '')) AS DOUBLE)" for c in LETTERS)
    return f"""
{source}_vectors AS (SELECT entity_id, country,
    list_transform(counts, lambda x: CASE WHEN size > 0 THEN x / size ELSE 0 END) AS vector
  FROM (SELECT *, sqrt(list_inner_product(counts, counts)) AS size
    FROM (SELECT *, [{counts}] AS counts
      FROM (SELECT entity_id, country, concat_ws(' ', name_norm, address_norm) AS t FROM {source}_norm))))"""


def _lcs(a: str, b: str) -> str:
    """Longest common subsequence length, row by row of the usual table."""
    start = f"list_transform(range(1, length({a}) + 2), lambda i: 0)"
    letters = f"list_transform(string_split({b}, ''), lambda c: [unicode(c)])"
    step = (
        f"list_transform(range(1, length({a}) + 2), lambda k: list_max(list_transform("
        f"range(1, k + 1), lambda j: CASE WHEN j > 1 AND unicode(substr({a}, j - 1, 1)) = c[1] "
        f"THEN r[j - 1] + 1 ELSE r[j] END)))"
    )
    return f"list_max(list_reduce({letters}, lambda r, c: {step}, {start}))"


def _ratio(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 WHEN {a} = {b} THEN 100.0 "
        f"WHEN {a} = '' OR {b} = '' THEN 0.0 "
        f"ELSE 200.0 * {_lcs(a, b)} / (length({a}) + length({b})) END"
    )


def _sorted_words(a: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({a}, ' '), lambda w: w <> '')), ' ')"


def _both(select: str) -> str:
    """``select`` with {t} for each target, one below the other."""
    return " UNION ALL ".join(select.replace("{t}", t) for t in ("s2", "s3"))


def _tagged(body: str) -> str:
    return _both(f"SELECT '{{t}}' AS target, * FROM ({body})")


_FLAGS = [
    "name_exact", "address_exact", "postal_match", "house_match",
    "country_match", "s1_addr_missing", "other_addr_missing",
]

_FUZZY = {
    "name_lev": ("s1_name", "other_name", False),
    "name_token_sort": ("s1_name", "other_name", True),
    "addr_lev": ("coalesce(s1_addr, '')", "coalesce(other_addr, '')", False),
    "addr_token_sort": ("coalesce(s1_addr, '')", "coalesce(other_addr, '')", True),
}


def _fuzzy_table(t: str, score: str) -> str:
    a, b, by_word = _FUZZY[score]
    if by_word:
        a, b = _sorted_words(a), _sorted_words(b)
    return (
        f"(WITH texts AS (SELECT s1_id, other_id, {a} AS a, {b} AS b FROM {t}_exact), "
        f"scored AS (SELECT a, b, {_ratio('a', 'b')} AS ratio FROM (SELECT DISTINCT a, b FROM texts)) "
        f"SELECT s1_id, other_id, round(ratio, 6) AS {score} FROM texts JOIN scored "
        f"ON texts.a IS NOT DISTINCT FROM scored.a AND texts.b IS NOT DISTINCT FROM scored.b)"
    )


def _features(t: str) -> str:
    flags = ", ".join(f"coalesce(CAST(e.{f} AS DOUBLE), 0.0) AS {f}" for f in _FLAGS)
    joins = " ".join(f"JOIN {_fuzzy_table(t, s)} f_{s} USING (s1_id, other_id)" for s in _FUZZY)
    return (
        f"SELECT s1_id, other_id, {flags}, {', '.join(_FUZZY)}, "
        f"round(coalesce(n.cosine_sim, 0.0), 6) AS cosine_sim "
        f"FROM {t}_exact e {joins} LEFT JOIN {t}_near n USING (s1_id, other_id)"
    )


def _values(name: str, column: str, values: list[float]) -> str:
    rows = ", ".join(f"(CAST({v!r} AS DOUBLE), {i})" for i, v in enumerate(values))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS v({column}, {column}_i))"


_SCORED = _both(
    "SELECT s1_id, other_id, round(coalesce(token_overlap / greatest("
    "len(list_distinct(string_split(s1_name, ' '))), "
    "len(list_distinct(string_split(other_name, ' ')))), 0), 4) AS score "
    "FROM {t}_exact JOIN {t}_top USING (s1_id, other_id)"
)

_F05 = (
    "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 "
    "ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"
)

_QUALITY = """
    round(avg(f0_5), 6) AS macro_f0_5,
    round(avg(CASE WHEN n_true = 0 THEN f0_5 END), 6) AS singleton_f0_5,
    round(CASE WHEN sum(n_pred) = 0 THEN 0.0 ELSE sum(tp) / sum(n_pred) END, 6) AS pooled_precision,
    round(CASE WHEN sum(n_true) = 0 THEN 0.0 ELSE sum(tp) / sum(n_true) END, 6) AS pooled_recall,
    count(*) AS n_entities,
    count(*) FILTER (WHERE n_true = 0) AS n_singletons"""

_COMMON = (
    fixtures.BASE.strip()
    + ","
    + ",".join(
        [f" s1 AS ({fixtures.S1})", f" s2 AS ({fixtures.S2})", f" s3 AS ({fixtures.S3})"]
        + [f" gt AS ({fixtures.GROUND_TRUTH})"]
        + [_norm(s) for s in ("s1", "s2", "s3")]
        + [_grams(s) for s in ("s1", "s2", "s3")]
        + [_vectors(s) for s in ("s1", "s2", "s3")]
        + [
            " total AS (SELECT count(DISTINCT entity_id) AS n_entities FROM s1_norm)",
            " gram_df AS (SELECT gram, count(DISTINCT entity_id) AS df FROM s1_grams GROUP BY gram)",
            " rare AS (SELECT gram FROM gram_df, total WHERE CAST(df AS DOUBLE) / n_entities < 0.001)",
        ]
        + [_target(t) for t in ("s2", "s3")]
        + [
            " gt_pairs AS (SELECT source1_entity_id AS s1_id, unnest(string_split(matched_entity_ids, ',')) "
            "AS other_id FROM gt WHERE matched_entity_ids <> '')",
            " gt_sizes AS (SELECT source1_entity_id AS s1_id, CASE WHEN matched_entity_ids = '' THEN 0 "
            "ELSE len(string_split(matched_entity_ids, ',')) END AS n_true FROM gt)",
            f" scored AS ({_SCORED})",
            " topped AS (SELECT *, max(score) OVER (PARTITION BY s1_id) AS top FROM scored)",
            " decided AS (SELECT s1_id, other_id FROM topped WHERE top >= 0.4 AND score >= greatest(0.5, top - 0.25))",
            " decided_counts AS (SELECT s1_id, count(*) AS n_pred, count(g.other_id) AS tp "
            "FROM decided LEFT JOIN gt_pairs g USING (s1_id, other_id) GROUP BY s1_id)",
            f" entity_scores AS (SELECT *, {_F05} AS f0_5 FROM (SELECT s1_id, n_true, "
            "coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp "
            "FROM gt_sizes LEFT JOIN decided_counts USING (s1_id)))",
            " " + _values("caps", "singleton_cap", SINGLETON_CAPS),
            " " + _values("thresholds", "threshold", THRESHOLDS),
            " " + _values("margins", "margin", MARGINS),
            " cells AS (SELECT * FROM caps, thresholds, margins)",
            " cell_counts AS (SELECT singleton_cap, threshold, margin, s1_id, count(*) AS n_pred, "
            "count(g.other_id) AS tp FROM topped JOIN cells ON top >= singleton_cap "
            "AND score >= greatest(threshold, top - margin) LEFT JOIN gt_pairs g USING (s1_id, other_id) "
            "GROUP BY ALL)",
            f" cell_scores AS (SELECT *, {_F05} AS f0_5 FROM (SELECT c.*, s1_id, n_true, "
            "coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM gt_sizes JOIN cells c ON true "
            "LEFT JOIN cell_counts USING (singleton_cap, threshold, margin, s1_id)))",
            f" grid AS (SELECT singleton_cap, threshold, margin, singleton_cap_i, threshold_i, margin_i,"
            f"{_QUALITY}, round(avg(f0_5), 12) AS exact_f FROM cell_scores GROUP BY ALL)",
            f" lines AS ({SUBMISSION})",
            " rows AS (SELECT *, CASE WHEN regexp_full_match(rest, '\\s*') THEN [] ELSE string_split(rest, ',') END AS ids "
            "FROM (SELECT line_no, substr(value, 1, instr(value, chr(9)) - 1) AS s1_id, "
            "substr(value, instr(value, chr(9)) + 1) AS rest FROM lines WHERE instr(value, chr(9)) > 0 AND line_no > 1))",
            " listed AS (SELECT DISTINCT unnest(ids) AS id FROM rows)",
            " offending AS ("
            "SELECT 'malformed_row' AS rule, CAST(line_no AS STRING) || ': ' || rtrim(value) AS offender FROM lines "
            "WHERE line_no > 1 AND instr(value, chr(9)) = 0 AND NOT regexp_full_match(value, '\\s*') "
            "UNION ALL SELECT 'duplicate_row', s1_id FROM rows GROUP BY s1_id HAVING count(*) > 1 "
            "UNION ALL SELECT DISTINCT 'repeated_id', s1_id FROM rows WHERE len(ids) <> len(list_distinct(ids)) "
            "UNION ALL SELECT 'self_match', id FROM listed WHERE id LIKE 'S1-%' "
            "UNION ALL SELECT 'wrong_prefix', id FROM listed WHERE NOT regexp_matches(id, '^S[123]-') "
            "UNION ALL SELECT 'unknown_id', id FROM listed WHERE regexp_matches(id, '^S[23]-') "
            "AND id NOT IN (SELECT entity_id FROM s2 UNION SELECT entity_id FROM s3) "
            "UNION ALL SELECT 'missing_row', entity_id FROM s1 WHERE entity_id NOT IN (SELECT s1_id FROM rows) "
            "UNION ALL SELECT DISTINCT 'unexpected_row', s1_id FROM rows WHERE s1_id NOT IN (SELECT entity_id FROM s1))",
            " outside AS (SELECT DISTINCT 'outside_candidates' AS rule, s1_id AS offender FROM ("
            "SELECT s1_id, unnest(ids) AS other_id FROM (SELECT s1_id, arg_max(ids, line_no) AS ids FROM rows GROUP BY s1_id)) "
            "WHERE (s1_id, other_id) NOT IN (SELECT s1_id, other_id FROM gt_pairs))",
        ]
    )
    + "\n"
)


def _findings(table: str, severity: str) -> str:
    return (
        f"SELECT 'matching_results' AS file, rule, '{severity}' AS severity, count(*) AS n, "
        f"array_to_string(list_slice(list_sort(list(offender)), 1, 5), ' | ') AS examples "
        f"FROM {table} GROUP BY rule"
    )


# Findings about whole files: one deliberately broken file per rule.
_FILE_FINDINGS = [
    ("s1", "ids_not_checked", "warning"),
    ("comma", "comma_separated", "error"),
    ("renamed", "wrong_header", "error"),
    ("blank", "empty_file", "error"),
    ("absent", "file_not_found", "error"),
    ("latin", "not_utf8", "error"),
]


def _id_lists(pairs: str, column: str) -> str:
    return (
        f"SELECT entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT other_id, ',' "
        f"ORDER BY other_id), '') AS {column} FROM s1 LEFT JOIN ({pairs}) ON entity_id = s1_id "
        f"GROUP BY entity_id"
    )


_TOP_PAIRS = _both("SELECT s1_id, other_id FROM {t}_top")


def oracles() -> dict[str, str]:
    """DuckDB SQL by query name. Queries that train a model or hash grams for
    the default text encoder have no SQL counterpart."""
    norm = (
        "SELECT entity_id, name_raw, address_raw, country, name_norm, name_core, address_norm, "
        "house_number, postal_code FROM {s}_norm"
    )
    selects = {f"normalize_{s}": norm.replace("{s}", s) for s in ("s1", "s2", "s3")}
    selects |= {
        "normalize_counts": " UNION ALL ".join(
            f"SELECT '{s}' AS table_name, count(*) AS n_rows FROM {s}_norm" for s in ("s1", "s2", "s3")
        ),
        "block_union_count": _tagged("SELECT count(*) AS n_pairs FROM {t}_union"),
        "gram_explode": " UNION ALL ".join(f"SELECT * FROM {s}_grams" for s in ("s1", "s2", "s3")),
        "entity_total": "SELECT n_entities FROM total",
        "gram_df": "SELECT gram, df FROM gram_df",
        "rare_grams": "SELECT gram FROM rare",
        "token_overlap": _tagged("SELECT * FROM {t}_overlap"),
        "topk_candidates": _tagged("SELECT * FROM {t}_top"),
        "topk_count": _tagged("SELECT count(*) AS n_rows FROM {t}_top"),
        "exact_features_s2": "SELECT * FROM s2_exact",
        "exact_features_s3": "SELECT * FROM s3_exact",
        "features_stacked": f"{_features('s2')} UNION ALL {_features('s3')}",
        "embedding_text": " UNION ALL ".join(
            f"SELECT entity_id, country, coalesce(name_norm || ' ' || address_norm, '') AS text "
            f"FROM {s}_norm"
            for s in ("s1", "s2", "s3")
        ),
        "entity_topk": _tagged(
            "SELECT s1_id, other_id, round(cosine_sim, 6) AS cosine_sim FROM {t}_near"
        ),
        "merge_cosine": _tagged(
            "SELECT s1_id, other_id, round(coalesce(cosine_sim, 0.0), 6) AS cosine_sim "
            "FROM (SELECT s1_id, other_id FROM {t}_top) LEFT JOIN {t}_near USING (s1_id, other_id)"
        ),
        "sample_rows": " UNION ALL ".join(
            f"(SELECT '{s}' AS table_name, entity_id, business_name, business_address, country "
            f"FROM {s} ORDER BY entity_id LIMIT 100)"
            for s in ("s1", "s2", "s3")
        ),
        "ground_truth_pairs": "SELECT s1_id, other_id FROM gt_pairs",
        "ground_truth_sets": (
            "SELECT s1_id, coalesce(string_agg(other_id, ',' ORDER BY other_id), '') AS matched, "
            "n_true FROM gt_sizes LEFT JOIN gt_pairs USING (s1_id) GROUP BY s1_id, n_true"
        ),
        "pair_labels": (
            f"SELECT s1_id, other_id, CASE WHEN g.s1_id IS NULL THEN 0 ELSE 1 END AS label "
            f"FROM ({_TOP_PAIRS}) LEFT JOIN gt_pairs g USING (s1_id, other_id)"
        ),
        # Groups from the largest on, each to the fold with the fewest rows so far.
        "fold_assign_check": f"""
            SELECT CAST(fold AS INTEGER) AS fold, n_entities, n_pairs, CAST(1 AS BIGINT) AS max_folds
            FROM (
              WITH RECURSIVE sized AS MATERIALIZED (
                SELECT count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, s1_id) AS i
                FROM ({_TOP_PAIRS}) GROUP BY s1_id),
              dealt AS (
                SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS held,
                  CAST(0 AS BIGINT) AS fold, CAST(0 AS BIGINT) AS size
                UNION ALL
                SELECT g.i,
                  list_transform(d.held, lambda x, j: x + CASE
                    WHEN j = list_position(d.held, list_min(d.held)) THEN g.size ELSE 0 END),
                  list_position(d.held, list_min(d.held)) - 1, g.size
                FROM dealt d JOIN sized g ON g.i = d.i + 1)
              SELECT fold, count(*) AS n_entities, CAST(sum(size) AS BIGINT) AS n_pairs
              FROM dealt WHERE i > 0 GROUP BY fold)""",
        "decision_apply": "SELECT s1_id, other_id FROM decided",
        "entity_f05": "SELECT s1_id, n_true, n_pred, tp, round(f0_5, 6) AS f0_5 FROM entity_scores",
        "macro_f05": f"SELECT {_QUALITY} FROM entity_scores",
        "decision_grid": "SELECT * EXCLUDE (singleton_cap_i, threshold_i, margin_i, exact_f) FROM grid",
        "decision_best": (
            "SELECT * EXCLUDE (singleton_cap_i, threshold_i, margin_i, exact_f) FROM grid "
            "ORDER BY exact_f DESC, singleton_cap_i, threshold_i, margin_i LIMIT 1"
        ),
        "matching_results": _id_lists("SELECT * FROM decided", "matched_entity_ids"),
        "candidate_pairs": _id_lists(_TOP_PAIRS, "candidate_entity_ids"),
        "validate_matching": _findings("offending", "error"),
        "validate_subset": _findings("outside", "warning"),
        "validate_statistics": (
            "SELECT count(*) AS n_rows, count(*) FILTER (WHERE len(ids) = 0) AS n_empty, "
            "count(*) FILTER (WHERE len(ids) > 0) AS n_nonempty FROM rows"
        ),
        "validate_files": (
            _findings("offending", "error")
            + " UNION ALL "
            + _findings("outside", "warning")
            + "".join(
                f" UNION ALL SELECT '{file}', '{rule}', '{severity}', CAST(1 AS BIGINT), ''"
                for file, rule, severity in _FILE_FINDINGS
            )
        ),
        "block_sizes": _tagged(_block_sizes()),
        "read_entity_files": " UNION ALL ".join(f"SELECT * FROM {s}" for s in ("s1", "s2", "s3")),
        "read_truth_file": (
            "SELECT source1_entity_id, nullif(matched_entity_ids, '') AS matched_entity_ids FROM gt"
        ),
        "read_id_list_file": (
            f"SELECT source1_entity_id AS s1_id, ids FROM ({_id_lists(_TOP_PAIRS, 'ids')})"
        ),
        "read_id_column": " UNION ALL ".join(
            f"SELECT DISTINCT entity_id FROM {s}" for s in ("s1", "s2", "s3")
        ),
        "read_similarity_file": _tagged(
            "SELECT s1_id, other_id, round(CAST(CAST(cosine_sim AS FLOAT) AS DOUBLE), 6) AS cosine_sim "
            "FROM {t}_near"
        ),
        "resumable_features": " UNION ALL ".join(
            f"SELECT '{t}' AS target, s1_id, other_id, {', '.join(_FLAGS)}, {', '.join(_FUZZY)} "
            f"FROM {t}_exact "
            + " ".join(f"JOIN {_fuzzy_table(t, f)} f_{f} USING (s1_id, other_id)" for f in _FUZZY)
            for t in ("s2", "s3")
        ),
    }
    channels = ["name", "address", "postal", "postal_nonempty", "house_name", "union", "rare_gram", "all"]
    selects |= {
        f"block_{c}": _tagged(f"SELECT s1_id, other_id FROM {{t}}_{c}") for c in channels
    }
    for query, score in {
        "fuzzy_name_ratio": "name_lev",
        "fuzzy_name_token_sort": "name_token_sort",
        "fuzzy_addr_ratio": "addr_lev",
        "fuzzy_addr_token_sort": "addr_token_sort",
    }.items():
        selects[query] = " UNION ALL ".join(
            f"SELECT '{t}' AS target, * FROM {_fuzzy_table(t, score)}" for t in ("s2", "s3")
        )
    sql = {name: _COMMON + select for name, select in selects.items()}
    return sql | {
        "normalize_documents": f"""
            SELECT doc_id, name_norm, trim(regexp_replace(name_norm,
              '\\b(inc|incorporated|ltd|limited|llc|corp|corporation|pvt|private|co)\\b', '', 'g')) AS name_core
            FROM (SELECT doc_id, {_clean("replace(lower(text), '&', ' and ')")} AS name_norm FROM documents)""",
        "extract_pages": f"""
            SELECT page_id, regexp_extract(html, '^\\s*([0-9]+)', 1) AS house_number,
              regexp_extract(html, '([0-9]{{5,6}})', 1) AS postal_code,
              {_clean("lower(url)")} AS address_norm
            FROM pages""",
        "embedding_topk": """
            WITH v AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u
              FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))
            SELECT s1_id, other_id, round(sim, 6) AS cosine_sim
            FROM (SELECT a.vec_id AS s1_id, o.vec_id AS other_id, round(list_inner_product(a.u, o.u), 12) AS sim
              FROM v a JOIN v o ON a.label = o.label)
            QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY sim DESC, other_id) <= 15""",
    }


def _block_sizes() -> str:
    keys = {
        "name": "CASE WHEN name_norm <> '' THEN name_norm END",
        "address": "CASE WHEN address_norm <> '' THEN address_norm END",
        "postal": "postal_code",
        "house_name": "house_number || ' ' || split_part(name_norm, ' ', 1)",
    }

    def sizes(table: str, count: str) -> str:
        return " UNION ALL ".join(
            f"SELECT '{c}' AS channel, {k} AS block_key, count(*) AS {count} FROM {table} "
            f"WHERE {k} IS NOT NULL GROUP BY 2"
            for c, k in keys.items()
        )

    return (
        f"SELECT channel, block_key, n_s1, n_other, n_s1 * n_other AS n_pairs "
        f"FROM ({sizes('s1_norm', 'n_s1')}) JOIN ({sizes('{t}_norm', 'n_other')}) "
        f"USING (channel, block_key)"
    )
