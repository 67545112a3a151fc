"""DuckDB SQL with the results of the registered queries that SQL can state."""

URL_FILTERS = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hosts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM parts),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS nth
  FROM hosts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT h.page_id, h.host, h.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM hosts h LEFT JOIN best b ON b.page_id = h.page_id AND b.nth = 1
"""

CHAT_FORMATTING = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ') + length(role) + 1 + length(text) + length('</turn>') + 1
    + length(regexp_replace(role || text, '[^\\#<]', '', 'g'))
    + length(regexp_replace(role, '[^\n]', '', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

SOURCE_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
rooms AS (
  SELECT *, (3 * source_size)::DOUBLE / weight AS room, sum(source_size) OVER () AS total FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY room, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE
    AS level
  FROM rooms),
shared AS (SELECT arg_min(level, room) AS level FROM levels WHERE room >= level),
targets AS (
  SELECT source, source_size,
    CASE WHEN room < shared.level THEN (3 * source_size)::DOUBLE ELSE weight * shared.level END AS target
  FROM levels, shared),
placed AS (
  SELECT doc_id, source, size,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('7:' || coalesce(doc_id::VARCHAR, 'null')), doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle
  FROM sized)
SELECT doc_id, size, source_size, target,
  (size * ((middle < target)::INT + (middle + source_size < target)::INT + (middle + 2 * source_size < target)::INT))::BIGINT AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""

EXACT_DEDUP = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY norm)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE m / (x.n + y.n - m)::DOUBLE >= 0.8),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, min(other) AS class_id, min(other) = doc_id AS kept FROM reach GROUP BY doc_id
"""

EXACT_TOPK = r"""
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_CENTROIDS, _ROUNDS = 40, 5


def _bisector_clusters() -> str:
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        """kept AS (
  SELECT row_number() OVER () AS nth, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 524288)) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c, q FROM kept
  ORDER BY sha256('2:' || vec_id), q LIMIT %d)""" % _CENTROIDS
    ]
    for i in range(_ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT nth, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.nth, c.c, {distance} AS d FROM kept v, c{i} c) GROUP BY nth)""")
        if i < _ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.q, o.q) AS q
  FROM c{i} o LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS q
    FROM (SELECT a.c, u.pos, sum(u.x) AS s, count(*) AS n
      FROM a{i} a JOIN (SELECT nth, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM kept) u USING (nth)
      GROUP BY a.c, u.pos)
    GROUP BY c) n USING (c))""")
    last = _ROUNDS
    return f"""WITH {", ".join(steps)}
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM kept k JOIN a{last} a USING (nth) JOIN c{last} c ON c.c = a.c"""


SHARED_PASSAGES = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM split WHERE len(words) >= 50),
windows AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos
  FROM windows JOIN firsts USING (h) WHERE doc_id > first_id),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

# Every rebuilt conversation's prefixes are named by the digest of the one before
# and the turn; what lies under a node is counted over all of its members.
PREFIX_TRIE = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
table_of AS (
  SELECT n AS byte, list_reduce(list_concat([n], range(8)), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry
  FROM (SELECT unnest(range(256)) AS n)),
ids AS (SELECT DISTINCT conv_id FROM turns),
crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS said, CAST(4294967295 AS BIGINT) AS c, 1 AS pos FROM ids
  UNION ALL
  SELECT conv_id, said, xor(c >> 8, entry), crc.pos + 1
  FROM crc JOIN table_of ON byte = xor(c, CAST(ascii(said[crc.pos]) AS BIGINT)) & 255
  WHERE crc.pos <= length(said)),
shared AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(c, 4294967295) % 4 AS h
  FROM crc WHERE pos > length(said)),
rebuilt AS (
  SELECT s.conv_id, t.role, t.text, t.pos AS place FROM shared s JOIN turns t ON t.conv_id = s.base AND t.pos < s.h
  UNION ALL
  SELECT s.conv_id, t.role, t.text, t.pos FROM shared s JOIN turns t ON t.conv_id = s.conv_id AND t.pos >= s.h),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM rebuilt),
lengths AS (SELECT i.conv_id, coalesce(max(depth), 0) AS n FROM ids i LEFT JOIN numbered USING (conv_id) GROUP BY 1),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS node, CAST(NULL AS VARCHAR) AS parent, '' AS text FROM ids
  UNION ALL
  SELECT p.conv_id, n.depth, sha256(p.node || length(n.role) || ':' || n.role || n.text), p.node, n.text
  FROM paths p JOIN numbered n ON n.conv_id = p.conv_id AND n.depth = p.depth + 1),
nodes AS MATERIALIZED (
  SELECT depth, node, any_value(parent) AS parent, min(p.conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS saved,
    sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM paths p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY depth, node),
family AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
under AS (
  SELECT a.depth, a.node, sum(n.saved) AS saved_tokens, count(*) FILTER (f.node IS NULL) AS n_leaves
  FROM nodes n JOIN paths own ON own.conv_id = n.conv_id AND own.depth = n.depth
  JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth
  LEFT JOIN family f ON f.node = n.node AND f.depth = n.depth
  GROUP BY 1, 2)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs,
  coalesce(f.n_children, 0) AS n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN under u ON u.node = n.node AND u.depth = n.depth
LEFT JOIN nodes up ON up.node = n.parent AND up.depth = n.depth - 1
LEFT JOIN family f ON f.node = n.node AND f.depth = n.depth
"""


ORACLES = {
    "op1_url_filters": URL_FILTERS,
    "op5_chat_formatting": CHAT_FORMATTING,
    "op6_source_mixing": SOURCE_MIXING,
    "op7_exact_dedup": EXACT_DEDUP,
    "op9_minhash_near_dedup": NEAR_DEDUP,
    "op10_exact_topk": EXACT_TOPK,
    "op11_bisector_clusters": _bisector_clusters(),
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_shared_passages": SHARED_PASSAGES,
}
