"""DuckDB SQL for the contract queries that SQL can express at fixture size."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS e FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: The policy's rules, written out: too few or repeated words, symbols, repeated lines, capitals, marked words, word lengths.
OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w FROM d),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w WHERE len(w) > 0),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))) AS x FROM w WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) t WHERE c > 1),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest(range(0, 8)) AS k) o GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) t WHERE regexp_matches(line, '{WORD}')),
ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS k FROM lines GROUP BY doc_id),
uw AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars, count(*) FILTER (WHERE regexp_matches(word, '[!?#*$%&|<>=~^_{{}}\\[\\]\\\\]')) AS marked FROM u GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(uw.n, 0) AS n, coalesce(uw.chars, 0) AS chars, coalesce(uw.marked, 0) AS marked, coalesce(hit.n, 0) AS rep, coalesce(ln.n, 0) AS ln, coalesce(ln.n - ln.k, 0) AS dup,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS sym, len(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ]')) AS up, len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]')) AS let
  FROM d LEFT JOIN uw ON uw.doc_id = d.doc_id LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN ln ON ln.doc_id = d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(sym AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words,
 n < 20 OR 100 * rep > 30 * n AS base_failed,
 NOT (n < 20 OR 100 * rep > 30 * n OR chars < 2 * n OR chars > 20 * n OR 10 * sym > n OR 100 * dup > 30 * ln OR 10 * up > 5 * let OR 10 * marked > 3 * n) AS kept,
 CAST(CASE WHEN n < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * rep > 30 * n THEN 2 ELSE 0 END + CASE WHEN chars < 2 * n THEN 4 ELSE 0 END + CASE WHEN chars > 20 * n THEN 8 ELSE 0 END + CASE WHEN 10 * sym > n THEN 16 ELSE 0 END
  + CASE WHEN 100 * dup > 30 * ln THEN 32 ELSE 0 END + CASE WHEN 10 * up > 5 * let THEN 64 ELSE 0 END + CASE WHEN 10 * marked > 3 * n THEN 128 ELSE 0 END AS BIGINT) AS failed, 2 AS policy FROM m"""


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '\\', '\\b'), '[', '\\o'), '<', '\\l')"


OP10 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
  sum(length({escaped("role")}) + length(role) - length(replace(role, ']', '')) + length({escaped("text")}) + 6) + 3 AS chars FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""

#: CRC-32 of a decimal number, bit by bit.
CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
 lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"""

OP12 = f"""
WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, n, xor({CRC}, 4294967295) % 4 AS h, c - c % 20 AS b FROM (SELECT c, count(*) AS n FROM own GROUP BY c) t),
made AS (SELECT cs.c, o.p, o.role, o.text FROM cs JOIN own o ON o.c = cs.b AND o.p <= cs.h UNION ALL SELECT cs.c, o.p - cs.h + least(cs.h, coalesce(base.n, 0)), o.role, o.text FROM cs JOIN own o ON o.c = cs.c AND o.p > cs.h LEFT JOIN cs base ON base.c = cs.b),
pre AS (SELECT c, p AS d, len(regexp_extract_all(text, '{WORD}')) AS w, list(sha256(concat(length(role), ':', role, text))) OVER (PARTITION BY c ORDER BY p) AS x FROM made),
every AS (SELECT c, d, w, sha256(array_to_string(x, ',')) AS k, CASE WHEN d > 1 THEN sha256(array_to_string(x[:-2], ',')) ELSE '' END AS up FROM pre UNION ALL SELECT c, 0, 0, '', NULL FROM cs),
lens AS (SELECT c, max(d) AS d FROM every GROUP BY c),
nodes AS (SELECT d, k, min(c) AS c, count(*) AS n, max(w) AS w, max(up) AS up FROM every GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
sums AS (SELECT e.d, e.k, sum((m.n - 1) * m.w) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves FROM nodes m JOIN every e ON e.c = m.c AND e.d <= m.d LEFT JOIN kids ON kids.d = m.d AND kids.k = m.k GROUP BY 1, 2),
tails AS (SELECT e.d, e.k, sha256(string_agg(CAST(e.c AS VARCHAR), ',' ORDER BY e.c)) AS s FROM every e JOIN lens ON lens.c = e.c AND lens.d = e.d GROUP BY 1, 2)
SELECT m.c AS conv_id, CAST(m.d AS BIGINT) AS depth, up.c AS parent_conv_id, CAST(m.n AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, coalesce(tails.s, sha256('')) AS ends_sha256
FROM nodes m JOIN sums ON sums.d = m.d AND sums.k = m.k LEFT JOIN nodes up ON up.d = m.d - 1 AND up.k = m.up LEFT JOIN kids ON kids.d = m.d AND kids.k = m.k LEFT JOIN tails ON tails.d = m.d AND tails.k = m.k"""

OP13 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same) t WHERE r <= 5),
n AS (SELECT p.a, p.b AS p, s.b AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 10"""

ORACLES = {"op1_minmax_near_duplicates": OP1, "op8_rule_ledger": OP8, "op10_reply_tree_chat": OP10, "op12_peeled_prefix_trie": OP12, "op13_bit_sliced_negatives": OP13}
