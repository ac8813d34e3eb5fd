"""DuckDB SQL with the rows of those queries that SQL can express."""

from tillworks.llm.chat import HISTORY, STRIDE, TURN_TOKENS
from tillworks.llm.decontamination import WINDOW
from tillworks.llm.prefix_trie import LONGEST_HEAD, SPAN
from tillworks.llm.suffix_dedup import LENGTH
from tillworks.llm.url_filter import FAN, LEVELS, RARE, REJECT, RULES, SIGNIFICANT, WEIGHT

SUFFIX_ARRAY_DEDUP = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), {2 * LENGTH})) AS m
  FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM d)
), c AS (
  SELECT m FROM w GROUP BY m HAVING count(*) > 1
), s AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS n
  FROM w SEMI JOIN c USING (m)
), g AS (
  SELECT r, i, sum(n) OVER (PARTITION BY r ORDER BY i) AS k FROM s
), spans AS (
  SELECT r, k, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY r, k
), pieces AS (
  SELECT d.r, k, substr(h, CAST(2 * lag(b, 1, 0) OVER (PARTITION BY d.r ORDER BY k) + 1 AS BIGINT),
    CAST(2 * (a - lag(b, 1, 0) OVER (PARTITION BY d.r ORDER BY k)) AS BIGINT)) AS p, a, b
  FROM d JOIN spans ON d.r = spans.r
), kept AS (
  SELECT r, string_agg(p, '' ORDER BY k) AS p, sum(b - a) AS gone, count(*) AS n, max(b) AS e
  FROM pieces GROUP BY r
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(p || substr(h, CAST(2 * e + 1 AS BIGINT)), h))) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""

BALL_TREE_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_ESCAPED = "replace(replace({0}, '&', '&amp;'), '<', '&lt;')"
_LEN = f"length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 17"

CHAT_WINDOWS = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), n AS (
  SELECT *, {TURN_TOKENS} + (length(text) + 3) // 4 AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM t
), s AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY p) - tokens AS start,
    p = 1 AND role = 'system' AS system, {_LEN} AS chars FROM n
), w AS (
  SELECT *, start // {STRIDE} AS wnd FROM s
), o AS (
  SELECT conv_id, wnd, min(start) AS opens FROM w GROUP BY conv_id, wnd
), again AS (
  SELECT w.conv_id, chars FROM w JOIN o ON w.conv_id IS NOT DISTINCT FROM o.conv_id
  WHERE (system AND o.wnd <> w.wnd)
    OR (NOT system AND o.wnd = w.wnd + 1 AND opens - start <= {HISTORY})
), f AS (
  SELECT conv_id, sum(chars) AS chars FROM (
    SELECT conv_id, chars FROM w UNION ALL SELECT conv_id, chars FROM again) GROUP BY conv_id
), d AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY p) AS turns,
    coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM w GROUP BY conv_id
)
SELECT d.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(f.chars AS BIGINT) AS formatted_chars
FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""


def _fits(host, path):
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def _url_verdicts():
    longest = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in longest)
    kind = " ".join(f"WHEN {_fits(h, p)} THEN '{k}'" for k, h, p in longest)
    parts = [f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), a AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), b AS (
  SELECT *, CASE {rule} END AS rule, CASE {kind} END AS ruled,
    regexp_replace(regexp_replace(path, '\\b[0-9a-f]{{16,}}\\b|[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}',
      '*', 'g'), '[0-9]+', '*', 'g') AS shape FROM a
), k AS (
  SELECT host, shape, count(*) AS n, count(*) FILTER (WHERE ruled = 'block') AS blocked,
    count(ruled) AS known, string_split(shape, '/') AS segs FROM b GROUP BY host, shape
), t0 AS (
  SELECT host, shape, n, blocked, known, CASE WHEN len(segs) <= {LEVELS + 1} THEN segs ELSE
    list_append(segs[1:{LEVELS}], array_to_string(segs[{LEVELS + 1}:], '/')) END AS segs,
    '' AS template FROM k
)"""]
    for level in range(1, LEVELS + 1):
        parts.append(f"""
c{level} AS (
  SELECT host, template, segs[{level + 1}] AS part, sum(n) AS n FROM t{level - 1}
  WHERE len(segs) > {level} GROUP BY ALL
), r{level} AS (
  SELECT host, template, part FROM (
    SELECT *, sum(n) OVER (PARTITION BY host, template) AS total,
      count(*) OVER (PARTITION BY host, template) AS fan FROM c{level})
  WHERE fan >= {FAN} AND n < {RARE} * total
), t{level} AS (
  SELECT t.host, shape, n, blocked, known, segs, CASE WHEN len(segs) <= {level} THEN t.template
    WHEN r.part IS NOT NULL THEN t.template || '/*' ELSE t.template || '/' || segs[{level + 1}]
    END AS template
  FROM t{level - 1} t LEFT JOIN r{level} r ON t.host = r.host AND t.template = r.template
    AND segs[{level + 1}] = r.part
)""")
    parts.append(f"""
own AS (
  SELECT host, template, CAST(sum(blocked) AS DOUBLE) AS blocked, CAST(sum(known) AS DOUBLE) AS known,
    regexp_replace(template, '/[^/]*$', '') AS parent FROM t{LEVELS} GROUP BY host, template
), sib AS (
  SELECT host, parent, sum(blocked) / nullif(sum(known), 0) AS share FROM own GROUP BY host, parent
), br AS (
  SELECT own.*, CASE WHEN known > 0 AND (blocked / nullif(known, 0) - share)
      * (blocked / nullif(known, 0) - share) * known <= {SIGNIFICANT} * share * (1 - share) + 1e-12
    THEN NULL ELSE template END AS branch
  FROM own JOIN sib ON own.host = sib.host AND own.parent = sib.parent
), m AS (
  SELECT *, sum(blocked) OVER g AS mb, sum(known) OVER g AS mk FROM br
  WINDOW g AS (PARTITION BY host, parent, branch)
), every AS (
  SELECT template, CAST(sum(blocked) AS DOUBLE) AS eb, CAST(sum(known) AS DOUBLE) AS ek
  FROM t{LEVELS} GROUP BY template
), overall AS (
  SELECT (coalesce(sum(blocked), 0) + 1) / CAST(coalesce(sum(known), 0) + 2 AS DOUBLE) AS p FROM t{LEVELS}
), v AS (
  SELECT m.host, m.template, CASE WHEN (mb + {WEIGHT} * ((eb + {WEIGHT} * p) / (ek + {WEIGHT})))
    / (mk + {WEIGHT}) >= {REJECT} THEN 'block' ELSE 'allow' END AS verdict
  FROM m JOIN every ON m.template = every.template, overall
)
SELECT page_id, b.host, path, rule, coalesce(ruled, v.verdict) AS verdict, t.template
FROM b JOIN t{LEVELS} t ON b.host = t.host AND b.shape = t.shape
  JOIN v ON t.host = v.host AND t.template = v.template
""")
    return ", ".join(parts[:-1]) + ", " + parts[-1]


_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(
  string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
    lambda u, i: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384) ELSE u // 2 END)), 4294967295)"""

CONVERSATION_TRIE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS own
  FROM t GROUP BY conv_id
), h AS (
  SELECT *, {_CRC32} % {LONGEST_HEAD} AS h FROM o
), c AS (
  SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS s
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % {SPAN}
), p AS (
  SELECT conv_id, len(s) AS n, d, s[1:d] AS k
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM c)
), v AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ends,
    CASE WHEN d = 0 THEN 0 ELSE length(k[d].t) END AS chars
  FROM p GROUP BY d, k
), f AS (
  SELECT v.k, count(*) AS n_children FROM v JOIN v w ON w.d = v.d + 1 AND w.k[1:w.d - 1] = v.k
  GROUP BY v.k
), g AS (
  SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN f ON v.k = f.k
), u AS (
  SELECT k[1:a] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
    sum((n_convs - 1) * chars) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM g) GROUP BY ALL
)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, g.n_convs,
  g.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN u ON g.k = u.k LEFT JOIN g q ON q.d = g.d - 1 AND q.k = g.k[1:g.d - 1]
"""

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

_TERMS = _WORDS.replace("3A-", "3A-\\x40\\x5B-", 1)

K2_TREAP_SEARCH = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents
), s AS (
  SELECT CAST(count(*) FILTER (WHERE len(t) > 0) AS BIGINT) AS n,
    CAST(sum(len(t)) AS BIGINT) AS l FROM d
), p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), q AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), m AS (
  SELECT r, doc_id, 10 + (90 * len(t) * n) // l AS m FROM d, s WHERE len(t) > 0
), c AS (
  SELECT item_id, any_value(doc_id) AS doc_id, p.r,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w ON q.term = w.term JOIN p ON q.term = p.term JOIN m ON p.r = m.r
  GROUP BY item_id, p.r
), o AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank
  FROM c WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""

BENCHMARK_WINNOWING = f"""
WITH i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark
), x AS (
  SELECT item, w, least(len(w), {WINDOW}) AS n FROM i WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM x)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), o AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM x))
), m AS (
  SELECT r, o.n, s, item FROM o JOIN g ON o.n = g.n AND o.gram = g.gram
), h AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, n, s FROM m)) GROUP BY r
), l AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM m) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN l ON d.r = l.r
"""

ORACLES = {
    "op1_suffix_array_dedup": SUFFIX_ARRAY_DEDUP,
    "op6_url_verdicts": _url_verdicts(),
    "op7_ball_tree_top_k": BALL_TREE_TOP_K,
    "op10_chat_windows": CHAT_WINDOWS,
    "op11_k2_treap_search": K2_TREAP_SEARCH,
    "op12_conversation_trie": CONVERSATION_TRIE,
    "op13_benchmark_winnowing": BENCHMARK_WINNOWING,
}
