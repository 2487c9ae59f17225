"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

URL_FILTER = rf"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_UPPER}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fit AS (
  SELECT u.r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN fit USING (r)
"""

EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, array_to_string(w[i:i + n - 1], ' ') AS s, n
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item FROM dw JOIN win USING (s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
_RULES = [
    ("assign", 0, _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, '^{_ASSIGN}([A-Za-z0-9+/_.=-]+)$', 1)) >= 12"),
    ("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 18"),
    ("hex", 2, "[0-9a-f]{16,}", "true"),
    ("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
]


def _matches(kind: str, rank: int, pattern: str, keep: str) -> str:
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, stop - length(m) AS start, stop FROM (
    SELECT doc_id, i, m, sum(length(g[i]) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
      SELECT doc_id, unnest(f) AS m, generate_subscripts(f, 1) AS i, g FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS g FROM t)))
  WHERE {keep}"""


SECRET_SCAN = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_matches(*r) for r in _RULES)}),
s AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans
  FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN s USING (doc_id)
"""


def _assigned(k: int) -> str:
    """The nearest entry of codebooks c{k} for every part."""
    return f"""
a{k} AS (SELECT r, part, any_value(q) AS q, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d FROM (
  SELECT r, p.part, q, entry, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q, c)]) AS HUGEINT) AS d FROM p JOIN c{k} USING (part)) GROUP BY r, part)"""


def _refined(k: int) -> str:
    """Codebooks c{k + 1} from what fell to the entries of c{k}."""
    return f"""
m{k} AS (SELECT part, entry, list(v ORDER BY i) AS c FROM (
  SELECT part, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS v FROM (SELECT part, entry, unnest(q) AS x, unnest(range(len(q))) AS i FROM a{k}) GROUP BY part, entry, i) GROUP BY part, entry),
c{k + 1} AS (SELECT part, entry, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry))"""


VECTOR_CODES = f"""
WITH k AS (
  SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
  FROM embeddings WHERE len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
p AS (SELECT r, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS q FROM k, (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, r - 1 AS entry, q AS c FROM p WHERE r <= 64), {_assigned(0)}, {_refined(0)}, {_assigned(1)}, {_refined(1)}, {_assigned(2)},
e AS (SELECT r, string_agg(printf('%02x', CAST(entry AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN e USING (r), s
"""


_CRC32 = """(list_reduce(list_prepend(4294967295, flatten([[unicode(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""


def _leaf(text: str) -> str:
    values = [("doc_id", "CAST(doc_id AS VARCHAR)"), ("source", "source"), ("lang", "lang"), ("n_chars", "CAST(n_chars AS VARCHAR)"), ("text", text)]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for _, v in values) + ")"


MERKLE_MANIFEST = f"""
WITH RECURSIVE
f AS (
  SELECT row_number() OVER () AS r, doc_id, source, leaf, other, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN xor({_CRC32}, 4294967295) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS other FROM documents)),
nodes AS (
  SELECT source, 0 AS lvl, p, leaf AS h, n FROM f
  UNION ALL
  SELECT source, lvl + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, lvl, p // 3),
subs AS (SELECT source, lvl AS tall, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, p, h, n FROM subs
  UNION ALL
  SELECT lvl + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY lvl, p // 3),
path AS (
  SELECT r, a.lvl AS step, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS g
  FROM (SELECT r, f.source, lvl, f.p // CAST(pow(3, lvl) AS BIGINT) AS p FROM f JOIN (SELECT DISTINCT source, lvl FROM nodes WHERE n > 1) t ON f.source IS NOT DISTINCT FROM t.source) a
  JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.p // 3 = b.p // 3 GROUP BY r, a.lvl
  UNION ALL
  SELECT r, tall + lvl, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), ''), coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '')
  FROM (SELECT r, tall, lvl, s.p // CAST(pow(3, lvl) AS BIGINT) AS p FROM f JOIN subs s ON f.source IS NOT DISTINCT FROM s.source, (SELECT DISTINCT lvl FROM tops WHERE n > 1)) a
  JOIN tops b USING (lvl) WHERE a.p // 3 = b.p // 3 GROUP BY r, tall, lvl),
folds AS (
  SELECT r, 0 AS step, other AS h FROM f
  UNION ALL
  SELECT r, step + 1, sha256(l || h || g) FROM folds JOIN path USING (r, step)),
proofs AS (SELECT r, sha256(string_agg(l || g, '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY r),
ends AS (SELECT r, arg_max(h, step) AS folded_root FROM folds GROUP BY r),
top AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM f JOIN subs s ON f.source IS NOT DISTINCT FROM s.source JOIN ends USING (r) LEFT JOIN proofs USING (r), top
"""
