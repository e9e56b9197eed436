"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SQL = {
    "op2_preference": """WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'unknown'), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
e AS (SELECT conv_id, max(i) AS n FROM t WHERE role = 'assistant' GROUP BY conv_id), l AS (SELECT t.conv_id, n, text AS reply FROM t JOIN e ON t.conv_id = e.conv_id AND i = n),
p AS (SELECT a.conv_id, a.n, a.reply AS chosen, b.reply AS rejected FROM l a JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
r AS (SELECT t.conv_id, i, '<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS line FROM t),
s AS (SELECT p.*, CASE WHEN chosen = rejected THEN n ELSE n - 1 END AS k, unnest(['chosen', 'rejected']) AS side FROM p),
q AS (SELECT conv_id, side, k, chosen = rejected AS tie, CASE side WHEN 'chosen' THEN chosen ELSE rejected END AS reply FROM s)
SELECT q.conv_id AS pair_id, side, CAST(k AS INTEGER) AS n_common, coalesce((SELECT string_agg(line, '' ORDER BY i) FROM r WHERE r.conv_id = q.conv_id AND i <= k), '') AS prompt,
CASE WHEN tie THEN '' ELSE '<|im_start|>assistant' || chr(10) || replace(reply, '<|im_', '<| im_') || '<|im_end|>' || chr(10) END AS completion,
CASE WHEN tie THEN '' ELSE '22-' || (32 + length(replace(reply, '<|im_', '<| im_'))) END AS mask, tie FROM q""",
    "op5_decontaminate": f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item_id, w, least(len(w), 8) AS m FROM b WHERE len(w) > 0), iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s + 1:s + m], ' ') AS win FROM (SELECT *, unnest(range(len(w) - m + 1)) AS s FROM i)),
dw AS (SELECT doc_id, m, s, array_to_string(w[s + 1:s + m], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(greatest(len(w) - m + 1, 0))) AS s FROM d, (SELECT DISTINCT m FROM i))),
h AS (SELECT doc_id, s, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM h)) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op7_minhash_dedup": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT DISTINCT doc_id, array_to_string(w[s + 1:s + least(len(w), 4)], ' ') AS g FROM (SELECT *, unnest(range(greatest(len(w) - 3, 1))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 80 * (u.n + v.n - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc, seen) AS (SELECT a, a FROM e UNION SELECT e.a, r.seen FROM e JOIN r ON e.b = r.doc), c AS (SELECT doc, min(seen) AS component FROM r GROUP BY doc)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc = d.doc_id""",
    "op8_line_dedup": """WITH l AS (SELECT doc_id, line, CAST(i AS BIGINT) AS i FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
f AS (SELECT doc_id, i, trim(line, ' ') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM l WHERE trim(line, ' ') <> ''),
r AS (SELECT a.doc_id, a.s, a.i AS i1, b.i AS i2, row_number() OVER (PARTITION BY a.t, b.t ORDER BY a.doc_id, a.s) AS n FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.s = a.s + 1),
g AS (SELECT doc_id, i1 AS i FROM r WHERE n > 1 UNION SELECT doc_id, i2 FROM r WHERE n > 1),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = l.doc_id AND g.i = l.i) GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id), x AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(x.n, 0) AS n_deleted, sha256(coalesce(k.text, '')) AS text_sha256 FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op10_substring_dedup": f"""WITH {_WORDS}, s AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 35], ' ') AS win FROM (SELECT *, unnest(range(greatest(len(w) - 34, 0))) AS s FROM words)),
h AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY win) AS n FROM s) WHERE n > 1), g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM h),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM words),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.p = x.p WHERE g.p IS NULL GROUP BY x.doc_id), c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM words LEFT JOIN k ON k.doc_id = words.doc_id LEFT JOIN c ON c.doc_id = words.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
