"""The same results in DuckDB's SQL for queries that SQL can express; pairwise, so meant for small tables."""

from __future__ import annotations

from siftspark.plans.queries import _SQL_URLS, _USABLE

_SPACE = r"[\s\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]"
_WORDS = r"regexp_extract_all(lower({}), '[\pL\pN]+')"
_SIGNS = r"|‖¦\-‐‑‒–—―−·•∙‣»«›‹:/\\><~"

# notes and their distinct sequences of three words; cls is one per set of them
_GRAMS = f"""t AS (SELECT DISTINCT id, {_WORDS.format("coalesce(title, '') || chr(10) || coalesce(body, '')")} AS w FROM items WHERE kind = 'note' AND id IS NOT NULL),
l AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gs FROM t WHERE len(w) >= 3),
c AS (SELECT gs, min(id) || '/' || len(gs) || '/' || md5(array_to_string(gs, '|')) AS cls, len(gs) AS n FROM l GROUP BY gs), m AS (SELECT DISTINCT id, cls FROM l JOIN c USING (gs)),
g AS (SELECT cls, n, unnest(gs) AS g FROM c),
b AS (SELECT x.cls AS a, y.cls AS b FROM g x JOIN g y ON x.g = y.g AND x.cls < y.cls GROUP BY x.cls, y.cls, x.n, y.n HAVING count(*) >= 0.6 * (x.n + y.n - count(*)))"""
_USABLE_VECTORS = f"SELECT 'vec_' || space || '__' || regexp_replace(model, '[^0-9a-zA-Z_]', '_', 'g') AS vt, id, embedding AS e FROM vectors WHERE embedding IS NOT NULL AND {_USABLE}"
_FIRST = """h AS (SELECT query_id, source, image_id, coalesce(max(score) FILTER (WHERE NOT isnan(score)), '-infinity'::DOUBLE) AS s FROM search_hits WHERE query_id IS NOT NULL AND source IS NOT NULL AND image_id IS NOT NULL GROUP BY 1, 2, 3),
l AS (SELECT DISTINCT query_id, source FROM h), n AS (SELECT query_id, count(*) AS lists FROM l GROUP BY 1), i AS (SELECT DISTINCT query_id, image_id FROM h),
f AS (SELECT i.query_id, i.image_id, l.source, coalesce(h.s, '-infinity'::DOUBLE) AS s FROM i JOIN l USING (query_id) LEFT JOIN h USING (query_id, image_id, source)),
d AS (SELECT a.query_id, a.image_id, b.image_id AS other, count(*) FILTER (WHERE a.s > b.s) AS wins FROM f a JOIN f b ON a.query_id = b.query_id AND a.source = b.source AND a.image_id <> b.image_id GROUP BY 1, 2, 3),
first AS (SELECT i.query_id, i.image_id FROM i JOIN n USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.query_id = i.query_id AND d.image_id = i.image_id AND 2 * d.wins <= n.lists))"""


def _groups(nodes: str, edges: str) -> str:
    """Recursive tables reach (node, reached) and root (node, root) over nodes (node) and edges (a, b)."""
    return f"""both_ AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})),
reach AS (SELECT node, node AS reached FROM ({nodes}) UNION SELECT node, b FROM reach JOIN both_ ON reached = a), root AS (SELECT node, min(reached) AS root FROM reach GROUP BY node)"""



_RECORDS = f"""{_SQL_URLS}, k AS (SELECT b.bookmark_id, b.url, b.title, url_key, array_to_string(list_sort([regexp_replace(lower(nfc_normalize(p)), '[^\\pL\\pN]+', '', 'g') for p in regexp_split_to_array(coalesce(b.title, ''), '{_SPACE}[{_SIGNS}]+{_SPACE}')]), '') AS t FROM keyed JOIN bookmarks b USING (bookmark_id)),
m AS (SELECT *, min(bookmark_id) OVER (PARTITION BY url_key, t) AS keep_id, count(*) OVER (PARTITION BY url_key, t) AS copies FROM k)"""

ORACLE = {
    "p1_found": f"""WITH {_GRAMS}, every_ AS (SELECT a, b FROM b UNION SELECT b, a FROM b UNION SELECT cls, cls FROM c)
SELECT DISTINCT x.id AS id_a, y.id AS id_b FROM every_ JOIN m x ON x.cls = a JOIN m y ON y.cls = b WHERE x.id < y.id""",
    "p1_groups": f"""WITH RECURSIVE {_GRAMS}, {_groups("SELECT DISTINCT cls AS node FROM c", "SELECT a, b FROM b UNION SELECT x.cls, y.cls FROM m x JOIN m y ON x.id = y.id AND x.cls < y.cls")},
links AS (SELECT a AS cls, count(*) AS links FROM (SELECT a, b FROM b UNION SELECT b, a FROM b) GROUP BY a), named AS (SELECT root, min(id) AS group_id FROM m JOIN root ON node = cls GROUP BY root)
SELECT id, min(group_id) AS group_id, max(coalesce(links, 0)) AS links FROM m JOIN root ON node = cls JOIN named USING (root) LEFT JOIN links USING (cls) GROUP BY id
UNION ALL SELECT DISTINCT id, id, 0 FROM items WHERE kind = 'note' AND id IS NOT NULL AND id NOT IN (SELECT id FROM m)""",
    "p2_found": f"""WITH v AS ({_USABLE_VECTORS})
SELECT DISTINCT x.vt AS vec_table, x.id AS id_a, y.id AS id_b FROM v x JOIN v y ON x.vt = y.vt AND x.id < y.id WHERE list_cosine_similarity(x.e::DOUBLE[], y.e::DOUBLE[]) >= 0.9""",
    "p2_groups": f"""WITH RECURSIVE v AS ({_USABLE_VECTORS}), k AS (SELECT vt, e, vt || '/' || min(id) || '/' || row_number() OVER (ORDER BY vt, e) AS cls FROM v GROUP BY vt, e), m AS (SELECT DISTINCT vt, id, cls FROM v JOIN k USING (vt, e)),
p AS (SELECT x.cls AS a, y.cls AS b FROM k x JOIN k y ON x.vt = y.vt AND x.cls < y.cls WHERE list_cosine_similarity(x.e::DOUBLE[], y.e::DOUBLE[]) >= 0.9),
{_groups("SELECT cls AS node FROM k", "SELECT a, b FROM p UNION SELECT x.cls, y.cls FROM m x JOIN m y ON x.vt = y.vt AND x.id = y.id AND x.cls < y.cls")},
links AS (SELECT a AS cls, count(*) AS links FROM (SELECT a, b FROM p UNION SELECT b, a FROM p) GROUP BY a), named AS (SELECT root, min(id) AS group_id FROM m JOIN root ON node = cls GROUP BY root)
SELECT vt AS vec_table, id, min(group_id) AS group_id, sum(coalesce(links, 0)) AS links FROM m JOIN root ON node = cls JOIN named USING (root) LEFT JOIN links USING (cls) GROUP BY vt, id""",
    "p3_found": f"WITH {_FIRST} SELECT query_id, image_id FROM first",
    "p3_ranking": f"""WITH {_FIRST}, valid AS (SELECT * FROM h WHERE s > '-infinity'::DOUBLE), pct AS (SELECT query_id, source, image_id, (count(*) OVER (PARTITION BY query_id, source) - rank() OVER (PARTITION BY query_id, source ORDER BY s DESC) + 1)::DOUBLE / count(*) OVER (PARTITION BY query_id, source) AS p FROM valid),
v AS (SELECT f.query_id, f.image_id, list_sort(list(coalesce(p, 0.0))) AS v FROM f LEFT JOIN pct USING (query_id, source, image_id) GROUP BY 1, 2)
SELECT query_id, image_id, row_number() OVER (PARTITION BY query_id ORDER BY (first.image_id IS NOT NULL) DESC, v DESC, image_id) AS place, round(v[1], 6) AS weakest FROM v LEFT JOIN first USING (query_id, image_id)""",
    "p6_found": f"WITH {_RECORDS} SELECT keep_id, bookmark_id FROM m WHERE keep_id <> bookmark_id",
    "p6_records": f"WITH {_RECORDS} SELECT keep_id, copies, url, title FROM m WHERE keep_id = bookmark_id",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_items WHERE passage IS NOT NULL),
p AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i : i + 9], ' '))) AS g FROM e WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i : i + 9], ' '))) AS g FROM d WHERE len(w) >= 10) JOIN p USING (g)""",
    # pieces of letters, digits and signs stand for tokens, on which all tokenizers agree here
    "p9_found": r"""WITH d AS (SELECT lower(trim(source)) AS s, sum(len(regexp_extract_all(text, '[\pL]+|[\pN]+|[^\s\pL\pN]+'))) AS t FROM documents WHERE trim(source) <> '' GROUP BY 1)
SELECT lower(trim(source)) AS source FROM mix_targets LEFT JOIN d ON s = lower(trim(source)) WHERE coalesce(t, 0) * max_repeats < target_share * (SELECT sum(t) FROM d)""",
}
