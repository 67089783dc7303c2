"""DuckDB SQL for the pN_ queries that SQL can express, over the same tables."""

WORDS = r"regexp_extract_all(lower(regexp_replace(regexp_replace(text, '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g')), '[\p{L}\p{N}]+')"


def _sets(size: int, least: int) -> str:
    parts = " || chr(1) || ".join(["w[i]", *(f"w[i + {k}]" for k in range(1, size))])
    return f"""
    words AS (SELECT id, {WORDS} AS w FROM chunks WHERE text IS NOT NULL),
    made AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: {parts}))) AS s FROM words),
    sized AS (SELECT id, count(*) AS n FROM made GROUP BY id HAVING count(*) >= {least}),
    sets AS (SELECT made.id, s, n FROM made JOIN sized USING (id)),
    met AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, count(*) AS both_n
            FROM sets a JOIN sets b ON a.s = b.s AND a.id < b.id GROUP BY ALL)"""


LINES = r"""
    lines AS (SELECT id, rcept_no, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
              FROM chunks WHERE text IS NOT NULL AND rcept_no IS NOT NULL),
    keyed AS (SELECT id, rcept_no, line_no, regexp_replace(lower(nfc_normalize(line)), '\P{L}+', '', 'g') AS k FROM lines WHERE NOT contains(line, ' | ')),
    totals AS (SELECT rcept_no, count(DISTINCT id) AS n FROM chunks GROUP BY rcept_no),
    often AS (SELECT rcept_no, k FROM keyed JOIN totals USING (rcept_no) WHERE k <> ''
              GROUP BY rcept_no, k, n HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.05 * n),
    places AS (SELECT id, line_no FROM keyed JOIN often USING (rcept_no, k))"""

# NFKC where it changes letters or digits of these texts: Roman numerals and wide digits.
ROMAN = dict(zip("ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ", "I II III IV V VI VII VIII IX X XI XII".split()))


def letters(column: str) -> str:
    """The letters and digits of a text, after NFKC and lower-casing."""
    text = f"translate(nfc_normalize({column}), '０１２３４５６７８９', '0123456789')"
    for one, several in ROMAN.items():
        text = f"replace({text}, '{one}', '{several}')"
    return rf"regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


LEAKS = f"""
    d AS (SELECT doc_id, {letters("text")} AS t FROM documents WHERE text IS NOT NULL),
    e AS (SELECT item_id, {letters("passage")} AS t FROM eval_items WHERE passage IS NOT NULL),
    dg AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 58), lambda i: substring(t, i, 60))) AS g FROM d WHERE length(t) >= 60),
    eg AS (SELECT item_id, unnest(list_transform(range(1, length(t) - 58), lambda i: substring(t, i, 60))) AS g FROM e WHERE length(t) >= 60),
    leaks AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))"""

KIND = r"""CASE WHEN lower(regexp_replace(chunk_type, '^\s+|\s+$', '', 'g')) IN ('table', 'paragraph') THEN lower(regexp_replace(chunk_type, '^\s+|\s+$', '', 'g'))
      WHEN 2 * len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\S') AND contains(l, ' | '))) >= len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\S'))) THEN 'table'
      ELSE 'paragraph' END"""

ORACLES = {
    "p1_found": f"WITH {_sets(2, 50)} SELECT id_a, id_b FROM met WHERE both_n / (n_a + n_b - both_n) >= 0.6",
    "p1_links": f"""WITH {_sets(5, 1)},
    near AS (SELECT *, both_n / (n_a + n_b - both_n) AS j FROM met WHERE both_n / (n_a + n_b - both_n) >= 0.8),
    both_ways AS (SELECT id_a AS id, id_b AS other, j FROM near UNION ALL SELECT id_b, id_a, j FROM near)
    SELECT sized.id, least(sized.id, coalesce(min(other) FILTER (j = 1), sized.id)) AS class_id, count(other) FILTER (j = 1) + 1 AS copies, count(other) AS n_links
    FROM sized LEFT JOIN both_ways USING (id) GROUP BY sized.id""",
    "p2_found": f"WITH {LINES} SELECT id, line_no FROM places",
    "p2_clean": f"""WITH {LINES}, drops AS (SELECT id, list(line_no) AS no FROM places GROUP BY id)
    SELECT id, rcept_no, CASE WHEN no IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda l, i: NOT list_contains(no, i)), chr(10)) END AS text,
           coalesce(len(no), 0) AS n_removed FROM chunks LEFT JOIN drops USING (id)""",
    "p3_found": """WITH v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM chunks
                   WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))), 'sum') > 0),
    s AS (SELECT a.id, b.id AS near, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id),
    r AS (SELECT id, near, c, row_number() OVER (PARTITION BY id ORDER BY c DESC, near) AS k FROM s QUALIFY k <= 10)
    SELECT DISTINCT least(id, near) AS id_a, greatest(id, near) AS id_b FROM r WHERE c >= 0.85""",
    "p4_found": f"SELECT id FROM (SELECT id, text, {KIND} AS kind FROM chunks WHERE text IS NOT NULL) WHERE length(text) > CASE kind WHEN 'table' THEN 1500 ELSE 900 END",
    "p4_rebuilt": f"SELECT id, md5(text) AS text_md5, true AS within, true AS overlap_kept FROM (SELECT id, text, {KIND} AS kind FROM chunks WHERE text IS NOT NULL) WHERE length(text) > CASE kind WHEN 'table' THEN 1500 ELSE 900 END",
    "p7_found": f"WITH {LEAKS} SELECT doc_id, item_id FROM leaks",
    "p7_matches": f"""WITH {LEAKS}, t AS (SELECT doc_id, item_id, d.t AS a, e.t AS b FROM leaks JOIN d USING (doc_id) JOIN e USING (item_id)),
    starts AS (SELECT doc_id, item_id, a, b, unnest(range(1, length(b) - 58)) AS s FROM t),
    runs AS (SELECT doc_id, item_id, a, b, s, list_max(list_filter(range(60, length(b) - s + 2), lambda n: contains(a, substring(b, s, n)))) AS n FROM starts WHERE contains(a, substring(b, s, 60))),
    best AS (SELECT doc_id, item_id, max(n) AS length, arg_min({{'a': a, 's': s, 'b': b, 'n': n}}, (-n, strpos(a, substring(b, s, n)), s)) AS w FROM runs GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, length, strpos(w.a, substring(w.b, w.s, w.n)) - 1 AS doc_at, w.s - 1 AS item_at FROM best""",
    "p7_clean": f"WITH {LEAKS} SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)",
}
