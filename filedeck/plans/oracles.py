"""DuckDB SQL for the queries of `catalog`, over the same tables."""

from filedeck.functions.text import METRICS, PARTICLES, TAGS
from filedeck.plans.catalog import WEIGHTS

BLANK = r"[\s\x{00A0}\x{3000}\x{2000}-\x{200A}\x{202F}\x{205F}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def label(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVX0-9]*[.)]?{BLANK}*', ''), '{BLANK}+', '', 'g')"


KIND = "lower(trim(chunk_type))"
ENDS = "|".join(sorted(PARTICLES, key=len, reverse=True))
TERMS = rf"list_transform(regexp_extract_all(coalesce({{}}, ''), '[0-9A-Za-z가-힣]+'), lambda t: regexp_replace(t, '^(.{{{{2,}}}}?)(?:{ENDS})$', '\1'))"

FIL = "fil AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY rcept_no ORDER BY loaded_at DESC NULLS LAST, rcept_dt DESC NULLS LAST, corp_code, report_nm) = 1)"
COMP = f"comp AS (SELECT corp_code, {strip('corp_name')} AS corp_name, coalesce({strip('stock_code')}, '') AS stock_code, modify_date FROM companies)"
BEST = "best AS (SELECT * FROM comp WHERE corp_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY corp_name ORDER BY (stock_code <> '') DESC, modify_date DESC NULLS LAST, corp_code) = 1)"
ANN = r"ann AS (SELECT * FROM fil WHERE regexp_matches(report_nm, '^(\[기재정정\]|\[첨부정정\]|\[첨부추가\])?사업보고서\s*\('))"
CH = f"""{FIL}, {COMP}, ch AS (SELECT c.*, comp.corp_name, fil.report_nm FROM chunks c
    JOIN (SELECT min(id) AS id FROM chunks GROUP BY rcept_no, section_path, chunk_index) USING (id) JOIN fil USING (rcept_no) JOIN comp USING (corp_code))"""
PATH = "array_to_string(section_path, ' > ')"
RERANK = f"'[' || corp_name || ']' || CASE WHEN len(section_path) > 0 THEN ' ' || {PATH} ELSE '' END || chr(10) || text"
LEXICAL = f"'[' || corp_name || '] ' || coalesce({PATH}, '') || chr(10) || "
GOLD = "gold AS (SELECT golden_id AS query_id, * FROM golden QUALIFY row_number() OVER (PARTITION BY question ORDER BY golden_id) = 1)"

VEC = """v AS (SELECT id, rcept_no, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    dense_all AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.e, v.e), 6) AS score, q.rcept_no = v.rcept_no AS same FROM v q JOIN v ON q.id % 100 = 0)"""
DENSE = f"{VEC}, dense AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense_all QUALIFY rank <= 100)"
POST = "post AS (SELECT id, rcept_no, unnest(map_keys(sparse)) AS token, unnest(map_values(sparse)) AS weight FROM chunks WHERE sparse IS NOT NULL)"
SPARSE = f"""{POST}, sparse_all AS (SELECT q.id AS query_id, p.id, round(sum(q.weight * p.weight), 6) AS score, q.rcept_no = p.rcept_no AS same
    FROM post q JOIN post p USING (token) WHERE q.id % 100 = 0 GROUP BY ALL),
    sparse AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sparse_all QUALIFY rank <= 100)"""
SCALED = """scaled AS (SELECT query_id, id, list, (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END AS s
    FROM (SELECT *, 0 AS list FROM {a} UNION ALL SELECT *, 1 AS list FROM {b}) WINDOW w AS (PARTITION BY query_id, list))"""
TWO = f"{DENSE}, {SPARSE}"
FUSED = SCALED.format(a="dense", b="sparse") + ", fused AS (SELECT query_id, id, round(sum(CASE list WHEN 0 THEN 0.7 ELSE 0.3 END * s), 6) AS score FROM scaled GROUP BY query_id, id)"


def top(source: str, k: int, keys: str = "query_id", columns: str = "query_id, id, score") -> str:
    return f"SELECT {columns}, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, id) AS rank FROM {source} QUALIFY rank <= {k}"


SAME = "WHERE g.corp_name = t.corp_name"


def bm25(texts: str, name: str, where: str = "") -> str:
    """CTEs up to {name}_all: every question against every text; with SAME within the question's company."""
    n = name
    return f"""{n}_t AS ({texts}), {n}_k AS (SELECT id, unnest({TERMS.format("text")}) AS t FROM {n}_t), {n}_l AS (SELECT id, len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z가-힣]+')) AS len FROM {n}_t),
    {n}_s AS (SELECT count(*) AS n, avg(len) AS avg_len FROM {n}_l), {n}_d AS (SELECT t, count(DISTINCT id) AS df FROM {n}_k GROUP BY t),
    {n}_r AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM {n}_d, {n}_s),
    {n}_i AS (SELECT t, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {n}_r) ELSE raw END AS idf FROM {n}_r),
    {n}_f AS (SELECT id, t, count(*) AS tf FROM {n}_k GROUP BY ALL),
    {n}_q AS (SELECT query_id, t, count(*) AS times FROM (SELECT query_id, unnest({TERMS.format("question")}) AS t FROM gold) GROUP BY ALL),
    {n}_w AS (SELECT query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS s FROM {n}_q JOIN {n}_f USING (t) JOIN {n}_i USING (t) JOIN {n}_l USING (id), {n}_s GROUP BY ALL),
    {n}_all AS (SELECT g.query_id, t.id, round(coalesce(s, 0), 6) AS score FROM gold g CROSS JOIN {n}_t t LEFT JOIN {n}_w w ON w.query_id = g.query_id AND w.id = t.id {where}),
    {n} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {n}_all QUALIFY rank <= 100)"""


PLAIN, CRUMBS = "SELECT id, corp_name, text FROM ch", f"SELECT id, corp_name, {LEXICAL} coalesce(text, '') AS text FROM ch"
CELLS = rf"list_transform(string_split(line, '|'), lambda c: {strip('c')})"
def rows(source: str) -> str:
    return f"""lines AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM {source}),
    rws AS (SELECT id, no, {CELLS} AS c FROM lines WHERE contains(line, '|'))"""


def values(source: str) -> str:
    parts = []
    for m, negative in METRICS.items():
        ok = r"^\(?-?[\d,]{4,}\)?$" if negative else r"^-?[\d,]{4,}\)?$"
        parts.append(rf"SELECT id, no, '{m}' AS metric, list_filter(c[2:], lambda x: regexp_matches(x, '{ok}'))[1] AS value FROM rws WHERE regexp_matches({label('c[1]')}, '^{m}(\(|$)')")
    return rows(source) + ", hit AS (" + " UNION ALL ".join(parts) + "), vals AS (SELECT id, metric, arg_min(value, no) FILTER (value IS NOT NULL) AS value FROM hit GROUP BY id, metric HAVING count(value) > 0)"


BASIS = f"""CASE WHEN contains(regexp_replace(array_to_string(section_path, ''), '{BLANK}+', '', 'g'), '연결') THEN '연결'
    WHEN regexp_matches(regexp_replace(array_to_string(section_path, ''), '{BLANK}+', '', 'g'), '재무제표|재무상태표|손익계산서') THEN '별도' END"""
CONTEXT = f"""'[' || rank || '] (' || corp_name || coalesce(' [' || basis || '기준]', '') || CASE WHEN len(section_path) > 0 THEN ' / ' || {PATH} ELSE '' END || ')' || chr(10) || coalesce(text, '')"""
TURNS = r"turns AS (SELECT item_id // 8 AS conversation, item_id AS turn, question, regexp_extract(search_query, '^(\S+?)(?:의|이|가) ', 1) AS corp FROM baseline_items)"
ANSWERS = f"{GOLD}, ans AS (SELECT b.item_id, b.answer, g.metric, g.expected_value, g.expected_chunk_id FROM baseline_items b JOIN gold g USING (question))"


def quantiles(source: str, keys: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    q = []
    for name, k in (("median", 50), ("p90", 90), ("p95", 95), ("p99", 99)):
        j = f"greatest(1, least({k} * (n + 1) // 100, n - 1))"
        q.append(f"CAST(CASE WHEN n = 1 THEN a[1] ELSE trunc((a[{j}] * (100 - ({k} * (n + 1) - 100 * {j})) + a[least({j} + 1, n)] * ({k} * (n + 1) - 100 * {j})) / 100.0) END AS BIGINT) AS {name}")
    head = f"{keys}, " if keys else ""
    return f"SELECT {head}n, a[1] AS min, {', '.join(q)}, a[n] AS max FROM (SELECT {head}count(*) AS n, list_sort(list(x)) AS a FROM {source} WHERE x IS NOT NULL {group})"


QUALITY = " UNION ALL ".join(f"SELECT '{c}' AS condition, query_id, id, rank FROM {c}_top" for c in ("bm25", "bm25_breadcrumb", "rrf", "weighted"))

ORACLES = {
    "current_filings": f"WITH {FIL} SELECT * FROM fil",
    "find_companies": f"WITH {COMP} SELECT corp_code, corp_name, stock_code FROM comp WHERE regexp_matches(corp_name, '물산|화학') AND stock_code <> ''",
    "find_companies_literal": f"WITH {COMP} SELECT corp_code, corp_name, stock_code FROM comp WHERE contains(corp_name, '전자')",
    "resolved_companies": f"WITH {COMP}, {BEST} SELECT corp_name, position, corp_code, stock_code, modify_date FROM (SELECT corp_name, min(golden_id) AS position FROM golden GROUP BY 1) JOIN best USING (corp_name)",
    "unmatched_companies": f"WITH {COMP} SELECT DISTINCT corp_name FROM companies c WHERE NOT EXISTS (SELECT 1 FROM comp WHERE comp.corp_name = c.corp_name)",
    "modified_dates": "SELECT corp_code, CAST(CAST(try_strptime(modify_date, '%Y%m%d') AS DATE) AS VARCHAR) AS modified_on FROM companies",
    "annual_reports": f"WITH {FIL}, {ANN} SELECT rcept_no, corp_code, report_nm, rcept_dt FROM ann",
    "latest_annual_report": f"WITH {FIL}, {ANN} SELECT corp_code, rcept_no, report_nm, rcept_dt FROM ann QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY rcept_dt DESC NULLS LAST, rcept_no DESC) = 1",
    "last_values": f"""WITH {FIL}, f AS (SELECT * FROM fil WHERE rcept_dt IS NOT NULL),
        w AS (SELECT corp_code, last_value(report_nm IGNORE NULLS) OVER p AS report_nm, last_value(rcept_dt IGNORE NULLS) OVER p AS rcept_dt, last_value(loaded_at IGNORE NULLS) OVER p AS loaded_at, row_number() OVER (PARTITION BY corp_code ORDER BY rcept_dt, rcept_no) AS n
              FROM f WINDOW p AS (PARTITION BY corp_code ORDER BY rcept_dt, rcept_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT corp_code, report_nm, rcept_dt, loaded_at FROM w WHERE n = 1""",
    "companies_without_annual": f"WITH {FIL}, {ANN} SELECT DISTINCT corp_code FROM companies WHERE corp_code NOT IN (SELECT corp_code FROM ann WHERE corp_code IS NOT NULL)",
    "filings_without_chunks": "SELECT DISTINCT rcept_no FROM filings WHERE rcept_no NOT IN (SELECT rcept_no FROM chunks WHERE rcept_no IS NOT NULL)",
    "chunks_by_company": f"WITH {CH} SELECT corp_name, count(*) AS n_chunks, count(DISTINCT rcept_no) AS n_filings, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM ch GROUP BY 1",
    "loaded_once": "SELECT id, rcept_no, chunk_index FROM chunks WHERE id IN (SELECT min(id) FROM chunks GROUP BY rcept_no, section_path, chunk_index)",
    "new_chunks": """WITH h AS (SELECT (min(id) + max(id)) // 2 AS half FROM chunks) SELECT id, rcept_no, chunk_index FROM chunks a, h WHERE id > half
        AND NOT EXISTS (SELECT 1 FROM chunks b WHERE b.id <= h.half AND a.rcept_no = b.rcept_no AND a.section_path = b.section_path AND a.chunk_index = b.chunk_index)""",
    "first_filings": f"WITH {FIL} SELECT rcept_no, corp_code, report_nm FROM fil ORDER BY rcept_no LIMIT 20",
    "companies_with_chunks": f"WITH {CH} SELECT DISTINCT corp_name FROM ch",
    "dense_search": f"WITH {DENSE} SELECT query_id, dense.id, score, rank, rcept_no, section_path, chunk_type, text FROM dense JOIN chunks USING (id) WHERE rank <= 5",
    "dense_topk_mixed_filters": f"WITH {VEC} " + top("(SELECT * FROM dense_all WHERE same OR query_id % 3 < 2)", 10),
    "sparse_topk_mixed_filters": f"WITH {SPARSE} " + top("(SELECT * FROM sparse_all WHERE same OR query_id % 3 < 2)", 10),
    "bm25_topk_mixed_filters": f"WITH {CH}, {GOLD}, {bm25(PLAIN, 'bm', 'WHERE g.corp_name = t.corp_name OR g.query_id % 3 < 2')} SELECT query_id, id, score, rank FROM bm WHERE rank <= 5",
    "nested_blocks": f"""WITH c AS (SELECT id, rcept_no, string_split(text, chr(10)) AS l FROM chunks WHERE text IS NOT NULL),
        b AS (SELECT id, 0 AS o, ['Ⅰ.' || rcept_no] AS section_path, 'paragraph' AS type, {strip("l[1]")} AS text FROM c
              UNION ALL SELECT id, 1, ['Ⅰ.' || rcept_no, '표'], 'table', '내용 [' || array_to_string(list_filter(list_transform(l, lambda x: {strip("x")}), lambda x: x <> ''), '; ') || '] | 끝' FROM c
              UNION ALL SELECT id, 2, [], 'paragraph', CAST(len(l) AS VARCHAR) FROM c)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS ordinal, section_path, type, text FROM b WHERE text <> ''""",
    "expected_chunks": "SELECT id, rcept_no, chunk_type FROM chunks WHERE id IN (SELECT expected_chunk_id FROM golden)",
    "first_companies_golden": "SELECT golden_id, corp_name, metric FROM golden WHERE metric IN ('매출액', '영업이익') AND corp_name IN (SELECT DISTINCT corp_name FROM golden ORDER BY corp_name LIMIT 10)",
    "embedding_inputs": f"WITH {CH} SELECT id, substring({RERANK}, 1, 4000) AS input FROM ch",
    "lexical_inputs": f"WITH {CH} SELECT id, md5({LEXICAL} text) AS input_md5, length({RERANK}) AS rerank_chars FROM ch",
    "chunk_terms": f"SELECT id, array_to_string({TERMS.format('text')}, ' ') AS terms FROM chunks",
    "corpus_statistics": f"""WITH k AS (SELECT id, {TERMS.format("text")} AS t FROM chunks), u AS (SELECT id, unnest(list_distinct(t)) AS t FROM k)
        SELECT (SELECT count(*) FROM k) AS n_docs, (SELECT round(avg(len(t)), 6) FROM k) AS avg_len, count(DISTINCT t) AS n_terms, count(*) AS n_postings FROM u""",
    "frequent_terms": f"SELECT t AS token, count(*) AS df FROM (SELECT unnest(list_distinct({TERMS.format('text')})) AS t FROM chunks) GROUP BY 1 ORDER BY df DESC, token LIMIT 50",
    "row_labels": f"WITH {rows('chunks')} SELECT {label('c[1]')} AS label, count(*) AS n FROM rws GROUP BY 1",
    "metric_values": f"WITH {values('chunks')} SELECT id, metric, value FROM vals",
    "statement_bases": f"SELECT coalesce({BASIS}, '-') AS basis, count(*) AS n_chunks, count(DISTINCT rcept_no) AS n_filings FROM chunks GROUP BY 1",
    "sanitized_documents": rf"""WITH a AS (SELECT doc_id, text, regexp_replace(replace(text, '&', '&amp;'), '&amp;(amp;|lt;|gt;|quot;|apos;|#\d+;|#x[0-9a-fA-F]+;)', '&\1', 'g') AS t FROM documents),
        b AS (SELECT doc_id, text, replace(replace(regexp_replace(t, '<([/!?]|(?i:{"|".join(sorted(TAGS, key=len, reverse=True))})(?:[^A-Za-z0-9_-]|$))', chr(1) || '\1', 'g'), '<', '&lt;'), chr(1), '<') AS clean FROM a)
        SELECT doc_id, length(clean) AS n_chars, md5(clean) AS clean_md5 FROM b WHERE clean <> text""",
    "highlighted_answers": r"SELECT item_id, regexp_replace(replace(replace(replace(answer, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\d,]{4,})', '<b>\1</b>', 'g') AS html, substring(answer, 1, 20) AS preview FROM baseline_items",
    "error_bodies": f"""WITH {FIL} SELECT rcept_no, CASE WHEN length(report_nm) % 2 = 0 THEN '014' ELSE 'unknown' END AS status,
        CASE WHEN length(report_nm) % 2 = 0 THEN report_nm ELSE substring('<html>' || report_nm, 1, 200) END AS message FROM fil""",
    "parsed_blocks": f"""WITH c AS (SELECT id, section_path, {KIND} AS type, coalesce(text, '') AS t FROM chunks WHERE {KIND} IN ('table', 'paragraph')),
        p AS (SELECT id, section_path, type, CASE type WHEN 'paragraph' THEN {strip("t")} ELSE array_to_string(list_transform(
            list_filter(list_transform(string_split(t, chr(10)), lambda l: list_transform(string_split(l, ' | '), lambda x: {strip("x")})), lambda r: len(list_filter(r, lambda x: x <> '')) > 0),
            lambda r: array_to_string(r, ' | ')), chr(10)) END AS text FROM c)
        SELECT id, 0 AS ordinal, list_filter(list_transform(coalesce(section_path, []), lambda x: {strip("x")}), lambda x: x <> '') AS section_path, type, text FROM p WHERE text <> ''""",
    "dense_topk": f"WITH {DENSE} SELECT query_id, id, score, rank FROM dense WHERE rank <= 10",
    "dense_topk_filtered": f"WITH {VEC} " + top("(SELECT * FROM dense_all WHERE same)", 10),
    "sparse_topk": f"WITH {SPARSE} SELECT query_id, id, score, rank FROM sparse WHERE rank <= 10",
    "sparse_topk_filtered": f"WITH {SPARSE} " + top("(SELECT * FROM sparse_all WHERE same)", 10),
    "sparse_postings": f"WITH {POST} SELECT token, count(*) AS n, round(sum(weight), 4) AS weight FROM post GROUP BY 1",
    "bm25_topk": f"WITH {CH}, {GOLD}, {bm25(PLAIN, 'bm')} SELECT query_id, id, score, rank FROM bm WHERE rank <= 5",
    "bm25_topk_filtered": f"WITH {CH}, {GOLD}, {bm25(PLAIN, 'bm', SAME)} SELECT query_id, id, score, rank FROM bm WHERE rank <= 5",
    "bm25_topk_breadcrumb": f"WITH {CH}, {GOLD}, {bm25(CRUMBS, 'bm')} SELECT query_id, id, score, rank FROM bm WHERE rank <= 5",
    "rrf_fusion": f"WITH {TWO} " + top("(SELECT query_id, id, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT * FROM dense UNION ALL SELECT * FROM sparse) GROUP BY 1, 2)", 10),
    "weighted_fusion": f"WITH {TWO}, {FUSED} " + top("fused", 10),
    "weight_sweep": f"WITH {TWO}, {SCALED.format(a='dense', b='sparse')}, s AS (SELECT w AS weight, query_id, id, round(sum(CASE list WHEN 0 THEN w ELSE 1 - w END * s), 6) AS score FROM scaled, (SELECT unnest([{', '.join(f'CAST({w} AS DOUBLE)' for w in WEIGHTS)}]) AS w) GROUP BY ALL) "
    + top("s", 5, "weight, query_id", "weight, query_id, id, score"),
    "dense_sparse_overlap": f"""WITH {TWO}, a AS (SELECT query_id, id FROM dense WHERE rank <= 10), b AS (SELECT query_id, id FROM sparse WHERE rank <= 10),
        c AS (SELECT query_id, count(*) AS n FROM a JOIN b USING (query_id, id) GROUP BY 1) SELECT query_id, coalesce(n, 0) AS n_common FROM (SELECT query_id FROM a UNION SELECT query_id FROM b) LEFT JOIN c USING (query_id)""",
    "hybrid_search": f"WITH {TWO}, {FUSED}, h AS ({top('fused', 5)}) SELECT query_id, h.id, score, rank, rcept_no, section_path, chunk_type, text FROM h JOIN chunks USING (id)",
    "reranked_search": f"""WITH {TWO}, {FUSED}, h AS ({top("fused", 20)}),
        r AS (SELECT query_id, h.id, score, round(len(list_distinct(list_intersect(list_distinct({TERMS.format("q.text")}), {TERMS.format("c.text")}))) / greatest(len(list_distinct({TERMS.format("q.text")})), 1), 6) AS rerank_score
              FROM h JOIN chunks c ON c.id = h.id JOIN chunks q ON q.id = h.query_id)
        SELECT query_id, id, score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, id) AS rank FROM r QUALIFY rank <= 5""",
    "whole_filing_search": f"""WITH {VEC}, {SPARSE}, dense AS (SELECT query_id, id, score FROM dense_all WHERE same),
        zero AS (SELECT d.query_id, d.id, coalesce(s.score, 0) AS score FROM dense d LEFT JOIN sparse_all s ON s.query_id = d.query_id AND s.id = d.id AND s.same),
        {SCALED.format(a="dense", b="zero")}, fused AS (SELECT query_id, id, round(sum(CASE list WHEN 0 THEN 0.7 ELSE 0.3 END * s), 6) AS score FROM scaled GROUP BY query_id, id) """
    + top("fused", 10),
    "extracted_answers": f"""WITH {CH}, {GOLD}, {bm25(PLAIN, "bm", SAME)}, h AS (SELECT bm.query_id * 10 + rank AS id, bm.query_id, ch.text FROM bm JOIN ch USING (id) WHERE rank <= 3), {values("h")},
        a AS (SELECT query_id, arg_min(value, vals.id) AS value FROM vals JOIN gold g ON g.query_id = vals.id // 10 AND g.metric = vals.metric GROUP BY query_id)
        SELECT g.query_id, coalesce(value, '자료에서 찾을 수 없습니다') AS answer, coalesce(contains(coalesce(value, '자료에서 찾을 수 없습니다'), g.expected_value), false) AS correct
        FROM gold g JOIN (SELECT DISTINCT query_id FROM h) USING (query_id) LEFT JOIN a USING (query_id)""",
    "contexts": f"""WITH {CH}, {GOLD}, {bm25(PLAIN, "bm", SAME)}, h AS (SELECT bm.query_id, rank, ch.*, {BASIS} AS basis FROM bm JOIN ch USING (id) WHERE rank <= 3)
        SELECT query_id, string_agg({CONTEXT}, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY 1""",
    "carried_companies": f"WITH {TURNS} SELECT conversation, turn, coalesce(corp, last_value(nullif(corp, '') IGNORE NULLS) OVER (PARTITION BY conversation ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS corp FROM turns",
    "carried_questions": f"WITH {TURNS} SELECT conversation, turn, array_to_string(list(question) OVER (PARTITION BY conversation ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' ') AS query FROM turns",
    "valid_requests": rf"SELECT item_id, coalesce(length(answer) BETWEEN 1 AND 500 AND regexp_matches(answer, '[^\s\x{{00A0}}\x{{3000}}]') AND item_id % 25 BETWEEN 1 AND 20, false) AS valid FROM baseline_items",
    "grounded_answers": rf"""WITH {ANSWERS}, n AS (SELECT item_id, regexp_extract_all(coalesce(answer, ''), '[\d,]{{4,}}') AS found, coalesce(text, '') AS t FROM ans JOIN chunks ON id = expected_chunk_id)
        SELECT item_id, len(found) = 0 OR len(list_filter(found, lambda x: contains(t, x))) > 0 AS grounded FROM n""",
    "answer_accuracy": f"WITH {ANSWERS} SELECT coalesce(metric, 'all') AS metric, count(*) AS n, round(avg(CASE WHEN coalesce(contains(answer, expected_value), false) THEN 1 ELSE 0 END), 6) AS accuracy FROM ans GROUP BY ROLLUP (metric) HAVING count(*) > 0",
    "retrieval_quality": f"""WITH {CH}, {GOLD}, {bm25(PLAIN, "p")}, {bm25(CRUMBS, "b")},
        bm25_top AS (SELECT * FROM p WHERE rank <= 10), bm25_breadcrumb_top AS (SELECT * FROM b WHERE rank <= 10),
        rrf_top AS ({top("(SELECT query_id, id, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT * FROM p UNION ALL SELECT * FROM b) GROUP BY 1, 2)", 10)}),
        {SCALED.format(a="p", b="b")}, weighted_top AS ({top("(SELECT query_id, id, round(sum(CASE list WHEN 0 THEN 0.7 ELSE 0.3 END * s), 6) AS score FROM scaled GROUP BY query_id, id)", 10)}),
        hits AS ({QUALITY}),
        j AS (SELECT c.condition, g.query_id, g.metric, min(h.rank) FILTER (h.id = g.expected_chunk_id) AS i, min(h.rank) FILTER (contains(x.text, g.expected_value)) AS v
              FROM gold g CROSS JOIN (SELECT DISTINCT condition FROM hits) c LEFT JOIN hits h ON h.query_id = g.query_id AND h.condition = c.condition LEFT JOIN chunks x ON x.id = h.id GROUP BY ALL),
        m AS (SELECT condition, unnest([metric, 'all']) AS metric, i, v FROM j)
        SELECT condition, metric, count(*) AS n, round(avg(CASE WHEN i <= 5 THEN 1 ELSE 0 END), 6) AS recall_at_5, round(avg(CASE WHEN i <= 10 THEN 1 ELSE 0 END), 6) AS recall_at_10, round(avg(coalesce(1 / i, 0)), 6) AS rr,
               round(avg(CASE WHEN v <= 5 THEN 1 ELSE 0 END), 6) AS value_recall_at_5, round(avg(CASE WHEN v <= 10 THEN 1 ELSE 0 END), 6) AS value_recall_at_10, round(avg(coalesce(1 / v, 0)), 6) AS value_rr FROM m GROUP BY 1, 2""",
    "golden_items": f"""WITH {CH}, t AS (SELECT * FROM ch WHERE {KIND} = 'table' AND contains(text, '매출액') AND contains(text, '영업이익') AND corp_name IS NOT NULL), {values("t")},
        f AS (SELECT t.corp_name, min(t.id) AS id FROM t JOIN vals a ON a.id = t.id AND a.metric = '매출액' JOIN vals b ON b.id = t.id AND b.metric = '영업이익' GROUP BY 1)
        SELECT f.corp_name, metric, f.corp_name || '의 ' || metric || '은 얼마인가요?' AS question, id AS expected_chunk_id, value AS expected_value FROM f JOIN vals USING (id)""",
    "golden_sample": "SELECT golden_id, corp_name, metric FROM golden ORDER BY md5('42:' || golden_id), golden_id LIMIT 30",
    "section_counts": "SELECT coalesce(section_path[1], '(없음)') AS section, count(*) AS n FROM chunks GROUP BY 1 ORDER BY n DESC, section LIMIT 20",
    "type_counts": f"SELECT coalesce({KIND}, '(없음)') AS chunk_type, count(*) AS n FROM chunks GROUP BY 1",
    "filing_totals": f"SELECT rcept_no, count(*) AS n_chunks, count(*) FILTER ({KIND} = 'table') AS n_tables, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT section_path) AS n_sections FROM chunks GROUP BY 1",
    "length_percentiles": quantiles(f"(SELECT coalesce({KIND}, '(없음)') AS chunk_type, length(text) AS x FROM chunks)", "chunk_type"),
    "chunks_per_filing_percentiles": quantiles("(SELECT count(*) AS x FROM chunks GROUP BY rcept_no)", ""),
    "current_versions": "SELECT rcept_no, loaded_at, corp_code FROM filings QUALIFY row_number() OVER (PARTITION BY rcept_no ORDER BY loaded_at DESC NULLS LAST, corp_code DESC) = 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
