"""SQL of the queries that SQL can express, for the comparison with DuckDB."""

from __future__ import annotations

from nearpress.functions.labels import ICONS
from nearpress.operators.search import scale_tolerance
from nearpress.plans.registry import BENT_TOLERANCE, PIVOTS, QUERY_STEP, TOKEN_TOLERANCE, TOLERANCE

_TOL = scale_tolerance(TOLERANCE)
_TOKEN_TOL = scale_tolerance(TOKEN_TOLERANCE)
_BENT_TOL = scale_tolerance(BENT_TOLERANCE)
_WHITE = r"[\s\x{85}\p{Z}]"


def _stem(url: str) -> str:
    path = rf"regexp_extract({url}, '(?s)^.*?://[^/]*/(.*)$', 1)"
    return rf"CASE WHEN regexp_matches({url}, '(?s)^.*?://[^/]*/.*$') THEN url_decode({path}) END"


def _icon(kind: str) -> str:
    return f"CASE lower(trim({kind})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ICONS.items()) + " END"


def _tokens(text: str) -> str:
    return f"list_distinct(list_filter(string_split({text}, ' '), lambda t: t <> ''))"


def _token_distance(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {both})"
    low, high = f"least(len({a}), len({b}))", f"greatest(len({a}), len({b}))"
    return f"CASE WHEN {high} = 0 OR {union} < {low} THEN 0.0 ELSE ({union} - {low})::DOUBLE / {high} END"


def _bucket(q: str) -> str:
    return f"CASE WHEN {q} <= 2 THEN '0-2' WHEN {q} <= 5 THEN '3-5' WHEN {q} <= 8 THEN '6-8' WHEN {q} IS NOT NULL THEN '9+' END"


_HOVER = "'lg_window: ' || coalesce(lg_window_size::VARCHAR, '-') || ', quality: ' || quality::VARCHAR"
_SCALED = "CAST(round({d} * 10000) AS BIGINT)"
_PARTS = "string_split(regexp_replace(url, '^https?://', ''), '/')"

_PAGES = f"t AS (SELECT page_id AS id, {_tokens('html')} AS t, row_number() OVER (ORDER BY page_id) - 1 AS x FROM pages WHERE html IS NOT NULL)"
_PAIRS = f"""{_PAGES},
pairs AS (SELECT a.id AS i, b.id AS j, b.x, {_token_distance('a.t', 'b.t')} AS d FROM t a, t b WHERE a.id % {QUERY_STEP} = 0)"""
_HITS = f"{_PAIRS}, scaled AS (SELECT i AS q, x, {_SCALED.format(d='d')} AS d_scaled FROM pairs), hits AS (SELECT * FROM scaled WHERE d_scaled <= {_TOKEN_TOL})"
_BRUTE = f"{_HITS}, brute AS (SELECT q, min(x) FILTER (WHERE d_scaled <= {_TOKEN_TOL}) AS first_x, count(*) AS n FROM scaled GROUP BY q)"

_CROSS = f"""first AS (SELECT filepath, lower(trim(page_type)) AS kind, url FROM (
  SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY corpus, pos, entry_id) AS k FROM entries WHERE filepath IS NOT NULL) WHERE k = 1),
c AS (SELECT kind, text_id AS id, {_tokens('body')} AS t, {_stem('url')} AS stem, row_number() OVER (PARTITION BY kind ORDER BY text_id) - 1 AS i
  FROM page_texts JOIN first USING (filepath) WHERE body IS NOT NULL AND kind IN ('wiki', 'grok')),
x AS (SELECT a.id AS wiki_id, b.id AS grok_id, a.i, b.i AS j, {_token_distance('a.t', 'b.t')} AS d, lower(string_split(a.stem, '/')[-1]) = lower(string_split(b.stem, '/')[-1]) AS same
  FROM c a, c b WHERE a.kind = 'wiki' AND b.kind = 'grok' AND a.id % {QUERY_STEP} = 0),
s AS (SELECT i, j, CASE WHEN i = j THEN 'Same Subject' ELSE 'Different Subjects' END AS grp, d FROM x WHERE j >= i)"""

_BENT = "(({d}) * ({d})) * (({d}) * ({d})) * (({d}) * ({d}))"
_BENT_SEARCH = f"""{_PAIRS}, scaled AS (SELECT i AS q, x, {_SCALED.format(d=_BENT.format(d='d'))} AS d_scaled FROM pairs),
brute AS (SELECT q, min(x) FILTER (WHERE d_scaled <= {_BENT_TOL}) AS first_x, count(*) AS n FROM scaled GROUP BY q),
n AS (SELECT count(*) AS n FROM t), piv AS (SELECT t.id, t.t, t.x FROM t, n WHERE t.x IN (SELECT (p * n) // least({PIVOTS}, n) FROM range({PIVOTS}) r(p) WHERE p < n)),
far AS (SELECT p.x AS p, t.id, t.x, {_token_distance('p.t', 't.t')} AS d FROM piv p, t),
tab AS (SELECT p, id, x, {_SCALED.format(d=_BENT.format(d='d'))} AS s FROM far),
cand AS (SELECT a.id AS q, b.x FROM tab a JOIN tab b ON a.p = b.p WHERE a.id % {QUERY_STEP} = 0 GROUP BY 1, 2 HAVING bool_and(abs(a.s - b.s) <= {_BENT_TOL} + 1)),
hits AS (SELECT q, x FROM scaled JOIN cand USING (q, x) WHERE d_scaled <= {_BENT_TOL}),
diverged AS (SELECT b.q, b.first_x AS brute_x, coalesce(bool_or(h.x = b.first_x), false) AS in_pruned, count(h.x) AS n_pruned,
  CASE WHEN b.first_x IS NULL THEN count(h.x) > 0 ELSE NOT coalesce(bool_or(h.x = b.first_x), false) END AS mismatch
  FROM brute b LEFT JOIN hits h ON b.q = h.q GROUP BY b.q, b.first_x)"""

_BIN = "CAST(CASE WHEN {d} < 0 THEN -1 WHEN {d} = 1 THEN 99 WHEN {d} > 1 THEN 100 ELSE floor({d} * 100) END AS INTEGER)"


def _clean(text: str) -> str:
    out = rf"regexp_replace(regexp_replace({text}, '\n', ' ', 'g'), '\[[^\]]*\]', ' ', 'g')"
    out = f"trim(regexp_replace({out}, '{_WHITE}+', ' ', 'g'))"
    for old, new in ((" ,", ","), (" .", "."), (" :", ":"), (" ;", ";"), (" !", "!"), (" ?", "?"), (" )", ")"), ('" ', '"'), ("'' ", "''"), (' "', '"')):
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _triangles(d: str) -> str:
    return f"""WITH {_PAIRS},
        e AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b, {d} AS d FROM pairs WHERE i <> j),
        g AS (SELECT a AS u, b AS v, d FROM e UNION ALL SELECT b, a, d FROM e),
        k AS (SELECT ab.u AS a, ab.v AS b, bc.v AS c, ab.d AS d_ab, ac.d AS d_ac, bc.d AS d_bc FROM g ab JOIN g bc ON ab.v = bc.u JOIN g ac ON ac.u = ab.u AND ac.v = bc.v WHERE ab.u < ab.v AND ab.v < bc.v)
        SELECT * FROM k WHERE d_ab > d_ac + d_bc + 1e-12 OR d_ac > d_ab + d_bc + 1e-12 OR d_bc > d_ab + d_ac + 1e-12"""


def _unquoted(p: str) -> str:
    return rf"""regexp_replace(regexp_replace({p}, '^{_WHITE}+|{_WHITE}+$', '', 'g'), '^"+|"+$', '', 'g')"""


_LINE = """'"' || url || '", "' || coalesce(page_type, '') || '"'"""

_MATRIX = f"""WITH {_PAIRS} SELECT i, j, {_stem('r.url')} AS row_label, {_stem('c.url')} AS col_label, d
        FROM pairs JOIN pages r ON i = r.page_id JOIN pages c ON j = c.page_id"""

ORACLES: dict[str, str] = {
    "url_domain_path": f"""SELECT page_id, {_PARTS}[1] AS domain, CASE WHEN len({_PARTS}) <= 1 THEN '' WHEN {_PARTS}[-1] = '' THEN array_to_string({_PARTS}[2:], '/') || 'index.html'
        ELSE array_to_string({_PARTS}[2:], '/') || '.html' END AS path FROM pages""",
    "url_decoded_name": f"SELECT entry_id, {_stem('url')} AS stem FROM entries",
    "manifest_parse": f"""SELECT corpus, pos, {_unquoted('p[1]')} AS url, {_unquoted('p[2]')} AS page_type
        FROM (SELECT corpus, pos, string_split({_LINE}, ',') AS p FROM manifest WHERE url IS NOT NULL) WHERE len(p) >= 2""",
    "file_resolution": f"""WITH files AS (SELECT filepath FROM pages UNION SELECT filepath FROM page_texts),
        m AS (SELECT corpus, pos, url, {_stem('url')} AS stem FROM manifest),
        s AS (SELECT * FROM (VALUES ('.html/index.html', 0), ('.html', 1), ('.txt/index.html', 2), ('.txt', 3), ('.md/index.html', 4), ('.md', 5), ('.wiki/index.html', 6), ('.wiki', 7), ('/index.html', 8), ('', 9)) v(suffix, rank)),
        c AS (SELECT corpus, pos, url, 'dataset/' || corpus || '/' || stem || suffix AS filepath, rank FROM m, s WHERE NOT regexp_matches(stem, '(^/)|(^|/)\\.\\.(/|$)'))
        SELECT corpus, pos, url, min_by(filepath, rank) AS filepath FROM c JOIN files USING (filepath) GROUP BY corpus, pos, url""",
    "first_entry": """SELECT corpus, url, pos, page_type FROM (SELECT *, row_number() OVER (PARTITION BY corpus, url ORDER BY pos) AS k FROM manifest WHERE url IS NOT NULL) WHERE k = 1""",
    "page_label": f"""WITH l AS (SELECT entry_id, '/' || array_to_string(list_transform(string_split(coalesce(string_split(url, '://')[2], ''), '/')[2:],
        lambda p: CASE WHEN strlen(p) > 10 THEN left(p, 10) || '…' ELSE p END), '/') || ' ' || coalesce({_icon('page_type')}, '') AS label FROM entries WHERE url IS NOT NULL)
        SELECT entry_id, label, string_split(label, '/')[-1] AS short FROM l UNION ALL SELECT entry_id, NULL, NULL FROM entries WHERE url IS NULL""",
    "quality_bucket": f"SELECT {_bucket('quality')} AS bucket, {_HOVER} AS hover, count(*) AS n FROM pivot_distances GROUP BY 1, 2",
    "distance_given_sizes": """SELECT page_id, pivot_id, codec, quality, c_both, CASE WHEN c_both < least(c_page, c_pivot) OR greatest(c_page, c_pivot) = 0 THEN 0.0
        ELSE (c_both - least(c_page, c_pivot))::DOUBLE / greatest(c_page, c_pivot) END AS d FROM pivot_distances""",
    "distance_scale": f"SELECT {_SCALED.format(d='distance')} AS d_scaled, count(*) AS n FROM pivot_distances GROUP BY 1",
    "measured_histogram": f"SELECT codec AS grp, {_BIN.format(d='distance')} AS bin, count(*) AS n FROM pivot_distances WHERE distance IS NOT NULL GROUP BY 1, 2",
    "measured_median": "SELECT codec AS grp, median(distance) AS median, printf('%.3f', median(distance)) AS label FROM pivot_distances WHERE distance IS NOT NULL GROUP BY 1",
    "measured_range": f"""SELECT p.pivot_id, p.url, count(DISTINCT d.page_id) AS n_pages FROM pivots p
        LEFT JOIN pivot_distances d ON p.pivot_id = d.pivot_id AND {_SCALED.format(d='d.distance')} <= {_TOL} GROUP BY 1, 2""",
    "measured_latest": """SELECT page_id, pivot_id, codec, quality, lg_window_size, distance, n FROM (
        SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY page_id, pivot_id, codec, quality, lg_window_size ORDER BY measured_at DESC, arrived_at DESC, c_both DESC) AS k
        FROM pivot_distances WINDOW w AS (PARTITION BY page_id, pivot_id, codec, quality, lg_window_size)) WHERE k = 1""",
    "scatter_data": f"SELECT 'Q ' || {_bucket('quality')} AS series, {_HOVER} AS hover, duration_s, distance FROM pivot_distances",
    "optimal_opts_rank": f"""SELECT quality, lg_window_size, CAST(sum(CASE WHEN distance >= 0.5 THEN 1 ELSE -1 END * {_SCALED.format(d='distance')} * {_SCALED.format(d='distance')}) AS BIGINT) AS score
        FROM pivot_distances WHERE codec = 'brotli' GROUP BY 1, 2 ORDER BY score DESC, quality, lg_window_size LIMIT 1""",
    "clean_text_basic": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "size_tokenset": f"SELECT page_id, len({_tokens('html')}) AS c FROM pages",
    "ncd_tokenset": f"""WITH t AS (SELECT text_id, body, {_tokens('body')} AS t FROM page_texts)
        SELECT a.text_id, CASE WHEN a.body IS NULL OR b.body IS NULL THEN NULL ELSE {_token_distance('a.t', 'b.t')} END AS d FROM t a JOIN t b ON b.text_id = a.text_id + 1""",
    "size_cache_stats": "SELECT count(text) AS lookups, count(DISTINCT text) AS misses, count(text) - count(DISTINCT text) AS hits FROM documents",
    "matrix_tokenset": _MATRIX,
    "matrix_tokens_native": _MATRIX,
    "triangle_violations": _triangles(_BENT.format(d="d")),
    "triangle_holds": _triangles("d"),
    "pivot_matrix": f"""WITH t AS (SELECT pivot_id AS id, {_tokens("replace(url, '/', ' ')")} AS t, '/' || array_to_string(list_transform(string_split(coalesce(string_split(url, '://')[2], ''), '/')[2:],
        lambda p: CASE WHEN strlen(p) > 10 THEN left(p, 10) || '…' ELSE p END), '/') || ' {ICONS["article"]}' AS label FROM pivots)
        SELECT a.id AS i, b.id AS j, a.label AS row_label, b.label AS col_label, {_token_distance('a.t', 'b.t')} AS d FROM t a, t b""",
    "range_first_match": f"WITH {_BRUTE} SELECT q, first_x, coalesce(first_x + 1, n) AS calls FROM brute",
    "range_search": f"WITH {_HITS} SELECT q, x, d_scaled FROM hits",
    "pruned_search": f"WITH {_HITS} SELECT q, x, d_scaled FROM hits",
    "search_divergence": f"WITH {_BENT_SEARCH} SELECT * FROM diverged",
    "search_summary": f"""WITH {_BENT_SEARCH} SELECT (SELECT count(*) FROM brute) AS queries, (SELECT count(*) FROM diverged WHERE mismatch) AS mismatches,
        (SELECT CAST(sum(coalesce(first_x + 1, n)) // greatest(count(*), 1) AS BIGINT) FROM brute) AS avg_brute_calls, (SELECT count(*) FROM cand) // greatest((SELECT count(*) FROM brute), 1) AS avg_tree_calls""",
    "cross_matrix_tokenset": f"WITH {_CROSS} SELECT wiki_id, grok_id, i, j, d FROM x",
    "related_split": f"WITH {_CROSS} SELECT * FROM s",
    "related_by_topic": f"WITH {_CROSS} SELECT wiki_id AS i, grok_id AS j, CASE WHEN same THEN 'Same Subject' ELSE 'Different Subjects' END AS grp, d FROM x",
    "distance_histogram": f"WITH {_CROSS} SELECT grp, {_BIN.format(d='d')} AS bin, count(*) AS n FROM s GROUP BY 1, 2",
    "group_median": f"""WITH {_CROSS}, g AS (SELECT 'Same Subject' AS grp UNION ALL SELECT 'Different Subjects')
        SELECT g.grp, coalesce(median(d), 0.0) AS median, printf('%.3f', coalesce(median(d), 0.0)) AS label FROM g LEFT JOIN s ON g.grp = s.grp GROUP BY g.grp""",
}
