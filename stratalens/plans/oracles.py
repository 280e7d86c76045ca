"""SQL that each catalogued query is checked against, in DuckDB's dialect, over the same tables."""

from __future__ import annotations

from .. import bindings as b
from ..operators.tags import LINE_TEXT_LIMIT
from .samples import SAMPLES, Sample

_T = b.plain_sql(b.TAGS)
_C = b.plain_sql(b.COMMIT_FILES)
_F = b.plain_sql(b.SOURCE_FILES)
_A = b.plain_sql(b.ANALYSES)
_L = b.plain_sql(b.LEADS)
_U = b.plain_sql(b.URLS)

# Named building blocks; each may use those before it.
_TAGS = [("b_tags", _T)]
_GRAPH = _TAGS + [
    ("d", "SELECT DISTINCT repo_id, name, path FROM b_tags WHERE kind = 'def'"),
    ("r", "SELECT repo_id, name, path, count(*) AS ref_count FROM b_tags WHERE kind = 'ref' GROUP BY ALL"),
    (
        "e",
        "SELECT r.repo_id, r.path AS source, d.path AS target, name AS ident,"
        " CASE WHEN starts_with(name, '_') THEN 0.1e0 ELSE 1e0 END * sqrt(ref_count) AS weight"
        " FROM r JOIN d USING (repo_id, name)",
    ),
    ("nd", "SELECT repo_id, source AS id FROM e UNION SELECT repo_id, target FROM e"),
    ("cn", "SELECT repo_id, count(*) AS n FROM nd GROUP BY ALL"),
    (
        "deg",
        "SELECT repo_id, file, count(*) AS degree FROM"
        " (SELECT repo_id, source AS file FROM e UNION ALL SELECT repo_id, target FROM e) GROUP BY ALL",
    ),
    (
        "cent",
        "SELECT repo_id, file, CASE WHEN n > 1 THEN degree / CAST(n - 1 AS DOUBLE) ELSE 1e0 END AS centrality"
        " FROM deg JOIN cn USING (repo_id)",
    ),
]


def _rounds(count: int) -> list[tuple[str, str]]:
    return _GRAPH + [
        ("w", "SELECT repo_id, source AS src, target AS dst, sum(weight) AS w FROM e GROUP BY ALL"),
        ("o", "SELECT repo_id, src, sum(w) AS ow FROM w GROUP BY ALL"),
        (
            "t",
            "SELECT w.repo_id, w.src, w.dst, w / ow AS s FROM w JOIN o USING (repo_id, src)"
            " UNION ALL SELECT a.repo_id, a.id, c.id, 1e0 / n FROM nd a JOIN nd c USING (repo_id) JOIN cn USING (repo_id)"
            " ANTI JOIN o ON o.repo_id = a.repo_id AND o.src = a.id"
            " UNION ALL SELECT repo_id, id, id, 0e0 FROM nd",
        ),
        (
            "pr(it, repo_id, id, rk)",
            "SELECT 0, repo_id, id, 1e0 / n FROM nd JOIN cn USING (repo_id)"
            " UNION ALL SELECT it + 1, t.repo_id, t.dst, max(0.15e0 / n) + 0.85e0 * sum(rk * s)"
            " FROM pr JOIN t ON t.repo_id = pr.repo_id AND t.src = pr.id JOIN cn ON cn.repo_id = t.repo_id"
            f" WHERE it < {count} GROUP BY it, t.repo_id, t.dst",
        ),
    ]


_RANKS = _rounds(100) + [
    (
        "chg",
        "SELECT x.it, x.repo_id, sum(abs(x.rk - y.rk)) AS change FROM pr x JOIN pr y"
        " ON x.repo_id = y.repo_id AND x.id = y.id AND x.it = y.it + 1 GROUP BY ALL",
    ),
    (
        "stop",
        "SELECT repo_id, coalesce(min(CASE WHEN change < n * 1e-6 THEN it END), 100) AS it"
        " FROM chg JOIN cn USING (repo_id) GROUP BY ALL",
    ),
    (
        "ranks",
        "SELECT pr.repo_id, pr.id AS file, rk AS rank, centrality FROM pr JOIN stop ON stop.repo_id = pr.repo_id"
        " AND stop.it = pr.it JOIN cent ON cent.repo_id = pr.repo_id AND cent.file = pr.id",
    ),
    (
        "ranked",
        "SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY round(rank, 12) DESC, file DESC) AS INT)"
        " AS rank_position, file, round(rank, 6) AS pagerank_score, round(centrality, 6) AS centrality FROM ranks",
    ),
    ("outw", "SELECT repo_id, source, sum(weight) AS ow FROM e GROUP BY ALL"),
    (
        "rdef",
        "SELECT e.repo_id, e.target AS file, e.ident, sum(rank * weight / ow) AS rank FROM e"
        " JOIN outw USING (repo_id, source) JOIN ranks ON ranks.repo_id = e.repo_id AND ranks.file = e.source GROUP BY ALL",
    ),
    (
        "top_nodes",
        "SELECT repo_id, file, pagerank FROM (SELECT repo_id, file, round(rank, 6) AS pagerank,"
        " row_number() OVER (PARTITION BY repo_id ORDER BY round(rank, 6) DESC, file) AS p FROM ranks) WHERE p <= 20",
    ),
    (
        "sub",
        "SELECT repo_id, source, target, ident, round(weight, 4) AS weight FROM e"
        " SEMI JOIN top_nodes a ON a.repo_id = e.repo_id AND a.file = e.source"
        " SEMI JOIN top_nodes z ON z.repo_id = e.repo_id AND z.file = e.target WHERE source <> target",
    ),
]


def _half_up(total: str, count: str) -> str:
    """Quotient of two non-negative whole numbers at two decimals, halves up."""
    return f"CAST((200 * ({total}) + {count}) // (2 * {count}) AS DOUBLE) / 100"


_WINDOW = [
    ("b_commit_files", _C),
    (
        "win",
        f"SELECT * FROM b_commit_files WHERE commit_ts >= TIMESTAMP '{b.AS_OF}' - INTERVAL {b.MONTHS} MONTH"
        f" AND commit_ts < TIMESTAMP '{b.AS_OF}' + INTERVAL 1 DAY AND added IS NOT NULL AND removed IS NOT NULL",
    ),
    (
        "au",
        "SELECT repo_id, path, author_email, CAST(sum(added + removed) AS BIGINT) AS lines FROM win GROUP BY ALL",
    ),
    (
        "expn",
        "SELECT repo_id, path, count(*) AS authors, CAST(sum(lines) AS BIGINT) AS file_lines,"
        " max(lines) AS most FROM au GROUP BY ALL",
    ),
    (
        "minor",
        "SELECT win.repo_id, win.path AS filename, count(DISTINCT win.author_email) AS minor_contributor FROM win JOIN"
        " (SELECT repo_id, author_email FROM win WHERE author_email <> '' GROUP BY ALL HAVING count(DISTINCT path) <= 2) m"
        " ON m.repo_id = win.repo_id AND m.author_email = win.author_email GROUP BY ALL",
    ),
    (
        "fc",
        "SELECT repo_id, path AS filename, count(*) AS commits,"
        " count(DISTINCT CASE WHEN author_email <> '' THEN author_email END) AS total_contributor,"
        " CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(removed) AS BIGINT) AS removed_lines,"
        " CAST(max(added) AS BIGINT) AS max_lines_added, CAST(max(removed) AS BIGINT) AS max_lines_removed,"
        " max(commit_ts) AS ts FROM win GROUP BY ALL",
    ),
    (
        "latest",
        "SELECT win.repo_id, win.path AS filename, max(commit_hash) AS hash FROM win JOIN fc"
        " ON fc.repo_id = win.repo_id AND fc.filename = win.path AND fc.ts = win.commit_ts GROUP BY ALL",
    ),
    (
        "all_churn",
        "SELECT fc.repo_id, CAST(row_number() OVER (PARTITION BY fc.repo_id ORDER BY commits DESC, ts DESC, hash DESC,"
        " fc.filename) AS INT) AS position, fc.filename, commits, total_contributor,"
        " coalesce(minor_contributor, 0) AS minor_contributor, "
        + _half_up("100 * most", "file_lines")
        + " AS contributor_exp, lines_added + removed_lines AS total_churn,"
        " max_lines_added + max_lines_removed AS max_churn, "
        + _half_up("lines_added + removed_lines", "commits")
        + " AS avg_churn, lines_added, max_lines_added, "
        + _half_up("lines_added", "commits")
        + " AS avg_lines_added, removed_lines, max_lines_removed, "
        + _half_up("removed_lines", "commits")
        + " AS avg_lines_removed FROM fc JOIN latest USING (repo_id, filename)"
        " JOIN expn ON expn.repo_id = fc.repo_id AND expn.path = fc.filename"
        " LEFT JOIN minor ON minor.repo_id = fc.repo_id AND minor.filename = fc.filename",
    ),
    ("churn", "SELECT * FROM all_churn WHERE position <= 30"),
]


def _process(sign: str) -> list[tuple[str, str]]:
    return _WINDOW + [
        (
            "cm",
            "SELECT repo_id, path AS filename, commit_hash, CAST(sum(added) AS BIGINT) AS a, CAST(sum(removed) AS BIGINT)"
            f" AS r, CAST(sum(added) {sign} sum(removed) AS BIGINT) AS c, max(commit_ts) AS ts FROM win GROUP BY ALL",
        ),
        (
            "pf",
            "SELECT repo_id, filename, count(*) AS commits, CAST(sum(c) AS BIGINT) AS total, max(c) AS most, avg(c) AS mean,"
            " CAST(sum(a) AS BIGINT) AS asum, max(a) AS amax, avg(a) AS amean, CAST(sum(r) AS BIGINT) AS rsum,"
            " max(r) AS rmax, avg(r) AS rmean, max(ts) AS ts FROM cm GROUP BY ALL",
        ),
        (
            "pl",
            "SELECT cm.repo_id, cm.filename, max(commit_hash) AS hash FROM cm JOIN pf ON pf.repo_id = cm.repo_id"
            " AND pf.filename = cm.filename AND pf.ts = cm.ts GROUP BY ALL",
        ),
        (
            "pp",
            "SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY commits DESC, ts DESC, hash DESC, filename)"
            " AS INT) AS position FROM pf JOIN pl USING (repo_id, filename)",
        ),
        (
            "pe",
            "SELECT au.repo_id, au.path AS filename, count(*) AS authors,"
            " count(*) FILTER (lines / CAST(file_lines AS DOUBLE) < 0.05e0) AS few,"
            f" {_half_up('100 * max(most)', 'max(file_lines)')} AS experience"
            " FROM au JOIN expn USING (repo_id, path) GROUP BY ALL",
        ),
    ]


_SUFFIX = "(ends_with(r.file, c.filename) OR ends_with(c.filename, r.file))"


def _spots(churn: str, on: str = _SUFFIX) -> list[tuple[str, str]]:
    """First matching churn row per ranked file, and the hotspots that follow."""
    return _WINDOW + _RANKS + [
        (
            "hit",
            "SELECT * FROM (SELECT r.*, c.commits, c.total_churn, row_number() OVER (PARTITION BY r.repo_id, r.file"
            f" ORDER BY c.position) AS pick FROM ranked r JOIN {churn} c ON c.repo_id = r.repo_id AND {on}) WHERE pick = 1",
        ),
        (
            "spots",
            "SELECT hit.repo_id, file, pagerank_score, centrality, commits, total_churn,"
            " round(pagerank_score / mr * (commits / CAST(mc AS DOUBLE)), 4) AS hotspot_score, rank_position FROM hit"
            " JOIN (SELECT repo_id, max(pagerank_score) AS mr FROM ranked GROUP BY ALL) USING (repo_id)"
            f" JOIN (SELECT repo_id, max(commits) AS mc FROM {churn} GROUP BY ALL) USING (repo_id)",
        ),
    ]


_PATHS = [
    (
        "sym",
        "SELECT repo_id, path, count(*) AS c FROM b_tags WHERE kind = 'def' GROUP BY ALL",
    ),
    (
        "node",
        "SELECT repo_id, path, 'file' AS node_type, c AS symbol_count FROM sym UNION ALL"
        " SELECT repo_id, array_to_string(parts[1:i], '/'), 'dir', CAST(sum(c) AS BIGINT) FROM"
        " (SELECT repo_id, c, string_split(path, '/') AS parts FROM sym), range(1, 64) AS g(i)"
        " WHERE i < len(parts) GROUP BY ALL",
    ),
    (
        "tree",
        "SELECT repo_id, path, array_to_string(string_split(path, '/')[1:-2], '/') AS parent,"
        " CAST(len(string_split(path, '/')) - 1 AS INT) AS depth, string_split(path, '/')[-1] AS name, node_type,"
        " symbol_count FROM node",
    ),
]

# The prose binding with its line numbers.
_LINES = [
    ("b_files", _F),
    (
        "ln",
        "SELECT repo_id, path, CAST(i - 1 AS INT) AS line, text FROM (SELECT repo_id, path,"
        " unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i"
        " FROM b_files WHERE length(content) > 0)",
    ),
]


def _prose(definition: str, reference: str | None) -> list[tuple[str, str]]:
    parts = [
        f"SELECT repo_id, path, line, unnest(regexp_extract_all(text, '{pattern}', 1)) AS name, '{kind}' AS kind, text FROM ln"
        for pattern, kind in ((definition, "def"), (reference, "ref"))
        if pattern
    ]
    return _LINES + [("found", " UNION ALL ".join(parts))]


_PROSE = _prose("^([A-Z][a-z]+)", "([a-z]+)")
_LINKED = _prose("^[A-Z]([a-z]+)", "([a-z]+)") + [
    (
        "linked",
        "SELECT DISTINCT repo_id, path, line, text[1:100] AS text FROM found SEMI JOIN"
        " (SELECT DISTINCT repo_id, name FROM found WHERE kind = 'ref') x USING (repo_id, name) WHERE kind = 'def'",
    ),
    ("ld", "SELECT DISTINCT repo_id, name, path FROM found WHERE kind = 'def'"),
    ("lr", "SELECT DISTINCT repo_id, name, path FROM found WHERE kind = 'ref'"),
    ("le", "SELECT lr.repo_id, lr.path AS source, ld.path AS target FROM lr JOIN ld USING (repo_id, name)"),
    ("lf", "SELECT repo_id, source AS path FROM le UNION SELECT repo_id, target FROM le"),
]

_REQUESTS = [
    ("b_urls", _U),
    ("cleaned", r"SELECT url, rtrim(regexp_replace(url, '^\s+|\s+$', '', 'g'), '/') AS repo_url FROM b_urls"),
    (
        "req",
        r"SELECT url, repo_url, string_split(repo_url, '/')[-2] AS owner, string_split(repo_url, '/')[-1] AS repo_name,"
        r" sha256(lower(repo_url))[1:16] AS cache_key FROM cleaned"
        r" WHERE regexp_matches(repo_url, '^https://github\.com/[\w.\-]+/[\w.\-]+$')",
    ),
    ("stored", "SELECT DISTINCT cache_key FROM req WHERE CAST(regexp_extract(repo_url, '/org([0-9]+)/', 1) AS INT) % 2 = 0"),
]

# Each key's run: the third where one of its addresses was asked for more than once, else the first.
_KEPT = (
    "SELECT cache_key, CASE WHEN max(n) > 1 THEN TIMESTAMP '2024-01-03' ELSE TIMESTAMP '2024-01-01' END AS computed_at"
    " FROM asked GROUP BY ALL"
)

_ANALYSES_COLUMNS = (
    "id, repo_url, repo_name, timestamp, CAST(NULL AS VARCHAR) AS ip_address, CAST(NULL AS VARCHAR) AS user_agent,"
    " file_count, CAST(0 AS INT) AS ranked_files_count, {churn} AS churn_files_count, CAST(0 AS INT) AS hotspot_count,"
    " CAST(NULL AS VARCHAR) AS top_ranked_file, CAST(NULL AS VARCHAR) AS top_churned_file,"
    " CAST(NULL AS VARCHAR) AS top_hotspot_file, {nodes} AS graph_nodes, CAST(0 AS INT) AS graph_edges,"
    " CAST(0 AS INT) AS ast_symbol_count, CAST(0 AS INT) AS churn_total_contributors, duration_seconds"
)
_PLAIN = _ANALYSES_COLUMNS.format(churn="churn_files_count", nodes="CAST(0 AS INT)")
_RECENT = "timestamp >= TIMESTAMP '2024-01-03'"
_MERGED = _ANALYSES_COLUMNS.format(
    churn=f"CASE WHEN {_RECENT} THEN churn_files_count ELSE 0 END",
    nodes=f"CASE WHEN {_RECENT} THEN file_count + 1 ELSE 0 END",
)
_LOGS = [
    ("b_analyses", _A),
    ("b_leads", _L),
    ("vl", "SELECT * FROM b_leads WHERE coalesce(email, '') <> '' OR coalesce(linkedin, '') <> ''"),
    (
        "pop",
        "SELECT repo_url, arg_max(repo_name, (timestamp, repo_name)) AS repo_name, count(*) AS analysis_count,"
        " max(timestamp) AS last_analyzed FROM b_analyses GROUP BY repo_url",
    ),
]
_LEAD_COLUMNS = (
    "id, email, linkedin, repo_url, repo_name, timestamp, CAST(NULL AS VARCHAR) AS ip_address,"
    " CAST(NULL AS VARCHAR) AS user_agent"
)


def _summary(zeroed: bool) -> str:
    def graph(column: str) -> str:
        return f"CAST({'0' if zeroed else f'coalesce({column}, 0)'} AS INT)"

    return (
        "SELECT repo_id, CAST(coalesce(fc, 0) AS INT) AS file_count, CAST(coalesce(rf, 0) AS INT) AS ranked_files_count,"
        " CAST(coalesce(cf, 0) AS INT) AS churn_files_count, CAST(coalesce(hc, 0) AS INT) AS hotspot_count,"
        f" {graph('gn')} AS graph_nodes, {graph('ge')} AS graph_edges, {graph('sc')} AS ast_symbol_count,"
        f" {graph('cc')} AS churn_total_contributors, trf AS top_ranked_file, tcf AS top_churned_file,"
        " thf AS top_hotspot_file" + (", 0e0 AS duration_seconds" if zeroed else "") +
        " FROM (SELECT repo_id, count(DISTINCT path) AS fc FROM b_tags GROUP BY ALL)"
        " FULL JOIN (SELECT repo_id, count(*) AS rf, arg_min(file, rank_position) AS trf FROM ranked GROUP BY ALL) USING (repo_id)"
        " FULL JOIN (SELECT repo_id, n AS gn FROM cn) USING (repo_id)"
        " FULL JOIN (SELECT repo_id, count(*) AS ge FROM e GROUP BY ALL) USING (repo_id)"
        " FULL JOIN (SELECT repo_id, count(*) AS cf, arg_min(filename, position) AS tcf, max(total_contributor) AS cc"
        " FROM churn GROUP BY ALL) USING (repo_id)"
        " FULL JOIN (SELECT repo_id, count(*) AS hc, arg_max(file, (hotspot_score, -rank_position)) AS thf"
        " FROM spots GROUP BY ALL) USING (repo_id)"
        " FULL JOIN (SELECT repo_id, count(*) AS sc FROM b_tags WHERE kind = 'def' GROUP BY ALL) USING (repo_id)"
    )


_COLLAPSE = (
    "SELECT repo_id, source, target, round(sum(round(weight, 4)), 4) AS weight,"
    " array_to_string(list_sort(list(ident))[1:5], ',') AS idents FROM {edges} GROUP BY repo_id, source, target"
)
_MATRIX = (
    "SELECT repo_id, file, pagerank, commits, churn, round(commits / CAST(mc AS DOUBLE), 6) AS x,"
    " round(pagerank / mr, 6) AS y, round(churn / CAST(mh AS DOUBLE), 6) AS size,"
    " CASE WHEN commits > mc * 0.3e0 AND pagerank > mr * 0.3e0 THEN 'highest risk'"
    " WHEN commits > mc * 0.3e0 THEN 'fragile but isolated' WHEN pagerank > mr * 0.3e0 THEN 'stable & central'"
    " ELSE 'safe territory' END AS quadrant FROM pts JOIN (SELECT repo_id, greatest(max(commits), 1) AS mc,"
    " max(pagerank) AS mr, greatest(max(churn), 1) AS mh FROM pts GROUP BY ALL) USING (repo_id)"
)
_POINTS = (
    "pts",
    "SELECT r.repo_id, r.file, r.pagerank_score AS pagerank, coalesce(hit.commits, 0) AS commits,"
    " coalesce(hit.total_churn, 0) AS churn FROM ranked r LEFT JOIN hit ON hit.repo_id = r.repo_id AND hit.file = r.file",
)
_PROCESS = (
    "SELECT pp.repo_id, position, pp.filename, commits, authors AS \"Total_contributor\", few AS \"Minor_contributor\","
    " experience AS \"Contributor_exp\", total AS \"Total_churn\", most AS \"Max_churn\", round(mean, 6) AS \"Avg_churn\","
    " asum AS lines_added, amax AS max_lines_added, round(amean, 6) AS avg_lines_added_per_commit, rsum AS removed_lines,"
    " rmax AS max_lines_removed, round(rmean, 6) AS avg_lines_removed_per_commit"
    " FROM pp JOIN pe USING (repo_id, filename) WHERE position <= 21"
)
_SECTIONS = (
    "SELECT repo_id, 'summary' AS section, count(DISTINCT path) AS fc, CAST(NULL AS BIGINT) AS rp,"
    " CAST(NULL AS BIGINT) AS tc, CAST(NULL AS BIGINT) AS sc, CAST(NULL AS BIGINT) AS l, 1 AS n"
    " FROM b_tags GROUP BY repo_id UNION ALL"
    " SELECT repo_id, 'ranked_files', NULL, sum(rank_position), NULL, NULL, NULL, count(*) FROM ranked GROUP BY repo_id UNION ALL"
    " SELECT repo_id, 'nodes', NULL, NULL, NULL, NULL, NULL, count(*) FROM ranks GROUP BY repo_id UNION ALL"
    " SELECT repo_id, 'edges', NULL, NULL, NULL, NULL, NULL, count(*) FROM e GROUP BY repo_id UNION ALL"
    " SELECT repo_id, 'tree', NULL, NULL, NULL, sum(symbol_count), NULL, count(*) FROM tree GROUP BY repo_id UNION ALL"
    " SELECT repo_id, 'symbols', NULL, NULL, NULL, NULL, sum(line), count(*) FROM b_tags WHERE kind = 'def' GROUP BY repo_id UNION ALL"
    " SELECT repo_id, 'hotspots', NULL, NULL, sum(total_churn), NULL, NULL, count(*) FROM spots GROUP BY repo_id"
)
_RANKED_TAGS = (
    "SELECT * FROM (SELECT x.repo_id, 1 AS section, x.file, x.ident, g.line, round(x.rank, 9) AS rank FROM rdef x"
    " JOIN (SELECT DISTINCT repo_id, path, name, line FROM b_tags WHERE kind = 'def') g"
    " ON g.repo_id = x.repo_id AND g.path = x.file AND g.name = x.ident UNION ALL"
    " SELECT repo_id, 2, file, NULL, NULL, round(rank, 9) FROM ranks ANTI JOIN rdef USING (repo_id, file))"
)


def _sql(blocks: list[tuple[str, str]], query: str) -> str:
    """``query`` after those of its building blocks that it needs, each named once."""
    named = dict(blocks)
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body.strip()})" for name, body in named.items()) + "\n" + query


_SUFFIX_SPOTS = _spots("churn")

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def _numbered(column: str) -> str:
    return f"replace({column}, '{{k}}', CAST(p_partkey AS VARCHAR)) AS {column}"


def _tags_of(lang: str) -> str:
    sample = SAMPLES[lang]
    rows = [(line, name, "def") for line, name, _ in sample.definitions] + [(line, name, "ref") for line, name in sample.references]
    return b.code_sql(lang, _rows(rows), "line, name, kind", f"CAST(line AS INT) AS line, {_numbered('name')}, kind")


def _scopes_of(lang: str) -> str:
    sample = SAMPLES[lang]
    named: dict[int, str] = {}
    for line, name, _ in sorted(sample.definitions):
        named.setdefault(line, name)
    rows = [
        (line, name, len(heads), ",".join(map(str, heads)), ".".join([*(named[h] for h in heads if h in named), name]))
        for line, name, heads in {(a, n, tuple(h)) for a, n, h in sample.definitions}
    ]
    chosen = f"CAST(line AS INT) AS line, {_numbered('name')}, CAST(depth AS INT) AS depth, heads, {_numbered('qualified_name')}"
    return b.code_sql(lang, _rows(rows), "line, name, depth, heads, qualified_name", chosen)


def _map_lines(sample: Sample) -> list[int]:
    """Lines that the map shows: definitions whose name a file of the repository refers to, in any language, and their heads."""
    used = {name for s in SAMPLES.values() for _, name in s.references}
    return sorted({at for line, name, heads in sample.definitions if name in used for at in (line, *heads)})


def _map_of(lang: str) -> str:
    sample = SAMPLES[lang]
    text = sample.text.split("\n")
    body = "\n".join(text[i] for i in _map_lines(sample))
    lines = "string_split(replace(body, '{k}', CAST(p_partkey AS VARCHAR)), chr(10))"
    shown = f"array_to_string([substring(x, 1, {LINE_TEXT_LIMIT}) FOR x IN {lines}], chr(10))"
    return b.code_sql(lang, _rows([(body,)]), "body", f"concat(path, ':', chr(10), {shown}) AS text")


ORACLES: dict[str, str] = {
    **{f"tags_{lang}": _tags_of(lang) for lang in SAMPLES},
    "tag_scopes": " UNION ALL ".join(_scopes_of(lang) for lang in SAMPLES),
    "repo_map_scopes": " UNION ALL ".join(_map_of(lang) for lang in SAMPLES if _map_lines(SAMPLES[lang])),
    "churn_top_files": _sql(_WINDOW, "SELECT * FROM churn"),
    "churn_all_files": _sql(_WINDOW, "SELECT * FROM all_churn"),
    "churn_totals": _sql(
        _WINDOW,
        "SELECT repo_id, count(DISTINCT path) AS total_files_with_commits, '2001-02-01 to 2001-08-01' AS period"
        " FROM win GROUP BY repo_id",
    ),
    "minor_contributors": _sql(_WINDOW, "SELECT * FROM minor"),
    "contributor_experience": _sql(
        _process("-"),
        "SELECT repo_id, filename, authors AS total_contributor, few AS minor_by_share, experience AS contributor_exp FROM pe",
    ),
    "churn_process_metrics": _sql(_process("-"), _PROCESS),
    "churn_process_gross": _sql(
        _process("+"),
        "SELECT repo_id, position, filename, commits, total AS \"Total_churn\", most AS \"Max_churn\","
        " round(mean, 6) AS \"Avg_churn\" FROM pp WHERE position <= 21",
    ),
    "churn_find_file": _sql(
        _WINDOW,
        "SELECT * FROM churn WHERE contains(filename, 'f1')"
        " QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY position) = 1",
    ),
    "churn_chart": _sql(
        _WINDOW,
        "SELECT repo_id, position, filename, total_churn, round(total_churn / CAST(greatest(max(total_churn)"
        " OVER (PARTITION BY repo_id), 1) AS DOUBLE), 6) AS bar FROM churn WHERE position <= 15",
    ),
    "definers": _sql(_GRAPH, "SELECT repo_id, name, path FROM d"),
    "ref_counts": _sql(_GRAPH, "SELECT * FROM r"),
    "ref_counts_without_refs": _sql(_GRAPH, "SELECT repo_id, name, path, CAST(1 AS BIGINT) AS ref_count FROM d"),
    "linked_names": _sql(_GRAPH, "SELECT DISTINCT repo_id, name FROM d SEMI JOIN r USING (repo_id, name)"),
    "dependency_edges": _sql(_GRAPH, "SELECT repo_id, source, target, ident, round(weight, 4) AS weight FROM e"),
    "graph_sizes": _sql(
        _GRAPH,
        "SELECT repo_id, n AS graph_nodes, graph_edges FROM cn"
        " JOIN (SELECT repo_id, count(*) AS graph_edges FROM e GROUP BY ALL) USING (repo_id)",
    ),
    "degree_centrality": _sql(_GRAPH, "SELECT repo_id, file, round(centrality, 6) AS centrality FROM cent"),
    "most_central": _sql(
        _GRAPH,
        "SELECT repo_id, file, round(centrality, 6) AS centrality FROM cent"
        " QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY centrality DESC, file) = 1",
    ),
    "top_n_nodes": _sql(
        _RANKS,
        "SELECT repo_id, file, pagerank, round(pagerank / max(pagerank) OVER (PARTITION BY repo_id), 4) AS relative_rank"
        " FROM top_nodes",
    ),
    "top_n_subgraph": _sql(_RANKS, "SELECT * FROM sub"),
    "collapsed_edges": _sql(_RANKS, _COLLAPSE.format(edges="sub")),
    "collapsed_graph": _sql(_GRAPH, _COLLAPSE.format(edges="(SELECT * FROM e WHERE source <> target)")),
    "pagerank_files": _sql(_RANKS, "SELECT * FROM ranked"),
    "pagerank_empty_names": _sql(
        [
            (
                "b_tags",
                "SELECT repo_id, path, line, CASE WHEN regexp_matches(name, '[05]0$') THEN '' ELSE name END AS name, kind"
                f" FROM ({_T})",
            ),
            *_RANKS[1:],
        ],
        "SELECT * FROM ranked",
    ),
    "pagerank_fixed_rounds": _sql(
        _rounds(20), "SELECT repo_id, id AS file, round(rk, 9) AS rank FROM pr WHERE it = 20"
    ),
    "pagerank_nodes": _sql(
        _RANKS, "SELECT repo_id, file AS id, round(rank, 6) AS pagerank, round(centrality, 6) AS centrality FROM ranks"
    ),
    "pagerank_top": _sql(_RANKS, "SELECT * FROM ranked WHERE rank_position <= 3"),
    "pagerank_bars": _sql(
        _RANKS,
        "SELECT r.repo_id, r.rank_position, r.file, r.pagerank_score, round(r.pagerank_score / f.pagerank_score * 100, 3)"
        " AS percent FROM ranked r JOIN ranked f ON f.repo_id = r.repo_id AND f.rank_position = 1",
    ),
    "ranked_definitions": _sql(_RANKS, "SELECT repo_id, file, ident, round(rank, 9) AS rank FROM rdef"),
    "ordered_definitions": _sql(
        _RANKS,
        "SELECT repo_id, file, ident, round(rank, 9) AS rank, row_number() OVER (PARTITION BY repo_id"
        " ORDER BY round(rank, 12) DESC, file DESC, ident DESC) AS position FROM rdef",
    ),
    "ranked_tags": _sql(_RANKS, _RANKED_TAGS),
    "ranked_tags_of_text": _sql(
        [("b_tags", " UNION ALL ".join(_tags_of(lang) for lang in ("php", "python"))), *_RANKS[1:]], _RANKED_TAGS
    ),
    "file_rank_lookup": _sql(
        _RANKS,
        "SELECT repo_id, file, pagerank_score, rank_position, total_files, top_files FROM ranked"
        " JOIN (SELECT repo_id, count(*) AS total_files, array_to_string(list(file ORDER BY rank_position)[1:3], ',')"
        " AS top_files FROM ranked GROUP BY ALL) USING (repo_id) WHERE file = 'dir3/f3.py'",
    ),
    "hotspots": _sql(_SUFFIX_SPOTS, "SELECT * FROM spots"),
    "hotspots_exact": _sql(_spots("churn", "r.file = c.filename"), "SELECT * FROM spots"),
    "hotspots_all_churn": _sql(_spots("all_churn"), "SELECT * FROM spots"),
    "prioritization_matrix": _sql(_SUFFIX_SPOTS + [_POINTS], _MATRIX),
    "file_languages": _sql(_LINES, "SELECT repo_id, path, 'prose' AS lang FROM b_files WHERE length(content) > 0"),
    "extract_tags": _sql(_PROSE, "SELECT repo_id, path, line, name, kind FROM found"),
    "backfill_refs": _sql(
        _prose("^([A-Z][a-z]+)", None),
        "SELECT * FROM (SELECT repo_id, path, CAST(-1 AS INT) AS line, unnest(regexp_extract_all(content, '[A-Za-z_]\\w*'))"
        " AS name, 'ref' AS kind FROM b_files SEMI JOIN found USING (repo_id, path)) WHERE name NOT IN ('the', 'of', 'and')",
    ),
    "file_symbols": _sql(_PROSE, "SELECT repo_id, path, line, name FROM found WHERE kind = 'def'"),
    "definition_tags": _sql(_TAGS, "SELECT DISTINCT repo_id, path, line, name FROM b_tags WHERE kind = 'def'"),
    "repo_map_lines": _sql(_LINKED, "SELECT repo_id, path, line, text FROM linked"),
    "repo_map_text": _sql(
        _LINKED,
        "SELECT lf.repo_id, lf.path, CASE WHEN body IS NULL THEN lf.path ELSE concat(lf.path, ':', chr(10), body) END AS text"
        " FROM lf LEFT JOIN (SELECT repo_id, path, string_agg(text, chr(10) ORDER BY line) AS body FROM linked GROUP BY ALL) t"
        " ON t.repo_id = lf.repo_id AND t.path = lf.path",
    ),
    "prose_graph": _sql(
        _LINKED,
        "SELECT repo_id, graph_nodes, graph_edges FROM (SELECT repo_id, count(*) AS graph_nodes FROM lf GROUP BY ALL)"
        " JOIN (SELECT repo_id, count(*) AS graph_edges FROM le GROUP BY ALL) USING (repo_id)",
    ),
    "parse_numstat": _sql(
        _WINDOW, "SELECT * FROM b_commit_files WHERE added IS NOT NULL AND removed IS NOT NULL"
    ),
    "history_roundtrip": _sql(
        _WINDOW, "SELECT * FROM b_commit_files WHERE added IS NOT NULL AND removed IS NOT NULL"
    ),
    "symbol_tree": _sql(_TAGS + _PATHS, "SELECT * FROM tree"),
    "symbol_tree_of_text": _sql([*_PROSE, ("b_tags", "SELECT * FROM found"), *_PATHS], "SELECT * FROM tree"),
    "tree_files": _sql(_TAGS + _PATHS, "SELECT * FROM tree WHERE node_type = 'file'"),
    "symbol_totals": _sql(
        _TAGS + _PATHS,
        "SELECT repo_id, count(*) AS total_files, CAST(sum(c) AS BIGINT) AS total_symbols FROM sym GROUP BY ALL",
    ),
    "symbol_search": _sql(
        _TAGS + _PATHS,
        "SELECT * FROM tree t WHERE EXISTS (SELECT 1 FROM (SELECT repo_id, path FROM tree WHERE contains(lower(name), 'k7')"
        " UNION SELECT repo_id, path FROM b_tags WHERE kind = 'def' AND contains(lower(name), 'k7')) f"
        " WHERE f.repo_id = t.repo_id AND (f.path = t.path OR starts_with(f.path, t.path || '/')))",
    ),
    "total_files": _sql(_LINES, "SELECT repo_id, count(*) AS file_count FROM b_files GROUP BY repo_id"),
    "missing_file_names": _sql(
        _LINES,
        "SELECT repo_id, text FROM (SELECT DISTINCT repo_id FROM b_files) q, (VALUES ('en/d1/1'), ('fr/d'), ('.txt')) v(text)"
        " WHERE NOT EXISTS (SELECT 1 FROM b_files f WHERE f.repo_id = q.repo_id AND contains(f.path, text))",
    ),
    "usage_totals": _sql(
        _LOGS,
        "SELECT (SELECT count(*) FROM b_analyses) AS total_analyses, (SELECT count(DISTINCT repo_url) FROM b_analyses)"
        " AS unique_repos, (SELECT count(*) FROM vl) AS total_leads",
    ),
    "popular_repos": _sql(_LOGS, "SELECT * FROM pop ORDER BY analysis_count DESC, repo_url LIMIT 10"),
    "repo_popularity": _sql(_LOGS, "SELECT * FROM pop"),
    "recent_analyses": _sql(_LOGS, f"SELECT {_PLAIN} FROM b_analyses ORDER BY timestamp DESC, id DESC LIMIT 20"),
    "recent_leads": _sql(_LOGS, f"SELECT {_LEAD_COLUMNS} FROM vl ORDER BY timestamp DESC, id DESC LIMIT 50"),
    "valid_leads": _sql(_LOGS, "SELECT * FROM vl"),
    "merged_analyses": _sql(_LOGS, f"SELECT {_MERGED} FROM b_analyses"),
    "exported_analyses": _sql(_LOGS, f"SELECT {_PLAIN} FROM b_analyses"),
    "valid_repo_urls": _sql(_REQUESTS, "SELECT * FROM req"),
    "cache_keys": _sql(_REQUESTS, "SELECT DISTINCT repo_url, cache_key FROM req"),
    "analyses_log": _sql(_LOGS, f"SELECT {_MERGED} FROM b_analyses"),
    "leads_log": _sql(_LOGS, f"SELECT {_LEAD_COLUMNS} FROM vl"),
    "exported_leads": _sql(_LOGS, f"SELECT {_LEAD_COLUMNS} FROM vl"),
    "popularity_stream": _sql(_LOGS, "SELECT * FROM pop"),
    "admin_metrics": _sql(
        _LOGS,
        "SELECT 'totals' AS section, 'total_analyses' AS name, count(*) AS number FROM b_analyses UNION ALL"
        " SELECT 'totals', 'unique_repos', count(DISTINCT repo_url) FROM b_analyses UNION ALL"
        " SELECT 'totals', 'total_leads', count(*) FROM vl UNION ALL"
        " (SELECT 'recent', repo_url, id FROM b_analyses ORDER BY timestamp DESC, id DESC LIMIT 50) UNION ALL"
        " (SELECT 'popular', repo_url, analysis_count FROM pop ORDER BY analysis_count DESC, repo_url LIMIT 10) UNION ALL"
        " (SELECT 'leads', repo_url, id FROM vl ORDER BY timestamp DESC, id DESC LIMIT 50)",
    ),
    "stored_results": _sql(
        _REQUESTS + [("asked", "SELECT repo_url, cache_key, count(*) AS n FROM req GROUP BY ALL"), ("kept", _KEPT)],
        "SELECT cache_key, computed_at, 'summary' AS section, CAST(0 AS BIGINT) AS position,"
        " concat('{\"repo_url\":\"', repo_url, '\",\"asked\":', n, '}') AS doc FROM kept JOIN asked USING (cache_key)"
        " WHERE n > 1 OR computed_at = TIMESTAMP '2024-01-01'",
    ),
    "new_repos_only": _sql(_REQUESTS, "SELECT repo_url, cache_key FROM req ANTI JOIN stored USING (cache_key)"),
    "known_repos": _sql(
        _REQUESTS,
        "SELECT repo_url, cache_key, true AS cached, 0e0 AS duration_seconds FROM req SEMI JOIN stored USING (cache_key)",
    ),
    "run_summary": _sql(_SUFFIX_SPOTS, _summary(False)),
    "run_summary_all_repos": _sql(
        _SUFFIX_SPOTS,
        f"SELECT * FROM (SELECT * FROM ({_summary(False)}) UNION ALL BY NAME SELECT 'none' AS repo_id, 0 AS file_count,"
        " 0 AS ranked_files_count, 0 AS churn_files_count, 0 AS hotspot_count, 0 AS graph_nodes, 0 AS graph_edges,"
        " 0 AS ast_symbol_count, 0 AS churn_total_contributors)"
        " JOIN (SELECT s.repo_id, coalesce(n, 0) AS total_files_with_commits,"
        f" strftime(DATE '{b.AS_OF}' - INTERVAL {b.MONTHS} MONTH, '%Y-%m-%d') || ' to {b.AS_OF}' AS period"
        " FROM (SELECT DISTINCT repo_id FROM b_tags UNION ALL SELECT 'none') s"
        " LEFT JOIN (SELECT repo_id, count(DISTINCT path) AS n FROM win GROUP BY ALL) t ON t.repo_id = s.repo_id)"
        " USING (repo_id)",
    ),
    "cached_summary": _sql(_SUFFIX_SPOTS, _summary(True)),
    "report_ranked": _sql(
        _RANKS,
        'SELECT repo_id, rank_position AS "Rank", file AS "File", pagerank_score AS "PageRank Score",'
        ' centrality AS "Centrality" FROM ranked',
    ),
    "report_churn": _sql(
        _WINDOW,
        'SELECT repo_id, position AS "#", filename AS "File", commits AS "Commits", total_churn AS "Total Churn",'
        ' lines_added AS "Lines Added", removed_lines AS "Lines Removed", total_contributor AS "Contributors" FROM churn',
    ),
    "report_hotspots": _sql(
        _SUFFIX_SPOTS,
        'SELECT repo_id, file AS "File", hotspot_score AS "Hotspot Score", pagerank_score AS "PageRank",'
        ' commits AS "Commits", total_churn AS "Total Churn", centrality AS "Centrality" FROM spots',
    ),
    "result_entries": _sql(
        _SUFFIX_SPOTS + _PATHS,
        "SELECT * FROM (SELECT repo_id, 'ranked_files' AS section, CAST(rank_position AS BIGINT) AS position, rank_position, file,"
        " pagerank_score, centrality FROM ranked UNION ALL BY NAME"
        " SELECT repo_id, 'nodes' AS section, file AS id, round(rank, 6) AS pagerank, round(centrality, 6) AS centrality FROM ranks"
        " UNION ALL BY NAME SELECT repo_id, 'edges' AS section, source, target, round(weight, 4) AS weight, ident FROM e"
        " UNION ALL BY NAME SELECT 'tree' AS section, * FROM tree"
        " UNION ALL BY NAME SELECT repo_id, 'symbols' AS section, path, line, name FROM b_tags WHERE kind = 'def'"
        " UNION ALL BY NAME SELECT repo_id, 'hotspots' AS section, row_number() OVER (PARTITION BY repo_id"
        " ORDER BY hotspot_score DESC, rank_position, file) AS position, file, pagerank_score, centrality, commits, total_churn,"
        " hotspot_score FROM spots)",
    ),
    "result_summaries": _sql(
        _SUFFIX_SPOTS,
        "SELECT repo_id, repo_id AS repo_name, concat('https://github.com/org/', repo_id) AS repo_url, file_count, graph_nodes,"
        f" graph_edges, hotspot_count, top_hotspot_file, strftime(DATE '{b.AS_OF}' - INTERVAL {b.MONTHS} MONTH, '%Y-%m-%d')"
        f" || ' to {b.AS_OF}' AS period, total_files_with_commits, position, filename, commits, total_contributor, total_churn,"
        f" lines_added FROM ({_summary(False)}) JOIN churn USING (repo_id)"
        " JOIN (SELECT repo_id, count(DISTINCT path) AS total_files_with_commits FROM win GROUP BY ALL) USING (repo_id)",
    ),
    "result_sections": _sql(
        _SUFFIX_SPOTS + _PATHS + [("sections", _SECTIONS)],
        "SELECT repo_id, section, CAST(n AS BIGINT) AS entries, CAST(rp AS BIGINT) AS rank_position,"
        " CAST(tc AS BIGINT) AS total_churn, CAST(sc AS BIGINT) AS symbol_count, CAST(l AS BIGINT) AS line,"
        " CAST(fc AS BIGINT) AS file_count FROM sections",
    ),
}
