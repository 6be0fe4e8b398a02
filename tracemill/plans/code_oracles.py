"""SQL for an independent engine: the queries of `code_queries` and those of `queries` on code. Inputs come from `generated`; rules are written out."""

from __future__ import annotations

from ..sources import generated as G
from .oracles import GRAPH, ORACLES

EXTENSION = r"lower(regexp_extract({0}, '[^/]\.([^./]*)/*$', 1))"
LANGUAGE = f"CASE {EXTENSION} WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' ELSE 'unknown' END"
SHORT = "CASE WHEN {0} LIKE 'src/%' THEN CASE WHEN strpos(substr({0}, 5), '/') > 0 THEN 'src/' || split_part({0}, '/', 2) ELSE 'src' END ELSE split_part({0}, '/', 1) END"
CLEAN = r"regexp_replace(regexp_replace({0}, '^(\./)+', ''), '^/+', '')"
CLUSTER = f"CASE WHEN split_part({CLEAN}, '/', 1) IN ('src', 'lib', 'bin', 'tests') AND contains({CLEAN}, '/') THEN split_part({CLEAN}, '/', 2) ELSE split_part({CLEAN}, '/', 1) END"
DIR = r"regexp_extract(rtrim({0}, '/'), '^(.*)/[^/]*$', 1)"
LEAF = r"regexp_extract(rtrim({0}, '/'), '([^/]*)$', 1)"
RUST = rf"CASE WHEN {DIR} LIKE 'src/%' AND split_part({DIR}, '/', 2) <> '' THEN split_part({DIR}, '/', 2) WHEN {DIR} LIKE '%src' THEN regexp_replace({LEAF}, '(.)\.[^.]*$', '\1') END"
LEFT = "list_filter(string_split({0}, '/'), lambda x: x NOT IN ('', 'src', 'lib', 'app'))"
JOINED = f"array_to_string(CASE WHEN {{0}} LIKE '/%' THEN list_concat(['/'], {LEFT}) ELSE {LEFT} END, '/')"
OTHER = rf"CASE WHEN len({LEFT}) > 0 OR {{0}} LIKE '/%' THEN regexp_replace({JOINED}, '\.[^.]*$', '') END"
SCOPE = r"CASE WHEN contains({0}, '/') THEN regexp_extract({0}, '^(.*)/[^/]*$', 1) ELSE '' END"
PATHS = f"paths AS ({G.PATHS})"

LINES = rf"""src AS ({G.SOURCES}), text AS (SELECT project, file, unnest([first_line, '', second_line]) AS line FROM src),
l0 AS (SELECT project, file, trim(line) AS c, string_split(regexp_replace(substr(trim(line), 5), ';+$', ''), '::') AS p FROM text),
imp AS (SELECT project, file, CASE WHEN c LIKE 'use %' THEN CASE WHEN len(p) >= 2 AND p[1] IN ('crate', 'self', 'super') THEN array_to_string(p[2:], '/') WHEN NOT contains(p[1], '{{') THEN array_to_string(p, '/') END
  WHEN c LIKE 'from %' OR c LIKE 'import %' THEN replace(regexp_split_to_array(c, '\s+')[2], '.', '/')
  WHEN regexp_matches(c, 'require\([^)]*\)') THEN regexp_replace(trim(regexp_extract(c, 'require\(([^)]*)\)', 1)), '^[''"`]+|[''"`]+$', '', 'g') END AS i FROM l0),
imports AS (SELECT * FROM imp WHERE i IS NOT NULL)"""

LAST = ("eval0 AS (SELECT o_custkey AS task_id, o_orderkey AS e, o_orderdate AS d, o_orderstatus <> 'P' AS has, o_orderpriority <> '5-LOW' AS full_, count(*)::DOUBLE AS n, sum(l_suppkey)::DOUBLE AS tokens, sum(l_partkey)::DOUBLE AS ms, "
  "count(*) FILTER (l_returnflag = 'R')::DOUBLE AS r, count(*) FILTER (l_linestatus = 'F')::DOUBLE AS f, count(*) FILTER (l_suppkey % 2 = 0)::DOUBLE AS even, count(*) FILTER (l_partkey % 3 = 0)::DOUBLE AS third, "
  "count(*) FILTER (l_returnflag = 'A')::DOUBLE AS a FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), "
  "eval1 AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY d DESC, e DESC) AS k FROM eval0), "
  "vals AS (SELECT task_id, k, e, unnest([{'metric': 'n_toolcalls', 'x': CASE WHEN has THEN n END, 'low': false}, {'metric': 'n_tokens', 'x': CASE WHEN has THEN tokens END, 'low': false}, {'metric': 'duration_ms', 'x': CASE WHEN has THEN ms END, 'low': false}, "
  "{'metric': 'tool_entropy', 'x': CASE WHEN has AND full_ THEN r / n END, 'low': true}, {'metric': 'phase_entropy', 'x': CASE WHEN has AND full_ THEN f / n END, 'low': true}, {'metric': 'loop_ratio', 'x': CASE WHEN has AND full_ THEN even / n END, 'low': true}, "
  "{'metric': 'backtrack_ratio', 'x': CASE WHEN has AND full_ THEN third / n END, 'low': true}, {'metric': 'state_stability_score', 'x': CASE WHEN has AND full_ THEN a / n END, 'low': false}, {'metric': 'additions', 'x': f, 'low': false}, {'metric': 'deletions', 'x': r, 'low': false}], recursive := true) FROM eval1 WHERE k <= 2)")  # fmt: skip


def files(path: str) -> str:
    return f"files AS (SELECT o_orderkey AS diff_id, {path} AS file, {G.CHANGES} AS change, {G.STARTS[0]} AS a, {G.STARTS[1]} AS b, {G.NAME} AS name FROM orders)"


def hunks(lines: str, path: str) -> str:
    return f"""{files(path)}, items AS (SELECT *, hunk_idx AS k, hunk_idx - min(hunk_idx) OVER (PARTITION BY diff_id) AS h, CASE line_kind WHEN 'add' THEN '+' WHEN 'del' THEN '-' ELSE ' ' END || content AS line FROM ({lines})),
dl AS (SELECT diff_id, file, change, {LANGUAGE.format('file')} AS language, h AS hunk_idx, a + 100 * k AS old_start, b + 100 * k AS new_start,
  CAST(row_number() OVER w - 1 AS INTEGER) AS line_idx, line_kind, content, symbol, shape, row_number() OVER w AS pos,
  CASE line_kind WHEN 'del' THEN a + 100 * k + count(*) FILTER (line_kind <> 'add') OVER w - 1 ELSE b + 100 * k + count(*) FILTER (line_kind <> 'del') OVER w - 1 END AS line_no
  FROM items JOIN files USING (diff_id) WINDOW w AS (PARTITION BY diff_id, k ORDER BY n, line ROWS UNBOUNDED PRECEDING))"""


FILES, HUNKS = files(G.path_of("o_orderkey")), hunks(G.HUNK_LINES, G.path_of("o_orderkey"))
RAW = f"""{HUNKS}, raw0 AS (SELECT diff_id, file, language, hunk_idx, line_idx, CAST(CASE line_kind WHEN 'add' THEN new_start ELSE old_start END AS INTEGER) AS line_start, CASE line_kind WHEN 'add' THEN 'function_added' ELSE 'function_removed' END AS change_type, symbol, content, line_kind = 'del' AS gone
  FROM dl WHERE shape = 0 AND language = 'rust' AND line_kind <> 'ctx'),
raw1 AS (SELECT *, 'rc_' || lpad((row_number() OVER (PARTITION BY diff_id ORDER BY hunk_idx, gone, line_idx))::VARCHAR, 5, '0') AS change_id FROM raw0),
raw AS (SELECT * FROM raw1 QUALIFY row_number() OVER (PARTITION BY diff_id, file, line_start, symbol, change_type ORDER BY hunk_idx, gone, line_idx) = 1)"""
RULES = f"""{RAW}, hits AS (SELECT diff_id, change_id, symbol, unnest(list_filter([CASE WHEN contains(symbol, 'login') THEN {{'rule_id': 'sec_auth_001', 'category': 'security', 'severity': 'high'}} END,
  CASE WHEN contains(symbol, 'hash') THEN {{'rule_id': 'sec_crypto_001', 'category': 'security', 'severity': 'high'}} END, CASE WHEN contains(symbol, 'token') THEN {{'rule_id': 'sec_token_001', 'category': 'security', 'severity': 'high'}} END,
  CASE WHEN change_type = 'function_removed' AND NOT contains(symbol, 'test') THEN {{'rule_id': 'breaking_001', 'category': 'breaking', 'severity': 'high'}} END,
  CASE WHEN contains(lower(file), 'test') THEN {{'rule_id': 'misc_test_001', 'category': 'domain', 'severity': 'low'}} END], lambda x: x IS NOT NULL), recursive := true) FROM raw)"""
CLUSTERS = f"""{PATHS}, sym AS (SELECT project, path, l_returnflag <> 'R' AS hot, 1 AS n FROM lineitem JOIN paths ON n = l_orderkey), chg AS (SELECT project, path, true AS hot, 0 AS n FROM paths WHERE n % 3 = 0),
tasks AS (SELECT o_custkey AS project, 'm' || (o_orderkey % 7) AS module, count(*) AS n_tasks FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
g AS (SELECT project, {CLUSTER.format('path')} AS module, sum(n)::BIGINT AS n_symbols, bool_or(hot) AS hot FROM (SELECT * FROM sym UNION ALL SELECT * FROM chg) GROUP BY ALL),
clusters AS (SELECT project, module, n_symbols, coalesce(n_tasks, 0) AS n_tasks, CASE WHEN hot THEN 'Changed' WHEN coalesce(n_tasks, 0) > 0 THEN 'Active' ELSE 'Cold' END AS cluster_type FROM g LEFT JOIN tasks USING (project, module))"""
LINKS = """s AS (SELECT DISTINCT l_orderkey AS project, 'm' || l_suppkey AS module, l_partkey % 5 AS f FROM lineitem),
links AS (SELECT DISTINCT a.project, a.module, b.module AS other, 0.5::DOUBLE AS strength FROM s a JOIN s b ON a.project = b.project AND a.f = b.f AND a.module < b.module)"""
FLOWS = "flows AS (SELECT (['high', 'medium', 'low', 'odd'])[o_orderkey % 4 + 1] AS risk_level, CASE WHEN o_orderkey % 11 <> 0 THEN 'e' || o_custkey END AS entry FROM orders)"
RUNS = "runs AS (SELECT l_orderkey AS suite, l_linenumber AS run, (['Ok', 'Skipped', 'Failed', 'TimedOut', 'Ok'])[l_partkey % 5 + 1] AS status, CASE WHEN l_suppkey % 2 = 0 THEN 'e' || l_suppkey END AS detail FROM lineitem)"
TURNS = "turns AS (SELECT conv_id AS conv, CAST(turn AS INTEGER) AS turn, role, coalesce(text, '') AS text FROM conversations)"
MOVE1 = "CASE i WHEN 0 THEN 3 WHEN 3 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 5 END"
MOVE2 = "CASE WHEN {0} = 5 THEN 2 WHEN {0} < 6 THEN {0} END"

ORACLES |= {
    "file_modules": f"""WITH {PATHS} SELECT path, count(*) AS n, {SHORT.format('path')} AS short, CASE WHEN path LIKE 'src/%' THEN 'src/' || split_part(path, '/', 2) WHEN path LIKE 'crates/%/%' THEN 'crates/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) ELSE path END AS "full",
      CASE WHEN path LIKE 'src/%' OR path LIKE 'crates/%' THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE '.' END AS "group", {CLUSTER.format('path')} AS cluster_module, CASE WHEN {LANGUAGE.format('path')} = 'rust' THEN {RUST.format('path')} ELSE {OTHER.format('path')} END AS symbol_module,
      {SCOPE.format('path')} AS scope, CASE regexp_extract(path, '(\\.[^.]*)$', 1) WHEN '.rs' THEN 'rust' WHEN '.py' THEN 'python' WHEN '.mjs' THEN 'other' WHEN '.go' THEN 'go' WHEN '.md' THEN 'doc' WHEN '' THEN CASE WHEN contains(path, 'src/') THEN 'src' WHEN contains(path, 'tests/') THEN 'test' ELSE 'other' END ELSE 'other' END AS cluster,
      {LANGUAGE.format('path')} AS language, path LIKE '%main.rs' OR path LIKE '%main.go' OR path LIKE '%main.py' OR path LIKE '%index.ts' OR path LIKE '%app.ts' OR path = 'src/bin' AS entry FROM paths GROUP BY path""",
    "import_lines": f"WITH {LINES} SELECT i AS import, count(*) AS n FROM imports GROUP BY ALL",
    "import_edges": f"""WITH {LINES}, mods AS (SELECT DISTINCT project, {SHORT.format('file')} AS m FROM src), e AS (SELECT i.project, {SHORT.format('file')} AS s, m FROM imports i JOIN mods USING (project) WHERE starts_with(i.i, m) OR contains(m, i.i))
      SELECT project, least(s, m) AS a, greatest(s, m) AS b, least(count(*), 10)::DOUBLE AS weight FROM e WHERE s <> m GROUP BY ALL""",
    "flow_phases": """WITH x AS (SELECT (['readAll', 'ParseIt', 'validate', 'double_check', 'saveRow', 'to_DB', 'Display', 'render_main', 'cli', 'order_handler', 'worker_x', 'compute'])[o_orderkey % 12 + 1] || o_custkey AS node FROM orders)
      SELECT node, count(*) AS n, CASE WHEN regexp_matches(lower(node), 'read|parse|input') THEN 'input' WHEN regexp_matches(lower(node), 'valid|check|verify') THEN 'validation' WHEN regexp_matches(lower(node), 'save|write|store|db') THEN 'persistence' WHEN regexp_matches(lower(node), 'output|print|render|display') THEN 'output' ELSE 'business_logic' END AS phase,
      CASE WHEN regexp_matches(node, 'main|cli') THEN 'CLI' WHEN regexp_matches(node, 'handler|route|controller') THEN 'HTTP' WHEN regexp_matches(node, 'consumer|worker') THEN 'MQ' ELSE 'CLI' END AS trigger FROM x GROUP BY ALL""",
    "eval_metrics": f"""WITH {LAST}, c AS (SELECT a.task_id, a.e AS from_eval, b.e AS to_eval, a.metric, a.x AS p, b.x AS q, a.low, CASE WHEN a.x = 0 THEN CASE WHEN b.x = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END ELSE (b.x - a.x) / a.x * 100.0::DOUBLE END AS pct FROM vals a JOIN vals b ON a.task_id = b.task_id AND a.k = 2 AND b.k = 1 AND a.metric = b.metric WHERE a.x IS NOT NULL AND b.x IS NOT NULL)
      SELECT task_id, from_eval, to_eval, metric, round(p, 4) AS from_value, round(q, 4) AS to_value, round(pct, 4) AS change_pct, CASE WHEN pct > 5.0::DOUBLE THEN CASE WHEN low THEN 'Down' ELSE 'Up' END WHEN pct < -5.0::DOUBLE THEN CASE WHEN low THEN 'Up' ELSE 'Down' END ELSE 'Flat' END AS direction FROM c""",
    "graph_metrics": f"""WITH {GRAPH}, n AS (SELECT trace_id, count(*) AS path_length FROM states GROUP BY ALL), t AS (SELECT trace_id, primary_phase AS a, lead(primary_phase) OVER (PARTITION BY trace_id ORDER BY state_idx) AS b FROM states),
      e AS (SELECT trace_id, count(*) / sum(count(*)) OVER (PARTITION BY trace_id) AS p FROM t WHERE b IS NOT NULL GROUP BY trace_id, a, b), h AS (SELECT trace_id, sum(-p * log2(p)) AS structural_entropy FROM e GROUP BY ALL)
      SELECT trace_id, path_length, path_length AS state_count, round(coalesce(structural_entropy, 0), 6) AS structural_entropy FROM n LEFT JOIN h USING (trace_id)""",
    "phase_distribution": f"WITH {GRAPH} SELECT d.trace_id, d.candidate_idx, c.category AS phase, round(count(*)::DOUBLE / (max(d.last_idx - d.first_idx) + 1), 6) AS share FROM cands d JOIN calls c ON c.trace_id = d.trace_id AND c.idx BETWEEN d.first_idx AND d.last_idx GROUP BY ALL",
    "module_clusters": f"WITH {CLUSTERS} SELECT * FROM clusters",
    "cluster_links": f"WITH {LINKS} SELECT * FROM links",
    "cluster_summary": f"""WITH {CLUSTERS}, {LINKS}, m AS (SELECT project, avg(strength) AS c FROM links GROUP BY ALL) SELECT project, count(*) AS n_modules, count(*) FILTER (cluster_type = 'Changed') AS n_changed, count(*) FILTER (cluster_type = 'Active') AS n_active,
      count(*) FILTER (cluster_type = 'Cold') AS n_cold, coalesce(any_value(c), 0) AS avg_coupling FROM clusters LEFT JOIN m USING (project) GROUP BY project""",
    "module_changes": f"WITH {PATHS} SELECT {SHORT.format('path')} AS module, count(*) AS n_changes FROM paths GROUP BY ALL",
    "module_discovery": f"""WITH {PATHS}, p AS (SELECT CASE WHEN n % 9 = 0 THEN (['api/', 'models/', 'db/', 'config/', 'utils/'])[n % 5 + 1] ELSE '' END || path AS path FROM paths), m AS (SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS module FROM p)
      SELECT module, count(*) AS n_files, CASE module WHEN 'api' THEN 'API' WHEN 'models' THEN 'Domain' WHEN 'db' THEN 'Storage' WHEN 'config' THEN 'Infrastructure' WHEN 'utils' THEN 'Utility' ELSE 'Service' END AS category FROM m GROUP BY ALL""",
    "flow_risks": f"WITH {FLOWS} SELECT CASE risk_level WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS n FROM flows GROUP BY ALL",
    "top_entries": f"WITH {FLOWS} SELECT entry AS entry_point, count(*) AS n FROM flows WHERE entry IS NOT NULL GROUP BY ALL ORDER BY n DESC, entry LIMIT 3",
    "review_stats": "SELECT o_custkey AS capability, count(*) AS total, count(*) FILTER (o_orderkey % 4 = 0) AS approved, count(*) FILTER (o_orderkey % 4 = 1) AS rejected, count(*) FILTER (o_orderkey % 4 = 2) AS corrected, count(*) FILTER (o_orderkey % 4 = 3) AS flagged FROM orders GROUP BY ALL",
    "test_map_stats": "SELECT count(DISTINCT l_partkey) AS mapped, count(*) FILTER (l_returnflag = 'A') AS passing, count(*) FILTER (l_returnflag = 'R') AS failing, count(*) FILTER (l_returnflag NOT IN ('A', 'R') AND l_linestatus = 'O') AS missing FROM lineitem",
    "degradation": f"WITH {RUNS} SELECT suite, count(*) AS total, count(*) FILTER (status = 'Ok') AS n_ok, count(*) FILTER (status = 'Skipped') AS n_skipped, count(*) FILTER (status IN ('Failed', 'TimedOut')) AS n_failed, round(count(*) FILTER (status = 'Ok')::DOUBLE / count(*), 6) AS ok_share FROM runs GROUP BY ALL",
    "degradation_reasons": f"WITH {RUNS} SELECT suite, run, CASE status WHEN 'Skipped' THEN 'skipped' ELSE 'failed' END AS status, CASE status WHEN 'Skipped' THEN 'Upstream dependency failed' ELSE coalesce(detail, 'Unknown error') END AS reason FROM runs WHERE status <> 'Ok'",
    "registry_reproject": f"""WITH v AS (SELECT l_orderkey, l_orderkey % 4 + 1 AS version, l_linenumber AS k, l_partkey % 8 AS i, l_suppkey AS x FROM lineitem), m1 AS (SELECT *, CASE version WHEN 1 THEN {MOVE1} ELSE i END AS j FROM v),
      m2 AS (SELECT *, CASE WHEN version <= 2 THEN {MOVE2.format('j')} ELSE j END AS z FROM m1)
      SELECT l_orderkey, 4 AS registry_version, coalesce(string_agg(z::VARCHAR, ',' ORDER BY k, i, x) FILTER (z IS NOT NULL), '') AS indices, coalesce(string_agg(x::VARCHAR, ',' ORDER BY k, i, x) FILTER (z IS NOT NULL), '') AS "values" FROM m2 GROUP BY l_orderkey""",
    "schema_compat": "WITH s AS (SELECT p_partkey AS skill, p_size % 12 AS k, p_partkey % 3 AS v FROM part) SELECT skill, 'in' || k AS input, '1.' || v AS required, CASE WHEN k < 10 THEN '1.' || (k % 2) ELSE '' END AS core_version FROM s WHERE k >= 10 OR v <> k % 2",
    "semver_filter": "WITH q AS (SELECT p_partkey AS skill, (['^0.4', '0.3.9', '~0.4.1', '>=0.3, <0.5', '=0.4', '<=0.3', '>0.4.0', '*', '0.*', '^1', 'oops', '0', '<0.4.2', '>0.4', '=0.4.2', '~0'])[p_partkey % 16 + 1] AS requirement FROM part) SELECT * FROM q WHERE requirement IN ('^0.4', '~0.4.1', '>=0.3, <0.5', '=0.4', '>0.4.0', '*', '0.*', '0', '=0.4.2', '~0')",
    "trace_by_session": "SELECT o_orderkey AS trace_id, o_custkey AS session_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS position FROM orders",
    "trace_by_id": "SELECT id, version FROM (SELECT o_custkey AS id, o_orderkey AS version, o_orderstatus AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) WHERE s <> 'P' AND id IN (SELECT s_suppkey FROM supplier)",
    "diff_cache_latest": "SELECT l_partkey AS trace_a, l_suppkey AS trace_b, l_orderkey * 10 + l_linenumber AS diff_id FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1",
    "diff_lines": f"WITH {HUNKS} SELECT diff_id, file, change, language, hunk_idx, line_idx, line_kind, content, line_no FROM dl",
    "diff_summary_lang": f"WITH {HUNKS} SELECT diff_id, language, 1 AS n_files, count(*) FILTER (line_kind = 'add') AS additions, count(*) FILTER (line_kind = 'del') AS deletions FROM dl GROUP BY ALL",
    "raw_changes": f"WITH {RAW} SELECT diff_id, change_id, file, language, line_start, change_type, symbol, 1.0::DOUBLE AS confidence, content FROM raw",
    "rule_matches": f"WITH {RULES} SELECT diff_id, change_id, symbol, rule_id, category, severity FROM hits",
    "capability_status": f"""WITH {RULES}, c AS (SELECT diff_id, change_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM hits GROUP BY ALL)
      SELECT diff_id, change_id, symbol AS name, CASE change_type WHEN 'function_added' THEN 'added' ELSE 'removed' END AS status, coalesce(categories, '') AS categories FROM raw LEFT JOIN c USING (diff_id, change_id)""",
    "file_tree": f"""WITH {FILES}, p AS (SELECT DISTINCT string_split(file, '/') AS p FROM files JOIN (SELECT DISTINCT l_orderkey AS diff_id FROM lineitem) USING (diff_id)), n AS (SELECT p, unnest(range(len(p))) AS depth FROM p)
      SELECT array_to_string(p[1:depth + 1], '/') AS node, CASE WHEN depth = 0 THEN '' ELSE array_to_string(p[1:depth], '/') END AS parent, depth, bool_or(len(p) = depth + 1) AS is_file FROM n GROUP BY ALL""",
    "behaviour_boundaries": f"""WITH {FILES}, h AS (SELECT l_orderkey AS diff_id, CASE WHEN l_linenumber <= 4 THEN 0 ELSE 1 END AS k, count(*) AS n FROM lineitem GROUP BY ALL), first AS (SELECT diff_id, n FROM h WHERE k = 0)
      SELECT diff_id, CAST(CASE change WHEN 'modified' THEN 3 WHEN 'renamed' THEN 5 ELSE 4 END + CASE WHEN k = 1 AND first.n IS NOT NULL THEN 1 + first.n ELSE 0 END AS INTEGER) AS "at", name, split_part(name, '.', 1) AS module, name IN ('serve', 'parseIt', 'api.Log_it') AS behavioural, CASE name WHEN 'log_metrics' THEN 'logging' WHEN 'x.y.trace_format' THEN 'tracing' WHEN 'fmt.reformat' THEN 'formatting' WHEN 'lru_cache' THEN 'cache' WHEN 'debug.on' THEN 'internal' END AS reason FROM h JOIN files USING (diff_id) LEFT JOIN first USING (diff_id)""",
    "log_completions": f"""WITH {TURNS} SELECT conv AS source, 'c' || conv || '-' || turn AS session_id, md5(text) AS digest, strftime(make_timestamp((1700000000 + conv * 60 + turn) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS started_at, length(text)::BIGINT AS tokens_in, 1 AS n_calls,
      CASE WHEN turn % 2 = 0 THEN 'read' ELSE 'edit' END AS tool, CASE WHEN turn % 3 <> 0 THEN 'src/f' || turn || '.rs' END AS path FROM turns""",
    "log_import_stats": f"WITH {TURNS} SELECT count(*) AS imported, count(DISTINCT CASE WHEN conv % 10 = 0 THEN conv END) AS skipped FROM turns",
    "log_formats": f"WITH {TURNS}, c AS (SELECT DISTINCT (['openai', 'run_log', 'session', 'session_lines', NULL, 'deepseek'])[conv % 6 + 1] AS format, conv FROM turns) SELECT format, count(*) AS n FROM c GROUP BY ALL",
    "log_run_turns": f"WITH {TURNS} SELECT 'run' || conv AS session_id, count(*) AS n_turns, count(*) AS n_calls, '2024-01-01T00:00:' || lpad(min(turn)::VARCHAR, 2, '0') || 'Z' AS started_at, min('p' || role) AS prompt FROM turns WHERE conv % 7 <> 0 GROUP BY conv",
    "log_sessions": f"""WITH {TURNS} SELECT conv::VARCHAR AS session_id, md5(coalesce(arg_min(text, turn) FILTER (role = 'user'), '')) AS prompt_digest, CAST(count(*) FILTER (role <> 'user') AS INTEGER) AS n_calls, coalesce('d/f' || min(turn) FILTER (role <> 'user'), '') AS first_path FROM turns GROUP BY conv""",
}

GREW = "CASE WHEN a.{0} = 0 THEN CASE WHEN b.{0} = 0 THEN 0.0 ELSE 100.0 END ELSE (b.{0} - a.{0}) / a.{0} * 100.0 END > {1}"
BOTH = "a.has AND b.has"
FULL = "a.has AND b.has AND a.full_ AND b.full_"
FROM_PATH = (
    "CASE WHEN file LIKE 'src/%' THEN 'src/' || split_part(file, '/', 2) WHEN file LIKE 'crates/%/%' "
    "THEN 'crates/' || split_part(file, '/', 2) || '/' || split_part(file, '/', 3) ELSE file END"
)
EXPORTED = f"""{HUNKS}, exported AS (SELECT diff_id, file, {FROM_PATH} AS module, CASE shape WHEN 0 THEN symbol ELSE 'gone' END AS name, 'fn' AS kind,
  CASE line_kind WHEN 'add' THEN 'added' ELSE 'removed' END AS action, CAST(new_start + line_idx + 1 AS BIGINT) AS line
  FROM dl WHERE line_kind <> 'ctx' AND shape <> 1 AND file NOT LIKE '%.py' AND file NOT LIKE '%.go'),
daily AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS diff_id, module, action FROM exported e JOIN orders ON o_orderkey = e.diff_id)"""

ORACLES |= {
    "degrade_rules": f"""WITH {LAST}, c AS (SELECT a.task_id, a.e AS from_eval, b.e AS to_eval, {BOTH} AND {GREW.format('n', 100)} AS r1, {BOTH} AND {GREW.format('ms', 100)} AS r2,
      {BOTH} AND {GREW.format('tokens', 200)} AS r3, {FULL} AND a.third > 0 AND b.third = 0 AS r4, {GREW.format('r', 0)} AS r5, {FULL} AND round((a.a / a.n - b.a / b.n) * 100, 6) > 30 AS r6
      FROM eval1 a JOIN eval1 b ON a.task_id = b.task_id AND a.k = 2 AND b.k = 1)
      SELECT task_id, from_eval, to_eval, concat_ws(',', CASE WHEN r1 THEN 'R001' END, CASE WHEN r2 THEN 'R002' END, CASE WHEN r3 THEN 'R003' END, CASE WHEN r4 THEN 'R004' END,
      CASE WHEN r5 THEN 'R005' END, CASE WHEN r6 THEN 'R006' END) AS rules, CASE WHEN r4 THEN 'Degraded' WHEN r1 OR r2 OR r3 OR r5 THEN 'Watch' ELSE 'Pass' END AS verdict FROM c""",
    "export_symbols": f"WITH {EXPORTED} SELECT * FROM exported",
    "export_modules": f"""WITH {EXPORTED} SELECT diff_id, module, count(*) FILTER (action = 'added') AS n_added, count(*) FILTER (action = 'removed') AS n_removed
      FROM daily GROUP BY ALL""",
    "export_impact": f"""WITH {EXPORTED}, m AS (SELECT DISTINCT diff_id, module FROM daily) SELECT a.diff_id, a.module, b.module AS other, 1 AS strength
      FROM m a JOIN m b ON a.diff_id = b.diff_id AND a.module < b.module""",
}
__all__ = ["ORACLES"]
