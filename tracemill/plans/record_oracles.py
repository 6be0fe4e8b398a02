"""SQL for an independent engine: the queries of `record_queries`. Inputs come from `generated`; rules are written out."""

from __future__ import annotations

from ..sources import generated as G
from .code_oracles import FROM_PATH, ORACLES, hunks
from .code_oracles import RUNS as CODE_RUNS
from .oracles import CALLS, CATEGORIES, COUPLING, DAG, FULL, GRAPH, MATCH, RUNS, TRACES, VECTOR, pairs

LOST = "lost AS (SELECT graph, node FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.graph = e.graph AND n.node = e.dep) UNION SELECT e.graph, e.node FROM lost b JOIN edges e ON e.graph = b.graph AND e.dep = b.node)"
WALK = "walk AS (SELECT graph, node, 0 AS layer FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph = n.graph AND e.node = n.node) UNION SELECT e.graph, e.node, w.layer + 1 FROM walk w JOIN edges e ON e.graph = w.graph AND e.dep = w.node WHERE w.layer < 20)"
LAYERS = f"{WALK}, tops AS (SELECT graph, node, max(layer) AS layer FROM walk GROUP BY ALL), {LOST}, lay AS (SELECT n.graph, n.node, CAST(CASE WHEN (n.graph, n.node) IN (SELECT (graph, node) FROM lost) THEN -1 ELSE coalesce(t.layer, -1) END AS INTEGER) AS layer FROM nodes n LEFT JOIN tops t USING (graph, node))"


def run_layer(k: int) -> str:
    """Skills of layer k, after those of the layers before."""
    before = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(k)) or "SELECT '' AS graph, '' AS node, '' AS status, 0 AS output, 0 AS finished_ms WHERE false"
    up = f"SELECT e.graph, e.node, count(*) FILTER (u.status IS DISTINCT FROM 'ok') AS bad, count(u.output) AS n_inputs, sum(u.output)::BIGINT AS inputs, max(u.finished_ms)::BIGINT AS ready_ms FROM edges e LEFT JOIN ({before}) u ON u.graph = e.graph AND u.node = e.dep GROUP BY ALL"
    return f"""s{k} AS (SELECT graph, node, layer, CASE WHEN reason IS NULL THEN outcome ELSE 'skipped' END AS status, reason, coalesce(n_inputs, 0) AS n_inputs, inputs, ready_ms,
      CASE WHEN reason IS NULL AND outcome = 'ok' THEN (own + 31 * coalesce(inputs, 0)) % 1000003 END AS output, CASE WHEN reason IS NULL AND outcome = 'ok' THEN coalesce(ready_ms, 0) + own % 100 + 1 END AS finished_ms
      FROM (SELECT s.*, l.layer, u.* EXCLUDE (graph, node), CASE WHEN u.bad > 0 THEN 'upstream_skip' WHEN NOT (version = '1.0' AND input IN ('in0', 'in1', 'in2', 'in3')) THEN 'no_compat_path' END AS reason
        FROM skills s JOIN lay l USING (graph, node) LEFT JOIN ({up}) u USING (graph, node) WHERE l.layer = {k}))"""


DEPTH = 7
ORACLES |= {
    "impact_analysis": f"""WITH RECURSIVE edges AS ({G.CALLED}), starts AS ({G.CALLERS}), r AS (SELECT DISTINCT graph, node AS start, node, 0 AS hops FROM starts
      UNION SELECT r.graph, r.start, e.target, r.hops + 1 FROM r JOIN edges e ON e.graph = r.graph AND e.source = r.node WHERE r.hops < 6)
      SELECT graph, start, node, min(hops) AS hops FROM r GROUP BY ALL HAVING min(hops) > 0""",
    "evolution_trace": f"""WITH RECURSIVE links AS ({G.VERSIONS}), walk AS (SELECT id, version, id AS ai, version AS av, [id || '@' || version] AS seen FROM links
      UNION ALL SELECT w.id, w.version, l.from_id, l.from_version, list_append(w.seen, l.from_id || '@' || l.from_version) FROM walk w JOIN links l ON l.id = w.ai AND l.version = w.av WHERE l.from_id IS NOT NULL AND NOT list_contains(w.seen, l.from_id || '@' || l.from_version)),
      last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id, version ORDER BY len(seen) DESC) = 1)
      SELECT last.id, last.version, CAST(len(seen) - 1 AS INTEGER) AS steps, array_to_string(seen, '<') AS path, CASE WHEN l.id IS NULL THEN 'missing' WHEN l.from_id IS NULL THEN 'origin' ELSE 'cycle' END AS ended
      FROM last LEFT JOIN links l ON l.id = last.ai AND l.version = last.av""",
    "skill_run": f"""WITH RECURSIVE {DAG}, skills AS ({G.SKILLS}), {LAYERS}, {", ".join(map(run_layer, range(DEPTH)))}
      {" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(DEPTH))} UNION ALL SELECT graph, node, layer, 'skipped', 'upstream_skip', 0, NULL, NULL, NULL, NULL FROM lay WHERE layer < 0""",
    "document_volumes": """WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes FROM documents), r AS (SELECT *, sum(n_bytes) OVER w AS total, row_number() OVER w AS position FROM d WINDOW w AS (ORDER BY n_bytes DESC, doc_id))
      SELECT doc_id, CAST(n_bytes AS INTEGER) AS n_bytes, total::BIGINT AS running_bytes, (total - n_bytes)::BIGINT // 1000000 + 1 AS file_no, position FROM r""",
    "conversation_files": """WITH c AS (SELECT role, coalesce(strlen(text), 0) AS b, sum(coalesce(strlen(text), 0)) OVER (PARTITION BY role ORDER BY conv_id, turn) AS total FROM conversations)
      SELECT role, (total - b)::BIGINT // 20000 + 1 AS file_no, count(*) AS n, sum(b)::BIGINT AS n_bytes FROM c GROUP BY ALL""",
    "source_budget": f"""WITH p AS ({G.PATHS}), k AS (SELECT *, sum(n % 997) OVER (PARTITION BY project ORDER BY path, n) AS total FROM p WHERE regexp_extract(path, '\\.([^./]*)$', 1) IN ('rs', 'toml', 'md', 'json', 'yaml', 'yml', 'html', 'css', 'js', 'ts', 'py', 'go', 'java', 'c', 'cpp', 'h', 'hpp'))
      SELECT project, path, n, total::BIGINT AS running_bytes FROM k WHERE total <= 4000""",
}


TOOL = [f"tool_{c}" for c in CATEGORIES]
STEP = """CASE WHEN s.q THEN {p: s.p + length(k), o: s.o, q: k <> '"', b: s.b, l: s.l}
  WHEN k IN ('{', '[') THEN {p: s.p + 1, o: CASE k WHEN '{' THEN '}' ELSE ']' END || s.o, q: false, b: CASE WHEN s.o = '' THEN s.p ELSE s.b END, l: s.l}
  WHEN k IN ('}', ']') AND s.o[1] = k THEN {p: s.p + 1, o: s.o[2:], q: false, b: s.b, l: CASE WHEN length(s.o) = 1 THEN list_append(s.l, t[s.b + 1 : s.p + 1]) ELSE s.l END}
  WHEN k IN ('}', ']') THEN {p: s.p + 1, o: '', q: false, b: s.b, l: s.l}
  ELSE {p: s.p + length(k), o: s.o, q: k = '"' AND s.o <> '', b: s.b, l: s.l} END"""
FOLD = f"""walk AS (SELECT conv_id, turn, t, regexp_extract_all(t, '\\\\(?s:.)|["{{}}\\[\\]\\\\]|[^"{{}}\\[\\]\\\\]+') AS ks, 1 AS i, {{p: 0::BIGINT, o: '', q: false, b: 0::BIGINT, l: []::VARCHAR[]}} AS s FROM texts
  UNION ALL SELECT conv_id, turn, t, ks, i + 1, {STEP} FROM (SELECT *, ks[i] AS k FROM walk WHERE i <= len(ks)))"""


def shown(action: str) -> str:
    return f"SELECT l_orderkey AS eval_id, list(struct_pack(name := name, kind := 'function', file := file) ORDER BY name, file) AS l FROM (SELECT l_orderkey, 's' || l_partkey AS name, 'f' || l_suppkey AS file FROM lineitem WHERE (l_returnflag = 'R') = {action == 'removed'} QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY 's' || l_partkey, 'f' || l_suppkey) <= 2) GROUP BY ALL"


RUN_SQL = ORACLES["skill_run"]
ORACLES |= {
    "stream_segments": ORACLES["state_segments"],
    "stored_trials": """WITH r AS (SELECT o_custkey AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position, o_orderkey AS eval_id, CASE o_orderstatus WHEN 'F' THEN 'Pass' WHEN 'O' THEN 'Fail' ELSE 'NotEvaluated' END AS outcome, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS version FROM orders) SELECT * FROM r""",
    "tasks_view": """SELECT c_custkey AS id, to_json(struct_pack(id := c_custkey, description := 'task of ' || c_name, category := CASE c_custkey % 6 WHEN 0 THEN 'bug_fix' WHEN 1 THEN 'refactor' WHEN 2 THEN 'test' WHEN 3 THEN 'doc' WHEN 4 THEN 'feature' ELSE 'general' END, modules := [lower(c_mktsegment), 'core'], success_criteria := ['balance over ' || floor(c_acctbal)::BIGINT, 'tests pass']))::VARCHAR AS json FROM customer""",
    "trials_view": f"""WITH n AS (SELECT l_orderkey AS eval_id, count(*) AS n, sum(l_suppkey)::BIGINT AS tokens, count(*) FILTER (l_returnflag = 'R') AS gone FROM lineitem GROUP BY ALL),
      e AS (SELECT o_custkey AS task_id, o_orderkey AS eval_id, trial_index, o_orderstatus AS outcome, strftime(o_orderdate, '%Y-%m-%d') AS created_at, n.* EXCLUDE (eval_id) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS trial_index FROM orders) JOIN n ON n.eval_id = o_orderkey),
      g AS (SELECT eval_id, list(struct_pack(name := name, passed := passed) ORDER BY name, passed) AS l FROM (SELECT l_orderkey AS eval_id, 'g' || l_linenumber AS name, l_returnflag <> 'R' AS passed FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY 'g' || l_linenumber, l_returnflag <> 'R') <= 2) GROUP BY ALL), p AS ({shown('added')}), m AS ({shown('removed')}),
      d AS (SELECT task_id, e.eval_id, trial_index, struct_pack(trial_index := trial_index, eval_id := e.eval_id, outcome := outcome, grader_results := coalesce(g.l, []), tool_pattern := CASE WHEN outcome <> 'P' THEN struct_pack(total_tool_calls := n, total_tokens := tokens) END,
        code_change := struct_pack(files := 1, additions := n - gone, deletions := gone, modules := ['m' || e.eval_id % 7], symbols_added := coalesce(p.l, []), symbols_removed := coalesce(m.l, [])), created_at := created_at, task := struct_pack(id := task_id, description := 'task ' || task_id)) AS doc
        FROM e LEFT JOIN g USING (eval_id) LEFT JOIN p USING (eval_id) LEFT JOIN m USING (eval_id) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY trial_index DESC) <= 3),
      t AS (SELECT task_id, to_json(struct_pack(task_id := task_id, trials := list(doc ORDER BY trial_index)))::VARCHAR AS json FROM d GROUP BY task_id), k AS (SELECT task_id, count(*) AS n_trials FROM e GROUP BY ALL)
      SELECT task_id, n_trials, md5(json) AS digest, length(json)::INTEGER AS n_chars FROM t JOIN k USING (task_id)""",
    "capability_nodes": "SELECT l_orderkey AS change, l_linenumber::INTEGER AS ordinal, 'f' || (l_suppkey % 3) || '::s' || l_partkey AS id, 's' || l_partkey AS name, 'function' AS kind, 'f' || (l_suppkey % 3) AS file, CASE WHEN l_returnflag = 'R' THEN 'removed' ELSE 'added' END AS action FROM lineitem",
    "capability_links": "SELECT a.l_orderkey AS change, 'f' || (a.l_suppkey % 3) || '::s' || a.l_partkey AS source, 'f' || (b.l_suppkey % 3) || '::s' || b.l_partkey AS target, 1 AS value FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey % 3 = b.l_suppkey % 3 AND a.l_linenumber < b.l_linenumber",
    "json_in_text": f"""WITH RECURSIVE texts AS (SELECT conv_id, turn, regexp_replace(regexp_replace({G.REPLY}, '^\\s+', ''), '\\s+$', '') AS t FROM conversations WHERE text IS NOT NULL), {FOLD},
      f AS (SELECT conv_id, turn, t, list_filter(s.l, lambda x: json_valid(x))[1] AS inline, strpos(t, '```json') AS j, strpos(t, '```') AS p FROM walk WHERE i > len(ks)),
      b AS (SELECT *, substr(t, j + 7) AS after_j, substr(t, p + 3) AS after_p FROM f), c AS (SELECT *, trim(after_p[1 : strpos(after_p, '```') - 1], ' ' || chr(10)) AS block FROM b),
      k AS (SELECT conv_id, turn, CASE WHEN j > 0 AND strpos(after_j, '```') > 0 THEN {{kind: 'fenced', raw: trim(after_j[1 : strpos(after_j, '```') - 1], ' ' || chr(10))}} WHEN p > 0 AND strpos(after_p, '```') > 0 THEN {{kind: 'fenced', raw: CASE WHEN contains(block, chr(10)) THEN trim(substr(block, strpos(block, chr(10)) + 1), ' ' || chr(10)) ELSE block END}}
        WHEN t[1] IN ('{{', '[') AND t[-1] IN ('}}', ']') THEN {{kind: 'bare', raw: t}} WHEN inline IS NOT NULL THEN {{kind: 'inline', raw: inline}} END AS f FROM c)
      SELECT conv_id, turn, f.kind AS kind, md5(f.raw) AS digest, coalesce(json_valid(f.raw), false) AS parses FROM k""",
    "evidence_confidence": f"""WITH l1 AS ({G.EVIDENCE_SYMBOLS}), l2 AS ({G.EVIDENCE_RULES}), l3 AS ({G.EVIDENCE_TEXTS}),
      a AS (SELECT capability, count(*) AS n, count(*) FILTER (visibility = 'pub') AS pub, count(*) FILTER (contains(fragment, symbol)) AS hit FROM l1 JOIN l3 USING (capability) GROUP BY ALL), b AS (SELECT capability, count(*) AS n, count(*) FILTER (severity = 'high') AS high FROM l2 GROUP BY ALL)
      SELECT capability, round(coalesce(0.6 * CASE WHEN a.n <= 20 THEN 1.0 WHEN a.n <= 50 THEN 0.7 ELSE 0.4 END + 0.4 * a.pub / a.n, 0)::DOUBLE, 6) AS l1_score,
      round(coalesce(0.5 * CASE WHEN b.n = 1 THEN 0.5 WHEN b.n <= 5 THEN 1.0 WHEN b.n <= 10 THEN 0.7 ELSE 0.4 END + 0.5 * b.high / b.n, 0)::DOUBLE, 6) AS l2_score,
      round(CASE WHEN fragment IS NULL THEN 0 ELSE CASE WHEN fragment <> '' THEN 0.5 ELSE 0 END + 0.5 * coalesce(a.hit / a.n, 0) END::DOUBLE, 6) AS l3_score FROM l3 LEFT JOIN a USING (capability) LEFT JOIN b USING (capability)""",
    "time_series": f"""WITH {GRAPH}, k AS (SELECT trace_id, count(*) AS k FROM states GROUP BY ALL), ev AS (SELECT trace_id, pos AS ord FROM trans WHERE nxt IS NOT NULL), m AS (SELECT trace_id, min(ord) AS lo, max(ord) AS hi FROM ev GROUP BY ALL),
      z AS (SELECT trace_id, t.n, k, coalesce(lo, 0) AS lo, coalesce(hi, k * 100) - coalesce(lo, 0) AS span FROM k JOIN totals t USING (trace_id) LEFT JOIN m USING (trace_id)),
      y AS (SELECT *, CASE WHEN span = 0 THEN k ELSE 4 END AS wide, CASE WHEN span = 0 THEN k ELSE span // 4 + 1 END AS nw FROM z), g AS (SELECT *, CAST(unnest(range(nw)) AS INTEGER) AS w FROM y),
      c AS (SELECT g.trace_id, g.w, count(ord) AS n_transitions FROM g LEFT JOIN ev ON ev.trace_id = g.trace_id AND ord >= lo + w * wide AND ord < lo + (w + 1) * wide GROUP BY ALL)
      SELECT g.trace_id, g.w AS "window", count(s.trace_id) AS n_states, {", ".join(f"round(coalesce(avg(s.{x}), 0), 6) AS {x}" for x in ("edit_density", *TOOL))}, any_value(n_transitions) AS n_transitions FROM g JOIN c USING (trace_id, w) LEFT JOIN states s ON s.trace_id = g.trace_id
      AND (s.first_idx + s.last_idx + 1) // 2 >= g.w * g.n // g.nw AND (s.first_idx + s.last_idx + 1) // 2 < (g.w + 1) * g.n // g.nw GROUP BY g.trace_id, g.w""",
    "trace_features": f"""WITH {GRAPH} SELECT s.trace_id, any_value(t.n) AS total_tools, count(*) AS state_count, {", ".join(f"round(avg({x}), 6) AS {x}" for x in TOOL)}, {", ".join(f"round(avg(CASE WHEN primary_phase = '{c}' THEN 1.0::DOUBLE ELSE 0 END), 6) AS phase_{c}" for c in CATEGORIES)},
      round(any_value(t.n) / count(*), 6) AS avg_tools_per_state FROM states s JOIN totals t USING (trace_id) GROUP BY ALL""",
    "skill_reports": f"""WITH r AS (SELECT *, coalesce(reason, '') AS why FROM ({RUN_SQL})), n AS (SELECT graph, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status IN ('failed', 'timed_out')) AS failed, count(DISTINCT layer) AS n_layers,
        list(struct_pack(layer := layer, node := node, status := status, reason := why) ORDER BY layer, node) AS skills FROM r GROUP BY ALL), k AS (SELECT *, CASE WHEN failed > 0 THEN 'high' WHEN skipped > 0 THEN 'medium' ELSE 'low' END AS risk FROM n)
      SELECT graph, risk, md5('# Run of ' || graph || chr(10) || chr(10) || '| Metric | Value |' || chr(10) || '|-|-|' || chr(10) || concat('| Skills | ', total, ' |', chr(10), '| OK | ', ok, ' |', chr(10), '| Skipped | ', skipped, ' |', chr(10), '| Failed | ', failed, ' |', chr(10), '| Layers | ', n_layers, ' |', chr(10), '| Risk | ', risk, ' |', chr(10))
        || chr(10) || '## Skills' || chr(10) || chr(10) || array_to_string(list_transform(skills, lambda s: '- ' || s.layer || ' ' || s.node || ': ' || s.status || CASE WHEN s.reason <> '' THEN ' (' || s.reason || ')' ELSE '' END), chr(10)) || chr(10)) AS markdown,
      md5('<!DOCTYPE html><title>' || graph || '</title><table>' || concat('<tr><th>Skills</th><td>', total, '</td></tr><tr><th>OK</th><td>', ok, '</td></tr><tr><th>Skipped</th><td>', skipped, '</td></tr><tr><th>Failed</th><td>', failed, '</td></tr><tr><th>Layers</th><td>', n_layers, '</td></tr><tr><th>Risk</th><td>', risk, '</td></tr>') || '</table><ul>'
        || array_to_string(list_transform(skills, lambda s: '<li class="' || s.status || '">' || s.node || '</li>'), '') || '</ul>') AS html,
      md5(to_json(struct_pack(graph := graph, summary := struct_pack(total := total, ok := ok, skipped := skipped, failed := failed, risk := risk), skills := skills))::VARCHAR) AS json FROM k""",
}


def detected(patterns) -> str:
    """The first pattern that a line matches: {type, symbol, sure}."""
    arms = []
    for pattern, group, on, off, sure_on, sure_off, *only in patterns:
        name = f"regexp_extract(content, '{pattern}', {group})"
        arms.append(f"WHEN regexp_matches(content, '{pattern}'){''.join(f' AND regexp_matches({name}, {o!r})' for o in only)} THEN {{'type': CASE line_kind WHEN 'add' THEN '{on}' ELSE '{off}' END, 'symbol': {name}, 'sure': CASE line_kind WHEN 'add' THEN {sure_on} ELSE {sure_off} END::DOUBLE}}")
    return "CASE " + " ".join(arms)


def two(kind: str) -> tuple[str, str]:
    return f"{kind}_added", f"{kind}_removed"


FUNCTION, IMPORT, STRUCT = two("function"), two("import"), ("struct_added", "unknown")
# Patterns of declarations, by language, and of exported symbols, by ending; what a pattern stands for, and how sure it is.
ANY = ((r"(?i)\.(?:get|post|put|delete|patch)\s*[<(]\s*[''\"](/[/\w{}\-]*)[''\"]", 1, *two("http_route"), 0.85, 0.85), (r"^[-+]\s*([A-Z_]+)\s*[=:]", 1, "constant_added", "constant_changed", 0.7, 0.7))
DETECT = {
    ("rust",): ((r"^\s*pub\s+(?:async\s+)?fn\s+(\w+)\s*[<(]", 1, *FUNCTION, 1.0, 1.0), (r"^\s*pub\s+struct\s+(\w+)", 1, *STRUCT, 1.0, 0.7), (r"^\s*pub\s+enum\s+(\w+)", 1, "enum_added", "unknown", 1.0, 0.7),
      (r"^\s*pub\s+trait\s+(\w+)", 1, "trait_added", "unknown", 1.0, 0.7), (r"^\s*use\s+(.+);", 1, *IMPORT, 0.95, 0.95), (r"^\s*pub\s+const\s+(\w+)\s*:", 1, *two("constant"), 0.9, 0.9)),
    ("typescript", "javascript"): ((r"^\s*export\s+(?:async\s+)?function\s+(\w+)", 1, *FUNCTION, 0.95, 0.95), (r"^\s*(?:export\s+)?class\s+(\w+)", 1, *STRUCT, 1.0, 0.7), (r"^\s*import\s+(.+)\s+from\s+[''\"]\S+[''\"]", 1, *IMPORT, 0.95, 0.95)),
    ("python",): ((r"^\s*def\s+(\w+)\s*[<(]", 1, *FUNCTION, 0.95, 0.95, "^([^_]|_$|__)"), (r"^\s*class\s+(\w+)\s*[:(]", 1, *STRUCT, 1.0, 0.7)),
    ("go",): ((r"^\s*func\s+(\w+)\s*[<(]", 1, *FUNCTION, 0.95, 0.95, "^[A-Z]"), (r"^\s*type\s+(\w+)\s+struct", 1, *STRUCT, 1.0, 0.7)),
    ("java",): ((r"^\s*(?:public\s+)?class\s+(\w+)", 1, *STRUCT, 1.0, 0.7), (r"^\s*(?:public|private|protected)\s+(?:\w+\s+)+(\w+)\s*[<(]", 1, *FUNCTION, 0.9, 0.9)),
    ("unknown",): (),
}
DECLARED = f"""{hunks(G.DECLARED_LINES, G.DECLARED_PATH)}, seen AS (SELECT *, CASE {" ".join(f"WHEN language IN {(*langs, '')} THEN {detected((*patterns, *ANY))} END" for langs, patterns in DETECT.items())} END AS d FROM dl WHERE line_kind <> 'ctx' AND NOT regexp_matches(content, '^\\s*(//|#)')),
hit AS (SELECT diff_id, 'rc_' || lpad((row_number() OVER (PARTITION BY diff_id ORDER BY hunk_idx, line_kind = 'del', line_idx))::VARCHAR, 5, '0') AS change_id, file, language, CAST(CASE line_kind WHEN 'add' THEN new_start ELSE old_start END AS INTEGER) AS line_start, d.type AS change_type, d.symbol AS symbol, d.sure AS confidence, content FROM seen WHERE d IS NOT NULL),
found AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY diff_id, file, line_start, symbol, change_type ORDER BY change_id) = 1)"""
ONE_OF = lambda c, *words: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"
BUILT_IN = (
    ("sec_auth_001", "security", "high", ONE_OF("symbol", "auth", "login")), ("sec_auth_002", "security", "high", ONE_OF("symbol", "guard", "permission")), ("sec_crypto_001", "security", "high", ONE_OF("symbol", "hash", "encrypt", "decrypt")), ("sec_sql_001", "security", "high", ONE_OF("content", "sql")),
    ("sec_token_001", "security", "high", ONE_OF("symbol", "token", "jwt", "session")), ("breaking_001", "breaking", "high", f"change_type IN ('function_removed', 'http_route_removed') AND NOT {ONE_OF('symbol', 'test')}"), ("breaking_005", "breaking", "medium", "change_type = 'constant_removed'"),
    ("perf_001", "performance", "medium", "lower(file) LIKE '%.sql'"), ("perf_002", "performance", "medium", ONE_OF("file", "migration", "schema")), ("deprec_001", "deprecation", "low", ONE_OF("content", "deprecat")), ("deprec_002", "deprecation", "low", ONE_OF("content", "todo", "fixme")), ("misc_test_001", "domain", "low", ONE_OF("file", "test")),
)
MATCHED = f"""{DECLARED}, matched AS (SELECT diff_id, change_id, symbol, unnest(list_filter([{", ".join(f"CASE WHEN {cond} THEN {{'rule_id': '{i}', 'category': '{c}', 'severity': '{s}'}} END" for i, c, s, cond in BUILT_IN)}], lambda x: x IS NOT NULL), recursive := true) FROM found)"""
# Symbols of an exported line: the first pattern of the file's ending, in the line without white space in front.
SHAPES = {
    "rs": ((r"fn\s+(\w+)", "fn"), (r"struct\s+(\w+)", "struct"), (r"enum\s+(\w+)", "enum"), (r"trait\s+(\w+)", "trait"), (r"impl\s+(?:<[^>]+>)?\s*(\w+)", "impl"), (r"const\s+(\w+)", "const"), (r"type\s+(\w+)", "type"), (r"^mod\s+(\w+)", "module")),
    "py": ((r"def\s+(\w+)\s*\(", "fn"), (r"class\s+(\w+)", "class"), (r"@(\w+)", "method"), (r"^([A-Z][A-Z0-9_]+)\s*=", "const")),
    "ts": ((r"function\s+(\w+)\s*\(", "fn"), (r"const\s+(\w+)\s*=\s*(?:\([^)]*\)|[\w]+)\s*=>", "=>"), (r"class\s+(\w+)", "class"), (r"interface\s+(\w+)", "interface"), (r"type\s+(\w+)\s*=", "type"), (r"export\s+const\s+(\w+)", "const")),
    "go": ((r"func\s+(\w+)\s*\(", "fn"), (r"type\s+(\w+)\s+struct", "struct"), (r"type\s+(\w+)\s+interface", "interface"), (r"type\s+(\w+)\s+[^=\s]", "type"), (r"var\s+(\w+)", "const"), (r"const\s+(\w+)", "const")),
    "": ((r"function\s+(\w+)", "fn"), (r"fn\s+(\w+)", "fn"), (r"def\s+(\w+)", "fn"), (r"class\s+(\w+)", "class")),
}
SHAPED = "CASE " + " ".join((f"WHEN file LIKE '%.{end}' THEN " if end else "ELSE ") + "CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN {{'name': regexp_extract(c, '{p}', 1), 'kind': '{k}'}}" for p, k in shapes) + " END" for end, shapes in SHAPES.items()) + " END"
ORACLES |= {
    "declared_changes": f"WITH {DECLARED} SELECT diff_id, change_id, file, language, line_start, change_type, symbol, confidence, content FROM found",
    "declared_rules": f"WITH {MATCHED} SELECT diff_id, change_id, symbol, rule_id, category, severity FROM matched",
    "declared_status": f"""WITH {MATCHED}, c AS (SELECT diff_id, change_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM matched GROUP BY ALL)
      SELECT diff_id, change_id, symbol AS name, CASE WHEN change_type LIKE '%_added' THEN 'added' WHEN change_type LIKE '%_removed' THEN 'removed' ELSE 'modified' END AS status, coalesce(categories, '') AS categories FROM found LEFT JOIN c USING (diff_id, change_id)""",
    "breaking_changes": f"WITH {DECLARED} SELECT change_type, language, count(*) AS n FROM found WHERE change_type IN ('function_removed', 'http_route_removed', 'constant_removed') GROUP BY ALL",
    "declared_exports": f"""WITH {hunks(G.DECLARED_LINES, G.DECLARED_PATH)}, t AS (SELECT *, regexp_replace(content, '^\\s+', '') AS c FROM dl WHERE line_kind <> 'ctx'), x AS (SELECT *, {SHAPED} AS s FROM t)
      SELECT diff_id, file, {FROM_PATH} AS module, s.name AS name, s.kind AS kind, CASE line_kind WHEN 'add' THEN 'added' ELSE 'removed' END AS action, CAST(new_start + line_idx + 1 AS BIGINT) AS line FROM x WHERE s IS NOT NULL""",
}

# Alignment of matched runs: rows of least costs, grown one call of A at a time, then the way back from the last calls of both.
SIDE = lambda s: f"""l{s} AS (SELECT pair_id, match_id, list(tool_name ORDER BY idx) AS t{s}, list(tool_name || '|' || path ORDER BY idx) AS c{s}, min(idx) AS f{s} FROM placed JOIN tp USING (pair_id) JOIN runs r ON r.trace_id = trace_{s} AND r.run_idx = run_{s}
  JOIN calls c ON c.trace_id = r.trace_id AND c.idx BETWEEN first_idx AND last_idx WHERE kind = 'matched' GROUP BY ALL)"""  # noqa: E731
LONE = lambda s, kind: f"""SELECT pair_id, match_id, row_number() OVER (PARTITION BY pair_id, match_id ORDER BY idx) - 1 AS position, tool_name, kind, {"idx" if s == "a" else "NULL"} AS index_a, {"idx" if s == "b" else "NULL"} AS index_b
  FROM placed JOIN tp USING (pair_id) JOIN runs r ON r.trace_id = trace_{s} AND r.run_idx = run_{s} JOIN calls c ON c.trace_id = r.trace_id AND c.idx BETWEEN first_idx AND last_idx WHERE kind = '{kind}'"""  # noqa: E731
ALIGNED = f"""{CALLS},{RUNS},{MATCH}, placed AS (SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY coalesce(run_b, run_a), run_b IS NULL, run_a NULLS FIRST, label) - 1 AS INTEGER) AS match_id, label, kind, run_a, run_b FROM matched),
{SIDE("a")}, {SIDE("b")},
dp AS (SELECT la.*, tb, cb, fb, 0::BIGINT AS i, [range(0, len(cb) + 1)] AS costs FROM la JOIN lb USING (pair_id, match_id)
  UNION ALL SELECT * EXCLUDE (i, costs), i + 1, list_append(costs, list_reduce(list_transform(range(1, len(cb) + 1), lambda j: [j]), lambda row, j: list_append(row, least(costs[i + 1][j[1] + 1] + 1, row[j[1]] + 1, costs[i + 1][j[1]] + CASE WHEN ca[i + 1] = cb[j[1]] THEN 0 ELSE 1 END)), [i + 1])) FROM dp WHERE i < len(ca)),
back AS (SELECT pair_id, match_id, ta, ca, fa, tb, cb, fb, costs, 0 AS step, len(ca) AS i, len(cb) AS j, NULL::VARCHAR AS kind FROM dp WHERE i = len(ca)
  UNION ALL SELECT * EXCLUDE (step, i, j, kind, move), step + 1, CASE WHEN move IN ('unchanged', 'args_changed', 'deleted') THEN i - 1 ELSE i END, CASE WHEN move = 'deleted' THEN j ELSE j - 1 END, move FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND ca[i] = cb[j] THEN 'unchanged' WHEN i > 0 AND j > 0 AND ta[i] = tb[j] THEN 'args_changed'
    WHEN j > 0 AND (i = 0 OR costs[i + 1][j] <= costs[i][j + 1]) THEN 'added' ELSE 'deleted' END AS move FROM back WHERE i > 0 OR j > 0)),
aligned AS (SELECT pair_id, match_id, row_number() OVER (PARTITION BY pair_id, match_id ORDER BY step DESC) - 1 AS position, CASE kind WHEN 'deleted' THEN ta[i + 1] ELSE tb[j + 1] END AS tool_name, kind, CASE WHEN kind <> 'added' THEN fa + i END AS index_a, CASE WHEN kind <> 'deleted' THEN fb + j END AS index_b FROM back WHERE kind IS NOT NULL
  UNION ALL {LONE("a", "deleted")} UNION ALL {LONE("b", "added")}),
segs AS (SELECT pair_id, match_id, label, CASE WHEN kind <> 'matched' THEN kind WHEN EXISTS (SELECT 1 FROM aligned d WHERE d.pair_id = p.pair_id AND d.match_id = p.match_id AND d.kind <> 'unchanged') THEN 'modified' ELSE 'unchanged' END AS kind FROM placed p)"""
SUMMED = f"""{ALIGNED},{TRACES}, s AS (SELECT pair_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS segments_{k}" for k in ("unchanged", "modified", "added", "deleted"))} FROM segs GROUP BY ALL),
d AS (SELECT pair_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS calls_{n}" for k, n in (("unchanged", "unchanged"), ("args_changed", "modified"), ("added", "added"), ("deleted", "deleted")))} FROM aligned GROUP BY ALL),
summed AS (SELECT tp.pair_id, trace_a, trace_b, {", ".join(f"{s}.{c} AS {c}_{s}" for s in "ab" for c in ("tokens", "duration_ms", "n_calls"))}, s.* EXCLUDE (pair_id), d.* EXCLUDE (pair_id), b.tokens - a.tokens AS token_delta, b.duration_ms - a.duration_ms AS duration_delta_ms
  FROM tp JOIN traces a ON a.trace_id = trace_a JOIN traces b ON b.trace_id = trace_b JOIN s USING (pair_id) JOIN d USING (pair_id))"""
ORACLES |= {
    "tool_align": f"WITH RECURSIVE {ALIGNED} SELECT pair_id, match_id, position::INTEGER AS position, tool_name, kind, index_a, index_b FROM aligned",
    "diff_summary": f"WITH RECURSIVE {SUMMED} SELECT * FROM summed",
    "trajectory_analysis": f"""WITH RECURSIVE {SUMMED} SELECT pair_id, round((calls_added + calls_deleted) / (n_calls_a + n_calls_b), 6) AS tool_churn, round(calls_modified / (n_calls_a + n_calls_b), 6) AS capability_shift,
      round((segments_added + segments_deleted) / (segments_unchanged + segments_modified + segments_added + segments_deleted), 6) AS phase_reorder FROM summed""",
    "phase_changes": f"""WITH RECURSIVE {ALIGNED} SELECT pair_id, match_id, g.label, g.kind, count(*) FILTER (d.kind <> 'added') AS calls_before, count(*) FILTER (d.kind <> 'deleted') AS calls_after,
      coalesce(string_agg(tool_name, ',' ORDER BY position) FILTER (d.kind = 'added'), '') AS added_tools, coalesce(string_agg(tool_name, ',' ORDER BY position) FILTER (d.kind = 'deleted'), '') AS deleted_tools
      FROM aligned d JOIN segs g USING (pair_id, match_id) WHERE g.kind <> 'unchanged' GROUP BY ALL""",
}

NEAR = f"""{FULL}, {pairs("vecs", "trace_id").strip()}, member AS (SELECT trace_id, trace_id // 40 AS cohort FROM vecs),
sides AS (SELECT a, b, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs), alike AS (SELECT m.cohort, a, b, similarity FROM sides JOIN member m ON m.trace_id = a JOIN member o ON o.trace_id = b AND o.cohort = m.cohort)"""
ORACLES |= {
    # Clusters of core points are numbered by their least member; a border point goes to the first cluster with a core point near it.
    "dbscan_labels": f"""WITH RECURSIVE {NEAR}, near AS (SELECT * FROM alike WHERE 1 - similarity <= 0.001), core AS (SELECT cohort, a AS id FROM near GROUP BY ALL HAVING count(*) >= 2),
      grown AS (SELECT cohort, id AS seed, id FROM core UNION SELECT g.cohort, g.seed, n.b FROM grown g JOIN near n ON n.cohort = g.cohort AND n.a = g.id JOIN core c ON c.id = n.b), least AS (SELECT cohort, id, min(seed) AS seed FROM grown GROUP BY ALL),
      ranked AS (SELECT *, dense_rank() OVER (PARTITION BY cohort ORDER BY seed) AS label FROM least), border AS (SELECT n.b AS id, min(label) AS label FROM near n JOIN ranked k ON k.id = n.a GROUP BY ALL)
      SELECT member.cohort, trace_id, CAST(coalesce(k.label, b.label, -1) AS INTEGER) AS label FROM member LEFT JOIN ranked k ON k.id = trace_id LEFT JOIN border b ON b.id = trace_id""",
    # A vector joins the first set of whose members it resembles all, one vector after the other.
    "similarity_groups": f"""WITH RECURSIVE {NEAR}, near AS (SELECT cohort, m.trace_id AS id, row_number() OVER (PARTITION BY cohort ORDER BY m.trace_id) AS k, coalesce((SELECT list(b) FROM alike x WHERE x.a = m.trace_id AND similarity >= 0.97), []) AS l FROM member m),
      walk AS (SELECT DISTINCT cohort, 0::BIGINT AS k, []::BIGINT[][] AS sets, NULL::BIGINT AS id, NULL::BIGINT AS set_id FROM member
        UNION ALL SELECT cohort, k, CASE WHEN place IS NULL THEN list_append(sets, [id]) ELSE list_transform(sets, lambda s, q: CASE WHEN q = place THEN list_append(s, id) ELSE s END) END, id, coalesce(place - 1, len(sets))
          FROM (SELECT w.cohort, n.k, w.sets, n.id, list_filter(range(1, len(w.sets) + 1), lambda q: list_has_all(n.l, w.sets[q]))[1] AS place FROM walk w JOIN near n ON n.cohort = w.cohort AND n.k = w.k + 1))
      SELECT cohort, id AS trace_id, set_id FROM walk WHERE id IS NOT NULL""",
}

CHANGED = f"""{hunks(G.DECLARED_LINES, G.DECLARED_PATH)}, per AS (SELECT diff_id, any_value(file) AS file, any_value(change) AS change, count(*) FILTER (line_kind = 'add' AND NOT starts_with(content, '++')) AS additions, count(*) FILTER (line_kind = 'del' AND NOT starts_with(content, '--')) AS deletions FROM dl GROUP BY diff_id)"""
GROUPED = "CASE WHEN f LIKE 'src/%' OR f LIKE 'crates/%' THEN split_part(f, '/', 1) || '/' || split_part(f, '/', 2) ELSE '.' END"
ORACLES |= {
    "export_summary": f"""WITH {CHANGED}, f AS (SELECT *, list_sort(list_distinct(CASE change WHEN 'added' THEN [file] WHEN 'deleted' THEN [file] ELSE [file, 'old.txt'] END)) AS files FROM per), h AS (SELECT diff_id, hunk_idx, old_start, new_start, sum(strlen(content) + 2) AS body FROM dl GROUP BY ALL), t AS (SELECT h.diff_id, sum(strlen('@@ -' || old_start || ',9 +' || new_start || ' @@ ' || name) + body)::BIGINT
        + any_value(strlen('diff --git a/old.txt b/' || h2.file || chr(10) || CASE h2.change WHEN 'added' THEN 'new file mode 100644' || chr(10) WHEN 'deleted' THEN 'deleted file mode 100644' || chr(10) WHEN 'renamed' THEN 'rename from old.txt' || chr(10) || 'rename to ' || h2.file || chr(10) ELSE '' END || '--- ' || CASE h2.change WHEN 'added' THEN '/dev/null' WHEN 'deleted' THEN 'a/' || h2.file ELSE 'a/old.txt' END || chr(10) || '+++ ' || CASE h2.change WHEN 'deleted' THEN '/dev/null' ELSE 'b/' || h2.file END)) + count(*) AS n FROM h JOIN files h2 USING (diff_id) GROUP BY h.diff_id)
      SELECT diff_id, array_to_string(files, ',') AS files, array_to_string(list_sort(list_distinct(list_transform(files, lambda f: {GROUPED}))), ',') AS modules, additions, deletions, n::INTEGER AS diff_length FROM f JOIN t USING (diff_id)""",
    "module_symbols": f"""WITH {hunks(G.DECLARED_LINES, G.DECLARED_PATH)}, t AS (SELECT *, regexp_replace(content, '^\\s+', '') AS c FROM dl WHERE line_kind <> 'ctx'), x AS (SELECT *, {SHAPED} AS s FROM t),
      e AS (SELECT o_custkey AS diff_id, split_part({FROM_PATH}, '/', 1) AS module, file, s.name AS name, CASE line_kind WHEN 'add' THEN 'added' ELSE 'removed' END AS action, new_start + line_idx + 1 AS line FROM x JOIN orders ON o_orderkey = diff_id WHERE s IS NOT NULL),
      k AS (SELECT *, row_number() OVER (PARTITION BY diff_id, module ORDER BY action, file, line, name) AS k FROM e)
      SELECT diff_id, module, count(*) FILTER (action = 'added') AS n_added, count(*) FILTER (action = 'removed') AS n_removed, string_agg(name, ',' ORDER BY k) FILTER (k <= 5) AS symbols FROM k GROUP BY ALL""",
    "top_side_effects": "WITH e AS (SELECT 'writes ' || o_orderpriority AS side_effect FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'sends ' || o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'logs' FROM orders WHERE o_orderkey % 7 = 0) SELECT side_effect, count(*) AS n FROM e GROUP BY ALL ORDER BY n DESC, side_effect LIMIT 3",
    "vector_diff": f"WITH {FULL},{pairs('vecs', 'trace_id')} SELECT p.a, p.b, {', '.join(f'round(p.{c}, 5) AS {c}' for c in ('similarity', 'entropy', 'structural', 'temporal', 'density'))}, {', '.join(f'round(x.{c} - y.{c}, 5) AS d_{c}' for c in VECTOR)} FROM pairs p JOIN vecs x ON x.trace_id = p.a JOIN vecs y ON y.trace_id = p.b WHERE p.b = p.a + 1",
    "coupling_over": f"WITH {COUPLING} SELECT cap_a, cap_b, round(correlation, 6) AS correlation FROM ce WHERE correlation >= 0.3",
    "suite_risk": f"WITH {CODE_RUNS} SELECT suite, CASE WHEN count(*) FILTER (status IN ('Failed', 'TimedOut')) > 0 THEN 'high' WHEN count(*) FILTER (status = 'Skipped') > 0 THEN 'medium' ELSE 'low' END AS risk FROM runs GROUP BY ALL",
    "eval_recommendations": """WITH n AS (SELECT l_orderkey AS task_id, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS ok FROM lineitem GROUP BY ALL), o AS (SELECT *, CASE WHEN ok = n THEN 'Pass' WHEN ok > 0 THEN 'Partial' ELSE 'Fail' END AS outcome FROM n),
      a AS (SELECT task_id, outcome, CASE outcome WHEN 'Fail' THEN ['All graders failed. Review the code for syntax errors or breaking changes.', 'Evaluate again after fixing build/test/lint failures.'] WHEN 'Partial' THEN [ok || '/' || n || ' graders passed. Focus on the failing graders.', 'Review grader details for specific error messages.'] ELSE ['All automated checks passed. Review LLM rubric scores for quality insights.'] END AS l FROM o)
      SELECT task_id, outcome, CAST(k - 1 AS INTEGER) AS position, l[k] AS advice FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM a)""",
    "turn_previews": "SELECT conv_id, turn, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS preview FROM conversations",
    "log_session_lines": """WITH t AS (SELECT conv_id AS source, role, coalesce(text, '') AS text FROM conversations) SELECT source, count(*) AS n, count(*) AS n_calls, sum(length(text))::BIGINT AS n_chars, CASE WHEN source % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS n_bad FROM t WHERE role <> 'user' GROUP BY source""",
}
# From each entry, the least successor that wasn't visited, up to twenty nodes.
ORACLES["flow_trace"] = f"""WITH RECURSIVE {DAG}, succ AS (SELECT graph, node, list_sort(list(dep)) AS l FROM edges GROUP BY ALL),
  walk AS (SELECT graph, node AS entry, [node] AS p FROM succ UNION ALL SELECT graph, entry, list_append(p, nxt) FROM (SELECT w.graph, w.entry, w.p, list_filter(s.l, lambda x: NOT list_contains(w.p, x))[1] AS nxt FROM walk w JOIN succ s ON s.graph = w.graph AND s.node = w.p[-1] WHERE len(w.p) < 20) WHERE nxt IS NOT NULL)
  SELECT graph, entry, array_to_string(p, '>') AS path, len(p)::INTEGER AS n_nodes FROM walk QUALIFY row_number() OVER (PARTITION BY graph, entry ORDER BY len(p) DESC) = 1"""
