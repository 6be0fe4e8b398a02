"""The same queries as SQL for an independent engine: common table expressions by family, then a SELECT for each query.

Of the library it uses the generated inputs only; every rule is written out again.
"""

from __future__ import annotations

from ..sources import generated as G

CATEGORIES = ("locate", "modify", "verify", "commit", "other")
CLUSTERS = ("rust", "ts_js", "python", "go", "doc", "src", "test", "other")
VECTOR = ("tool_entropy", "phase_entropy", "transition_entropy", "loop_ratio", "backtrack_ratio", "burst_ratio", "stability")
TOOL = [f"tool_{c}" for c in CATEGORIES]
FILE = [f"file_{c}" for c in CLUSTERS]
MEANS = [*TOOL, *FILE, "edit_density", "read_write_ratio", "loop_intensity", "failure_rate"]
DAY = 86400000


def join(items, sep=", "):
    return sep.join(items)


def cos(a, b):
    dot = join((f"{x}*{y}" for x, y in zip(a, b)), "+")
    na, nb = (f"sqrt({join((f'{x}*{x}' for x in v), '+')})" for v in (a, b))
    return f"({dot}) / nullif({na}*{nb}, 0)"


CALLS = """
calls0 AS (SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, ts, event_type,
  CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(floor(value * 10) AS BIGINT) AS duration_ms FROM events),
calls1 AS (SELECT *, CASE WHEN event_type = 'error' AND k < 20 THEN 'verify'
  ELSE (['locate', 'modify', 'verify', 'commit', 'other'])[1 + (trace_id + idx // 12) % 5] END AS category FROM calls0),
calls AS (SELECT trace_id, idx, ts, k, duration_ms, category, CASE category WHEN 'locate' THEN (['read', 'grep', 'web_search'])[k % 3 + 1]
  WHEN 'modify' THEN (['write', 'edit', 'bash'])[k % 3 + 1] WHEN 'verify' THEN (['test', 'cargo', 'check'])[k % 3 + 1]
  WHEN 'commit' THEN (['commit', 'git', 'push'])[k % 3 + 1] ELSE (['think', 'plan', 'ask'])[k % 3 + 1] END AS tool_name,
  'src/m' || ((idx // 20) % 4) AS scope, 'src/m' || ((idx // 20) % 4) || '/f' || k || (['.rs', '.py', '.md'])[k % 3 + 1] AS path,
  (['rust', 'python', 'doc'])[k % 3 + 1] AS cluster FROM calls1)"""


def segments(gap: int) -> str:
    return f"""
flags AS (SELECT *, lag(category) OVER w AS pc, lag(tool_name) OVER w AS pt, datesub('millisecond', lag(ts) OVER w, ts) AS gap, lag(scope) OVER w AS ps
  FROM calls WINDOW w AS (PARTITION BY trace_id ORDER BY idx)),
cuts AS (SELECT *, CASE WHEN pc IS NULL THEN NULL WHEN pc = 'verify' AND category = 'modify' AND pt IN ('test', 'check') THEN 'failure_loop'
  WHEN pc <> category THEN 'tool_type_change' WHEN gap < 0 OR gap > {gap} THEN 'idle_gap' WHEN ps <> scope THEN 'file_scope_jump' END AS cut FROM flags),
numbered AS (SELECT *, CAST(count(cut) OVER (PARTITION BY trace_id ORDER BY idx) AS INTEGER) AS segment_idx, lead(cut) OVER (PARTITION BY trace_id ORDER BY idx) AS next_cut FROM cuts),
segs AS (SELECT trace_id, segment_idx, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_calls, min(category) AS category,
  coalesce(max(next_cut), 'start') AS boundary_reason FROM numbered GROUP BY ALL)"""


SHARES = join([*(f"avg(CASE WHEN c.category = '{c}' THEN 1.0::DOUBLE ELSE 0 END) AS tool_{c}" for c in CATEGORIES), *(f"avg(CASE WHEN c.cluster = '{c}' THEN 1.0::DOUBLE ELSE 0 END) AS file_{c}" for c in CLUSTERS)])
P = lambda n: f"lag({n}) OVER w"
LEAST, MOST = (join((f"{f}(p_{n}, {n})" for n in TOOL), "+") for f in ("least", "greatest"))
STATES = f"""
cand0 AS (SELECT trace_id, segment_idx, first_idx, CAST(n_calls AS INTEGER) AS n, unnest(CASE WHEN n_calls < 3 THEN [0] ELSE range(0, n_calls - 2, 2) END) AS start FROM segs),
cands AS (SELECT trace_id, segment_idx, first_idx + start AS first_idx, first_idx + least(start + 8, n) - 1 AS last_idx,
  CAST(row_number() OVER (PARTITION BY trace_id ORDER BY segment_idx, start) - 1 AS INTEGER) AS candidate_idx FROM cand0),
totals AS (SELECT trace_id, count(*) AS n FROM calls GROUP BY ALL),
feats AS (SELECT d.trace_id, d.candidate_idx, d.first_idx, d.last_idx, count(*) AS n_calls, {SHARES},
  avg(CASE WHEN c.tool_name IN ('write', 'edit') THEN 1.0::DOUBLE ELSE 0 END) AS edit_density, avg(CASE WHEN c.tool_name IN ('read', 'grep') THEN 1.0::DOUBLE ELSE 0 END) AS read_write_ratio,
  CASE WHEN count(*) > 1 THEN 1.0::DOUBLE ELSE 0 END AS loop_intensity, sum(CASE WHEN c.tool_name IN ('test', 'check') THEN 1.0::DOUBLE ELSE 0 END) / max(t.n) AS failure_rate
  FROM cands d JOIN calls c ON c.trace_id = d.trace_id AND c.idx BETWEEN d.first_idx AND d.last_idx JOIN totals t ON t.trace_id = d.trace_id
  GROUP BY d.trace_id, d.candidate_idx, d.first_idx, d.last_idx),
lagged AS (SELECT *, {join(f"{P(n)} AS p_{n}" for n in MEANS)} FROM feats WINDOW w AS (PARTITION BY trace_id ORDER BY candidate_idx)),
apart AS (SELECT *, CASE WHEN p_edit_density IS NULL THEN 0 WHEN 0.3::DOUBLE * (({LEAST}) / ({MOST})) + 0.15::DOUBLE * ({cos([f"p_{n}" for n in FILE], FILE)})
  + 0.15::DOUBLE * (1.0::DOUBLE - abs(p_edit_density - edit_density)) + 0.25::DOUBLE * (1.0::DOUBLE - abs(p_read_write_ratio - read_write_ratio))
  + 0.15::DOUBLE * (1.0::DOUBLE - abs(p_failure_rate - failure_rate)) >= 0.85::DOUBLE THEN 0 ELSE 1 END AS new FROM lagged),
islands AS (SELECT *, CAST(sum(new) OVER (PARTITION BY trace_id ORDER BY candidate_idx) AS INTEGER) AS state_idx FROM apart),
states0 AS (SELECT trace_id, state_idx, count(*) AS n_candidates, min(first_idx) AS first_idx, arg_max(last_idx, candidate_idx) AS last_idx, {join(f"avg({n}) AS {n}" for n in MEANS)} FROM islands GROUP BY ALL),
states AS (SELECT *, 1.0::DOUBLE - least(loop_intensity, 1.0::DOUBLE) AS stability, CASE greatest({join(TOOL)}) {join((f"WHEN tool_{c} THEN '{c}'" for c in sorted(CATEGORIES)), " ")} END AS primary_phase FROM states0),
trans AS (SELECT trace_id, state_idx AS pos, primary_phase AS from_phase, lead(state_idx) OVER w AS nxt, lead(primary_phase) OVER w AS to_phase FROM states WINDOW w AS (PARTITION BY trace_id ORDER BY state_idx))"""
ENTROPY = "-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END)"
RUNS = """
runs0 AS (SELECT *, CASE WHEN lag(category) OVER (PARTITION BY trace_id ORDER BY idx) <> category THEN 1 ELSE 0 END AS new FROM calls),
runs1 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY trace_id ORDER BY idx) AS INTEGER) AS run_idx FROM runs0),
runs AS (SELECT trace_id, run_idx, min(category) AS label, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_calls FROM runs1 GROUP BY ALL)"""
METRICS = f"""
tent AS (SELECT trace_id, {ENTROPY} AS tool_entropy FROM (SELECT trace_id, category, count(*) / sum(count(*)) OVER (PARTITION BY trace_id) AS p FROM calls GROUP BY trace_id, category) GROUP BY ALL),
burst AS (SELECT trace_id, max(n_calls) AS longest, CAST(sum(n_calls) AS BIGINT) AS n_calls, CASE WHEN max(n_calls) >= 3 THEN (max(n_calls) - 2) / sum(n_calls) ELSE 0.0 END AS burst_ratio FROM runs GROUP BY ALL),
stab AS (SELECT trace_id, coalesce(avg(c), 1.0) AS stability FROM (SELECT trace_id, CASE WHEN p_edit_density IS NOT NULL THEN coalesce(least(1, {cos([f"p_{n}" for n in [*TOOL, "edit_density", "read_write_ratio"]], [*TOOL, "edit_density", "read_write_ratio"])}), 0) END AS c
  FROM (SELECT *, {join(f"{P(n)} AS p_{n}" for n in [*TOOL, "edit_density", "read_write_ratio"])} FROM states WINDOW w AS (PARTITION BY trace_id ORDER BY state_idx))) GROUP BY ALL)"""
UNIT = f"""
shape AS (SELECT t.trace_id, t.n AS n_calls, count(*) AS n_states FROM totals t JOIN states s ON s.trace_id = t.trace_id GROUP BY ALL),
raw AS (SELECT sh.trace_id, CASE WHEN sh.n_calls > 1 THEN least(greatest(te.tool_entropy / log2(sh.n_calls), 0), 1) ELSE 0 END AS v0,
  least(CASE WHEN n_states > 1 THEN log2(n_states - 1) ELSE 0 END / log2(greatest(n_states, 2) * greatest(n_states, 2)), 1) AS v1, 0.0::DOUBLE AS v3, 0.0::DOUBLE AS v4,
  least(log2(1 + b.burst_ratio), 1) AS v5, n_states::DOUBLE AS v6, st.stability FROM shape sh JOIN tent te USING (trace_id) JOIN burst b USING (trace_id) JOIN stab st USING (trace_id)),
sorted AS (SELECT *, list_sort([v0, v1, v1, v3, v4, v5, v6]) AS s FROM raw),
vecs AS (SELECT trace_id, {join(f"CASE WHEN abs(s[6] - s[2]) < 1e-8 THEN {v} ELSE ({v} - s[4]) / (s[6] - s[2]) END AS {n}" for v, n in zip(("v0", "v1", "v1", "v3", "v4", "v5"), VECTOR))}, stability FROM sorted)"""
BASE = f"{CALLS},{segments(DAY)}"
GRAPH = f"{BASE},{STATES}"
FULL = f"{GRAPH},{RUNS},{METRICS},{UNIT}"
LINKS = """
links AS (SELECT l_orderkey AS h, p_brand AS cap, l_suppkey AS f, o_custkey AS s FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
hc AS (SELECT DISTINCT h, cap FROM links), hn AS (SELECT h, count(*) AS caps FROM hc GROUP BY ALL),
cs AS (SELECT a.cap AS cap_a, b.cap AS cap_b, count(*) AS cooccur, sum(CASE WHEN caps > 1 THEN 1 / (1 + ln(caps)) ELSE 1 END) / (SELECT count(*) FROM hn) AS commit_score
  FROM hc a JOIN hc b ON a.h = b.h AND a.cap < b.cap JOIN hn ON hn.h = a.h GROUP BY ALL),
cf AS (SELECT DISTINCT hc.cap, l.f FROM hc JOIN links l ON l.h = hc.h), cfn AS (SELECT cap, count(*) AS n FROM cf GROUP BY ALL),
fs AS (SELECT a.cap AS cap_a, b.cap AS cap_b, count(*) / (max(x.n) + max(y.n) - count(*)) AS file_score FROM cf a JOIN cf b ON a.f = b.f AND a.cap < b.cap JOIN cfn x ON x.cap = a.cap JOIN cfn y ON y.cap = b.cap GROUP BY ALL),
sc AS (SELECT DISTINCT s, cap FROM links),
ss AS (SELECT a.cap AS cap_a, b.cap AS cap_b, count(*) / sqrt((SELECT count(DISTINCT s) FROM sc)) AS session_score FROM sc a JOIN sc b ON a.s = b.s AND a.cap < b.cap GROUP BY ALL),
evidence AS (SELECT cap_a, cap_b, coalesce(cooccur, 0) AS cooccur, coalesce(commit_score, 0) AS commit_score, coalesce(file_score, 0) AS file_score, coalesce(session_score, 0) AS session_score,
  ln(1 + coalesce(commit_score, 0) + 1.5::DOUBLE * coalesce(file_score, 0) + 0.5::DOUBLE * coalesce(session_score, 0)) AS fused FROM cs FULL JOIN fs USING (cap_a, cap_b) FULL JOIN ss USING (cap_a, cap_b))"""
WEIGHTS = (1.0, 1.0, 1.0, 1.2, 1.0, 1.5, 0.8)
GROUPS = ("entropy", "structural", "temporal", "density")


def pairs(table: str, key: str) -> str:
    prod = [f"{w}::DOUBLE * a.{c} * b.{c}" for w, c in zip(WEIGHTS, VECTOR)]
    va, vb = ([f"{s}.{c}" for c in VECTOR] for s in "ab")
    dealt = [f"CASE WHEN base > 0 THEN {g} + rest * {g} / base ELSE {g} + rest * 0.25 END AS {g}" for g in GROUPS]
    return f"""
prod AS (SELECT a.{key} AS a, b.{key} AS b, coalesce(least(1, greatest(-1, {cos(va, vb)})), 0) AS similarity, {join(f"{p} AS q{i}" for i, p in enumerate(prod))} FROM {table} a JOIN {table} b ON a.{key} < b.{key}),
total AS (SELECT *, q0 + q1 + q2 + q3 + q4 + q5 + q6 AS t FROM prod),
part1 AS (SELECT *, CASE WHEN t > 0 THEN t ELSE 1 END AS u FROM total),
part2 AS (SELECT a, b, similarity, q0 / u + q1 / u + q2 / u AS entropy, q3 / u AS structural, q4 / u AS temporal, q5 / u AS density, q6 / u AS rest FROM part1),
part3 AS (SELECT *, entropy + structural + temporal + density AS base FROM part2),
pairs AS (SELECT a, b, similarity, {join(dealt)} FROM part3)"""


COUPLING = f"""{LINKS},
bv AS (SELECT p_brand AS capability, avg(l_discount) AS tool_entropy, avg(l_tax) AS phase_entropy, avg(l_quantity / 50.0) AS transition_entropy, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS loop_ratio,
  avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS backtrack_ratio, avg(l_linenumber / 7.0::DOUBLE) AS burst_ratio, 1.0::DOUBLE AS stability FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
{pairs("bv", "capability")},
ce AS (SELECT p.a AS cap_a, p.b AS cap_b, similarity, entropy, structural, temporal, density, coalesce(e.fused, 0) AS fused, coalesce(e.fused, 0) * (1 + 0.3::DOUBLE * similarity) AS correlation FROM pairs p LEFT JOIN evidence e ON e.cap_a = p.a AND e.cap_b = p.b),
ends AS (SELECT cap_a AS capability, cap_b AS other, 'out' AS direction, correlation FROM ce UNION ALL SELECT cap_b, cap_a, 'in', correlation FROM ce)"""
TRIALS = """
trials AS (SELECT o_custkey AS task_id, CAST(row_number() OVER w AS INTEGER) AS trial, o_orderkey AS eval_id, CASE o_orderstatus WHEN 'F' THEN 'Pass' WHEN 'O' THEN 'Fail' ELSE 'Partial' END AS outcome, o_totalprice AS metric FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
prev AS (SELECT *, lag(outcome) OVER w AS prev_outcome, lag(metric) OVER w AS prev_metric, lag(eval_id) OVER w AS prev_eval, lead(trial) OVER w IS NULL AS last FROM trials WINDOW w AS (PARTITION BY task_id ORDER BY trial))"""
TREND = "CASE WHEN prev_outcome IS NULL THEN NULL WHEN prev_outcome = 'Pass' AND outcome = 'Pass' THEN 'Stable' WHEN outcome = 'Pass' THEN 'Improved' WHEN prev_outcome = 'Pass' THEN 'Degraded' ELSE 'Stable' END"
TRACES = """
traces AS (SELECT trace_id, count(*) AS n_calls, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, min(ts) AS started_at, max(ts) AS finished_at, list_sort(list(DISTINCT tool_name)) AS tools FROM calls GROUP BY ALL)"""
PAIRS = """
tp AS (SELECT DISTINCT trace_id AS pair_id, trace_id AS trace_a, trace_id + 1 AS trace_b FROM calls WHERE trace_id % 2 = 1 AND trace_id + 1 IN (SELECT trace_id FROM calls))"""
MATCH = f"""{PAIRS},
nth AS (SELECT *, row_number() OVER (PARTITION BY trace_id, label ORDER BY run_idx) AS nth FROM runs),
sa AS (SELECT pair_id, label, nth, run_idx AS run_a FROM tp JOIN nth ON nth.trace_id = trace_a),
sb AS (SELECT pair_id, label, nth, run_idx AS run_b FROM tp JOIN nth ON nth.trace_id = trace_b),
matched AS (SELECT pair_id, label, nth, run_a, run_b, CASE WHEN run_a IS NULL THEN 'added' WHEN run_b IS NULL THEN 'deleted' ELSE 'matched' END AS kind FROM sa FULL JOIN sb USING (pair_id, label, nth))"""


def rows(name: str, cols: str, data) -> str:
    lit = lambda x: "[" + join(map(lit, x)) + "]::VARCHAR[]" if isinstance(x, list) else f"'{x}'"
    return f"{name}({cols}) AS (VALUES {join('(' + join(map(lit, r)) + ')' for r in data)})"


DAG = f"nodes AS ({G.NODES}), edges AS ({G.EDGES})"
CASES = "expected AS ({}), actual AS ({})".format(*G.case_tables("[{}]::VARCHAR[]"))
EXACT = f"""{CASES},
miss AS (SELECT case_id, count(*) AS n_missing FROM expected e WHERE NOT EXISTS (SELECT 1 FROM actual a WHERE a.case_id = e.case_id AND a.name = e.name AND a.status = e.status AND a.categories = e.categories) GROUP BY ALL),
extra AS (SELECT case_id, count(*) AS n_extra FROM actual a WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE a.case_id = e.case_id AND a.name = e.name) GROUP BY ALL),
exact0 AS (SELECT case_id, coalesce(n_expected, 0) AS n_expected, coalesce(n_actual, 0) AS n_actual, coalesce(n_missing, 0) AS n_missing, coalesce(n_extra, 0) AS n_extra FROM (SELECT case_id, count(*) AS n_expected FROM expected GROUP BY ALL) e
  FULL JOIN (SELECT case_id, count(*) AS n_actual FROM actual GROUP BY ALL) a USING (case_id) LEFT JOIN miss USING (case_id) LEFT JOIN extra USING (case_id)),
exact AS (SELECT *, n_missing = 0 AND NOT (n_actual > n_expected AND n_extra > 0) AS exact FROM exact0)"""
JACC = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[_\\- ]+'), lambda x: strlen(x) >= 2)"
SEMANTIC = f"""{EXACT},
et AS (SELECT *, {TOKENS.format("name")} AS t, list_transform(categories, lambda x: lower(x)) AS c FROM expected), atok AS (SELECT *, {TOKENS.format("name")} AS t, list_transform(categories, lambda x: lower(x)) AS c FROM actual),
scores AS (SELECT e.case_id, e.name AS expected, e.categories AS wanted, a.name AS actual, CASE WHEN lower(e.name) = lower(a.name) OR len(e.t) = 0 AND len(a.t) = 0 THEN 1.0::DOUBLE ELSE {JACC.format(a="e.t", b="a.t")} END AS names,
  CASE WHEN len(e.c) = 0 THEN 1.0::DOUBLE WHEN len(a.c) = 0 THEN 0 ELSE len(list_intersect(e.c, a.c)) / len(list_distinct(list_concat(e.c, a.c))) END AS cats FROM et e LEFT JOIN atok a USING (case_id)),
sem AS (SELECT case_id, avg(s) AS similarity FROM (SELECT case_id, expected, wanted, max(CASE WHEN actual IS NULL THEN 0 ELSE 0.7::DOUBLE * names + 0.3::DOUBLE * cats END) AS s FROM scores GROUP BY ALL) GROUP BY ALL),
verdicts AS (SELECT case_id, coalesce(similarity, 0) AS similarity, CASE WHEN exact THEN 'pass' WHEN round(similarity, 9) > 0.85 THEN 'semantic_pass' ELSE 'fail' END AS verdict FROM exact LEFT JOIN sem USING (case_id))"""


def r(*names, digits=6):
    return join(f"round({n}, {digits}) AS {n}" for n in names)


SAME = join((f"CASE WHEN tool_{c} > 0 THEN -tool_{c} * log2(tool_{c}) ELSE 0 END" for c in CATEGORIES), "+")
CORR = join((f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, CASE WHEN var_pop({x}) > 1e-12 AND var_pop({y}) > 1e-12 THEN round(least(1, greatest(-1, covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})))), 5) ELSE 0 END AS r FROM vecs HAVING count(*) >= 2" for i, x in enumerate(VECTOR) for y in VECTOR[i:]), " UNION ALL ")
CURVE = f"""{GRAPH},
grid AS (SELECT trace_id, n, CAST(unnest(range(10)) AS INTEGER) AS w FROM totals),
curve AS (SELECT g.trace_id, g.w AS "window", count(s.trace_id) AS n_states, coalesce(avg(s.edit_density), 0) AS edit_density FROM grid g LEFT JOIN states s ON s.trace_id = g.trace_id
  AND (s.first_idx + s.last_idx + 1) // 2 >= g.w * g.n // 10 AND (s.first_idx + s.last_idx + 1) // 2 < (g.w + 1) * g.n // 10 GROUP BY ALL)"""
VERDICT = f"""{GRAPH},
sm AS (SELECT trace_id, avg(h) AS phase_entropy, coalesce(sum(same) / nullif(count(*) - 1, 0), 0) AS loop_ratio, count(*) AS state_count FROM (SELECT trace_id, {SAME} AS h, CAST(lag(primary_phase) OVER w = primary_phase AS INTEGER) AS same FROM states WINDOW w AS (PARTITION BY trace_id ORDER BY state_idx)) GROUP BY ALL),
v AS (SELECT trace_id, primary_phase AS b, lag(primary_phase) OVER w AS a, lag(primary_phase, 2) OVER w AS z FROM states WINDOW w AS (PARTITION BY trace_id ORDER BY state_idx)),
osc AS (SELECT trace_id, CAST(coalesce(sum(CAST(z = b AND a <> b AS INTEGER)), 0) AS BIGINT) AS oscillations, count(*) - 1 AS transitions FROM v GROUP BY ALL),
e AS (SELECT trace_id, a, b, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY trace_id) AS p FROM v WHERE a IS NOT NULL GROUP BY trace_id, a, b),
rev AS (SELECT trace_id, {ENTROPY} AS transition_entropy, avg(CASE WHEN EXISTS (SELECT 1 FROM e f WHERE f.trace_id = e.trace_id AND f.a = e.b AND f.b = e.a) THEN 1.0::DOUBLE ELSE 0 END) AS reversal_ratio FROM e GROUP BY ALL),
m AS (SELECT sm.*, oscillations, transitions, coalesce(transition_entropy, 0) AS transition_entropy, coalesce(reversal_ratio, 0) AS reversal_ratio FROM sm JOIN osc USING (trace_id) LEFT JOIN rev USING (trace_id)),
h AS (SELECT *, list_filter([CASE WHEN phase_entropy > 1.5 THEN 'SE001:high' END, CASE WHEN loop_ratio > 0.5 THEN 'SE002:high' END, CASE WHEN oscillations > 3 THEN 'TE001:medium' END, CASE WHEN reversal_ratio > 0.6 THEN 'TE002:high' END], lambda x: x IS NOT NULL) AS l FROM m)"""
BACK = f"""{GRAPH},
seq0 AS (SELECT trace_id, state_idx, primary_phase AS x, lag(primary_phase) OVER (PARTITION BY trace_id ORDER BY state_idx) AS p FROM states),
seq AS (SELECT trace_id, x, coalesce(lag(x, 1) OVER w = x, false) OR coalesce(lag(x, 2) OVER w = x, false) OR coalesce(lag(x, 3) OVER w = x, false) AS hit FROM seq0 WHERE p IS NULL OR p <> x WINDOW w AS (PARTITION BY trace_id ORDER BY state_idx))"""


def cycle_sql(edges: str) -> str:
    """Cycles of 2 to 5 edges over e(g, a, b), each from its least node."""
    out = []
    for n in range(2, 6):
        frm = "e e1 " + " ".join(f"JOIN e e{i} ON e{i}.g = e1.g AND e{i}.a = e{i - 1}.b" for i in range(2, n + 1))
        cond = [f"e{n}.b = e1.a", *(f"e{i}.a > e1.a" for i in range(2, n + 1)), *(f"e{i}.a <> e{j}.a" for i in range(2, n + 1) for j in range(2, i))]
        least = f"least({join(f'e{i}.n' for i in range(1, n + 1))})"
        out.append(f"SELECT e1.g AS graph, concat_ws('>', {join(f'e{i}.a' for i in range(1, n + 1))}) AS path, {n} AS length, {least} AS times FROM {frm} WHERE {join(cond, ' AND ')}")
    return f"e AS ({edges}), cyc AS ({join(out, ' UNION ALL ')})"


RED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)(api_?key|apikey)[=:]\\s*[^\\s,;]+', 'api_key=***REDACTED***', 'g'), '(?i)(token|secret|password)[=:]\\s*[^\\s,;]+', '\\1=***REDACTED***', 'g'), '(?i)(authorization|auth)[=:]\\s*[^\\s,;]+', '\\1=***REDACTED***', 'g'), '(?i)bearer\\s+[^\\s,;]+', 'Bearer ***REDACTED***', 'g')"
ORACLES: dict[str, str] = {
    "state_segments": f"WITH {BASE} SELECT * FROM segs",
    "idle_gap_default": f"WITH {CALLS},{segments(10000)} SELECT boundary_reason, count(*) AS n, max(n_calls) AS longest FROM segs GROUP BY ALL",
    "segment_reasons": f"WITH {BASE} SELECT boundary_reason, category, count(*) AS n FROM segs GROUP BY ALL",
    "state_candidates": f"WITH {GRAPH} SELECT * FROM cands",
    "state_features": f"WITH {GRAPH} SELECT trace_id, candidate_idx, first_idx, last_idx, n_calls, {r(*MEANS)} FROM feats",
    "behavior_states": f"WITH {GRAPH} SELECT trace_id, state_idx, first_idx, last_idx, n_candidates, primary_phase, {r('stability', 'edit_density', 'read_write_ratio', 'failure_rate')} FROM states",
    "transitions": f"WITH {GRAPH} SELECT trace_id, pos AS \"at\", 's' || pos AS from_state, 's' || nxt AS to_state, from_phase, to_phase, CASE to_phase WHEN 'locate' THEN 'read' WHEN 'modify' THEN 'edit' WHEN 'verify' THEN 'test' WHEN 'commit' THEN 'commit' ELSE 'unknown' END AS trigger_tool FROM trans WHERE nxt IS NOT NULL",
    "transition_edges": f"WITH {GRAPH} SELECT trace_id, from_phase, to_phase, count(*) AS n, count(*)::DOUBLE AS avg_cost FROM trans WHERE nxt IS NOT NULL GROUP BY ALL",
    "behavior_verdict": f"WITH {VERDICT} SELECT trace_id, {r('phase_entropy', 'loop_ratio', 'transition_entropy', 'reversal_ratio')}, state_count, oscillations, transitions, array_to_string(l, ',') AS hits, CASE WHEN len(list_filter(l, lambda x: x LIKE '%:high')) > 0 THEN 'Degraded' WHEN len(l) >= 2 THEN 'Watch' ELSE 'Pass' END AS verdict FROM h",
    "tool_entropy": f"WITH {FULL} SELECT trace_id, {r('tool_entropy')} FROM tent",
    "burst_ratio": f"WITH {FULL} SELECT trace_id, longest, n_calls, {r('burst_ratio')} FROM burst",
    "backtrack_ratio": f"WITH {BACK} SELECT trace_id, round(coalesce(sum(CAST(hit AS INTEGER)) / nullif(count(*) - 1, 0), 0), 6) AS backtrack_ratio FROM seq GROUP BY ALL",
    "edit_curve": f'WITH {CURVE} SELECT trace_id, "window", n_states, {r("edit_density")} FROM curve',
    "edit_curve_stats": f'WITH {CURVE}, d AS (SELECT *, edit_density - lag(edit_density) OVER (PARTITION BY trace_id ORDER BY "window") AS d FROM curve) SELECT trace_id, round(avg(edit_density), 6) AS edit_mean, round(min(edit_density), 6) AS edit_min, round(max(edit_density), 6) AS edit_max, round(avg(d), 6) AS slope_mean, round(min(d), 6) AS slope_min, round(max(d), 6) AS slope_max FROM d GROUP BY ALL',
    "phase_loop_ratio": f"WITH {GRAPH}, {cycle_sql('SELECT trace_id AS g, from_phase AS a, to_phase AS b, count(*) AS n FROM trans WHERE nxt IS NOT NULL AND from_phase <> to_phase GROUP BY ALL')}, l AS (SELECT graph, sum(times) AS loops FROM cyc GROUP BY ALL), t AS (SELECT trace_id, count(*) AS n FROM trans WHERE nxt IS NOT NULL GROUP BY ALL) SELECT trace_id, round(least(1.0, coalesce(loops, 0) / n), 6) AS loop_ratio FROM t LEFT JOIN l ON l.graph = t.trace_id",
    "trajectory_vector": f"WITH {FULL} SELECT trace_id, {r(*VECTOR)} FROM vecs",
    "vector_similarity": f"WITH {FULL},{pairs('vecs', 'trace_id')} SELECT a, b, {r('similarity', *GROUPS, digits=5)} FROM pairs",
    "anomaly_rank": f"WITH {FULL}, m AS (SELECT {join(f'avg({c}) AS m_{c}' for c in VECTOR)}, count(*) AS n FROM vecs) SELECT trace_id, round(sqrt({join((f'({c} - m_{c}) * ({c} - m_{c})' for c in VECTOR), '+')}), 6) AS distance FROM vecs, m WHERE n >= 3",
    "feature_correlation": f"WITH {FULL} {CORR}",
    "capability_vectors": f"WITH {FULL} SELECT 'cap_' || lpad((trace_id % 12)::VARCHAR, 2, '0') AS capability, {join(f'round(avg({c}), 6) AS {c}' for c in VECTOR)}, count(*) AS n_vectors FROM vecs GROUP BY 1",
    "cochange_scores": f"WITH {LINKS} SELECT cap_a, cap_b, cooccur, {r('commit_score', 'file_score', 'session_score', 'fused')} FROM evidence",
    "coupling_edges": f"WITH {COUPLING} SELECT cap_a, cap_b, {r('similarity', *GROUPS, 'fused', 'correlation')} FROM ce",
    "coupling_pruned": f"WITH {COUPLING}, k AS (SELECT *, row_number() OVER (PARTITION BY cap_a ORDER BY correlation DESC, cap_b) AS o, row_number() OVER (PARTITION BY cap_b ORDER BY correlation DESC, cap_a) AS i FROM ce WHERE fused > 0.01 AND fused / (fused + similarity * 0.3::DOUBLE + 1e-6) >= 0.3::DOUBLE) SELECT cap_a, cap_b, {r('correlation')} FROM k WHERE o <= 5 OR i <= 5",
    "coupling_strength": f"WITH {COUPLING} SELECT capability, count(*) AS n_edges, round(sum(correlation), 6) AS total, round(greatest(0, max(correlation)), 6) AS strongest, round(avg(correlation), 6) AS mean, round(stddev_pop(correlation), 6) AS spread FROM ends GROUP BY ALL",
    "coupling_impact": f"WITH {COUPLING} SELECT other, direction, {r('correlation')} FROM (SELECT * FROM ends WHERE capability = 'Brand#11' ORDER BY correlation DESC, other LIMIT 10)",
    "top_couplings": f"WITH {COUPLING} SELECT cap_a, cap_b, {r('correlation')} FROM (SELECT * FROM ce ORDER BY correlation DESC, cap_a, cap_b LIMIT 10)",
    "trace_summary": f"WITH {CALLS},{TRACES} SELECT trace_id, n_calls, tokens, duration_ms, started_at, finished_at, array_to_string(tools, ',') AS tools, datesub('millisecond', started_at, finished_at) AS elapsed_ms FROM traces",
    "trace_list": f"WITH {CALLS},{TRACES} SELECT trace_id, started_at, n_calls, tokens FROM traces WHERE list_contains(tools, 'cargo') AND started_at >= TIMESTAMP '2020-01-01' ORDER BY started_at DESC, trace_id LIMIT 100 OFFSET 3",
    "trace_latest": "SELECT o_custkey AS id, o_orderkey AS version, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND o_orderstatus <> 'P'",
    "trace_ids": f"WITH {CALLS},{TRACES} SELECT trace_id, 'trace_' || strftime(started_at, '%Y%m%d') || '_' || lpad(n::VARCHAR, CAST(greatest(3, length(n::VARCHAR)) AS INTEGER), '0') AS id FROM (SELECT *, row_number() OVER (PARTITION BY started_at::DATE ORDER BY started_at, trace_id) AS n FROM traces)",
    "phase_runs": f"WITH {CALLS},{RUNS} SELECT * FROM runs",
    "segment_match": f"WITH {CALLS},{RUNS},{MATCH} SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY coalesce(run_b, run_a), run_b IS NULL, run_a NULLS FIRST, label) - 1 AS INTEGER) AS match_id, label, kind, run_a, run_b FROM matched",
    "positional_state_diff": f"WITH {GRAPH},{PAIRS}, a AS (SELECT pair_id, state_idx, primary_phase AS phase_a, stability AS stability_a FROM tp JOIN states s ON s.trace_id = trace_a), b AS (SELECT pair_id, state_idx, primary_phase AS phase_b, stability AS stability_b FROM tp JOIN states s ON s.trace_id = trace_b) SELECT pair_id, state_idx, phase_a, {r('stability_a')}, phase_b, {r('stability_b')}, CASE WHEN phase_a IS NULL THEN 'added' WHEN phase_b IS NULL THEN 'deleted' WHEN phase_a <> phase_b THEN 'modified' ELSE 'unchanged' END AS kind FROM a FULL JOIN b USING (pair_id, state_idx)",
    "outcome_rollup": "SELECT task_id, n, n_passed, n_failed, CASE WHEN n = 0 THEN 'N/A' WHEN n_failed = 0 THEN 'Pass' WHEN n_passed > 0 THEN 'Partial' ELSE 'Fail' END AS outcome FROM (SELECT l_orderkey AS task_id, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS n_passed, count(*) FILTER (l_returnflag = 'R') AS n_failed FROM lineitem GROUP BY ALL)",
    "eval_trend": f"WITH {TRIALS} SELECT task_id, trial, eval_id, outcome, prev_outcome, {TREND} AS trend FROM prev",
    "eval_compare": f"WITH {TRIALS}, d AS (SELECT *, CASE WHEN prev_metric = 0 THEN CASE WHEN metric = 0 THEN 0.0 ELSE 100.0 END ELSE (metric - prev_metric) / prev_metric * 100 END AS pct FROM prev WHERE last AND prev_eval IS NOT NULL) SELECT task_id, prev_eval AS from_eval, eval_id AS to_eval, round(prev_metric, 6) AS from_value, round(metric, 6) AS to_value, round(pct, 6) AS change_pct, CASE WHEN pct > 5 THEN 'Up' WHEN pct < -5 THEN 'Down' ELSE 'Flat' END AS direction, {TREND} AS trend FROM d",
    "eval_regression": f"WITH {TRIALS} SELECT task_id, prev_eval AS from_eval, eval_id AS to_eval, prev_outcome AS from_outcome, outcome AS to_outcome, CASE WHEN prev_outcome = 'Pass' AND outcome = 'Fail' THEN 'Critical' WHEN prev_outcome = 'Fail' THEN 'Medium' ELSE 'High' END AS severity, prev_outcome = 'Fail' AS is_improvement FROM prev WHERE last AND (prev_outcome, outcome) IN (('Pass', 'Fail'), ('Pass', 'Partial'), ('Partial', 'Fail'), ('Fail', 'Partial'))",
    "trend_history": f"WITH {TRIALS} SELECT task_id, trial, outcome, coalesce(c_name, 'Unknown task') AS description FROM trials LEFT JOIN customer ON c_custkey = task_id AND c_acctbal > 0",
    "trend_anomaly_2sigma": f"WITH {TRIALS}, w AS (SELECT *, count(metric) OVER b AS n_before, avg(metric) OVER b AS mean_before, stddev_pop(metric) OVER b AS sd_before FROM trials WINDOW b AS (PARTITION BY task_id ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT task_id, trial, n_before, {r('mean_before')}, {r('sd_before', digits=3)} FROM w WHERE n_before >= 3 AND sd_before > 0 AND abs(metric - mean_before) > 2 * sd_before",
    "document_rules": "SELECT rule_id, severity, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN lower(text) LIKE '%sql%' THEN {'rule_id': 'sec_sql_001', 'severity': 'high'} END, CASE WHEN lower(text) LIKE '%deprecat%' THEN {'rule_id': 'deprec_001', 'severity': 'low'} END, CASE WHEN lower(text) LIKE '%todo%' OR lower(text) LIKE '%fixme%' THEN {'rule_id': 'deprec_002', 'severity': 'low'} END], lambda x: x IS NOT NULL), recursive := true) FROM (SELECT text || CASE doc_id % 5 WHEN 0 THEN ' -- TODO' WHEN 1 THEN ' in Sql' WHEN 2 THEN ' deprecated, fixme' ELSE '' END AS text FROM documents)) GROUP BY ALL",
    "symbol_links": "WITH s AS (SELECT DISTINCT l_partkey AS f, l_suppkey AS s FROM lineitem) SELECT a.s AS symbol, b.s AS other, count(*) AS n_files FROM s a JOIN s b ON a.f = b.f AND a.s < b.s GROUP BY ALL",
    "fan_in_out": """WITH e0 AS (SELECT 'c' || o_custkey AS node, 's' || l_suppkey AS dep FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT * FROM e0 UNION ALL SELECT dep, node FROM e0),
      o AS (SELECT node, count(*) AS fan_out FROM e GROUP BY ALL), i AS (SELECT dep AS node, count(*) AS fan_in FROM e GROUP BY ALL) SELECT node, fan_out, coalesce(fan_in, 0) AS fan_in,
      fan_out + coalesce(fan_in, 0) > 10 AS high_coupling, CASE WHEN fan_out + coalesce(fan_in, 0) > 20 THEN 'high' WHEN fan_out + coalesce(fan_in, 0) > 10 THEN 'medium' ELSE 'low' END AS risk FROM o LEFT JOIN i USING (node)""",
    "dag_layers": f"WITH RECURSIVE {DAG}, walk AS (SELECT graph, node, 0 AS layer FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph = n.graph AND e.node = n.node) UNION SELECT e.graph, e.node, w.layer + 1 FROM walk w JOIN edges e ON e.graph = w.graph AND e.dep = w.node WHERE w.layer < 20), tops AS (SELECT graph, node, max(layer) AS layer FROM walk GROUP BY ALL), lost AS (SELECT graph, node FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.graph = e.graph AND n.node = e.dep) UNION SELECT e.graph, e.node FROM lost b JOIN edges e ON e.graph = b.graph AND e.dep = b.node) SELECT n.graph, n.node, CAST(CASE WHEN (n.graph, n.node) IN (SELECT (graph, node) FROM lost) THEN -1 ELSE coalesce(t.layer, -1) END AS INTEGER) AS layer FROM nodes n LEFT JOIN tops t USING (graph, node)",
    "graph_cycles": f"WITH {DAG}, {cycle_sql('SELECT DISTINCT graph AS g, node AS a, dep AS b, 1 AS n FROM edges')} SELECT graph, path, length FROM cyc",
    "blocked_nodes": f"WITH RECURSIVE {DAG}, bad AS (SELECT graph, node FROM edges e WHERE dep = 'n2' OR NOT EXISTS (SELECT 1 FROM nodes n WHERE n.graph = e.graph AND n.node = e.dep) UNION SELECT e.graph, e.node FROM bad b JOIN edges e ON e.graph = b.graph AND e.dep = b.node) SELECT DISTINCT graph, node FROM bad",
    "missing_dependencies": f"WITH {DAG} SELECT node, dep FROM edges WHERE dep NOT IN (SELECT node FROM nodes)",
    "cluster_quality": f"WITH {FULL},{pairs('vecs', 'trace_id')} SELECT (SELECT count(DISTINCT trace_id % 3) FROM vecs) AS n_clusters, CASE WHEN (SELECT count(DISTINCT trace_id % 3) FROM vecs) < 2 THEN 1.0 ELSE round(coalesce(avg(similarity) FILTER (a % 3 = b % 3), 0) - coalesce(avg(similarity) FILTER (a % 3 <> b % 3), 0), 6) END AS quality FROM pairs",
    "exact_match": f"WITH {EXACT} SELECT * FROM exact",
    "semantic_match": f"WITH {SEMANTIC} SELECT case_id, {r('similarity')}, verdict FROM verdicts",
    "best_matches": f"WITH {SEMANTIC} SELECT case_id, expected, actual, round(names, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY case_id, expected ORDER BY names DESC, actual) AS n FROM scores) WHERE n = 1",
    "validation_suite": f"WITH {SEMANTIC} SELECT count(*) AS total, count(*) FILTER (verdict = 'pass') AS passed, count(*) FILTER (verdict = 'semantic_pass') AS semantic, count(*) FILTER (verdict = 'fail') AS failed, round(count(*) FILTER (verdict <> 'fail') / count(*), 6) AS rate FROM verdicts",
    "redact_text": f"SELECT doc_id, md5({RED.format('t')}) AS digest, {RED.format('text')} <> text AS changed FROM (SELECT doc_id, text, text || ' token=' || doc_id || '; Authorization: Bearer abc, x' AS t FROM documents)",
    "sparse_roundtrip": "SELECT vec_id, len(list_filter(embedding, lambda x: abs(x) > 0.1)) AS n_set, round(list_sum(list_transform(list_filter(embedding, lambda x: abs(x) > 0.1), lambda x: x::DOUBLE)), 4) AS total, true AS same FROM embeddings",
    "embedding_similarity": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), j AS (SELECT a.vec_id, a.v, b.v AS w FROM v a JOIN v b ON b.vec_id = a.vec_id + 1), m AS (SELECT *, list_transform(list_zip(v, w), lambda z: [least(abs(z[1]), abs(z[2])), greatest(abs(z[1]), abs(z[2]))]) AS z FROM j) SELECT vec_id, round(list_cosine_similarity(v, w), 5) AS cosine, round(list_sum(list_transform(z, lambda x: x[1])) / list_sum(list_transform(z, lambda x: x[2])), 5) AS jaccard FROM m",
    "message_categories": "WITH m AS (SELECT role, lower(text) AS t FROM conversations) SELECT role, CASE WHEN t LIKE '%fix%' OR t LIKE '%bug%' THEN 'bug_fix' WHEN t LIKE '%refactor%' OR t LIKE '%clean%' THEN 'refactor' WHEN t LIKE '%test%' OR t LIKE '%spec%' THEN 'test' WHEN t LIKE '%doc%' OR t LIKE '%readme%' THEN 'doc' WHEN t LIKE '%feat%' OR t LIKE '%add%' THEN 'feature' ELSE 'general' END AS category, count(*) AS n FROM m GROUP BY ALL",
    "idle_sessions": f"WITH {CALLS}, g AS (SELECT trace_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM calls WINDOW w AS (PARTITION BY trace_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT trace_id, min(ts) AS started_at, count(*) AS n_calls FROM s GROUP BY trace_id, s",
}
