"""Inputs for the operators on code, made from the star-schema tables: paths, sources, diffs, graphs and cases, a few rows an order or part.

Each is a SELECT in the part of SQL that Spark and other engines share, so that a check elsewhere can start from the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .views import table

ITEMS_A_TASK = 250_000
TABLES = ("orders", "lineitem", "part", "customer", "supplier", "conversations")


def path_of(n: str) -> str:
    """A file path of one of fourteen shapes for a number."""
    a, c = f"CAST({n} % 7 AS STRING)", f"CAST({n} AS STRING)"
    shapes = (
        ("src/m", a, "/f", c, ".rs"), ("src/f", c, ".rs"), ("crates/k", a, "/src/f", c, ".rs"), ("crates/k", a), ("README", a, ".md"),
        ("tests/t", a, "/f", c, ".py"), ("./src/m", a, "/f", c, ".TS"), ("lib/m", a, ".x/f", c, ".mjs"), ("app/src/f", c, ".go"), ("m", a, ".d/f", c),
        ("/abs/m", a, "/f", c, ".java"), ("src/m", a, "/d/f", c, ".JSX"), ("src/",), ("bin/f", c, ".rs.bak"),
    )
    text = lambda shape: " || ".join(x if x in (a, c) else f"'{x}'" for x in shape)
    return f"CASE {n} % 14 " + " ".join(f"WHEN {k} THEN {text(s)}" for k, s in enumerate(shapes)) + " END"


PATHS = f"SELECT o_orderkey AS n, o_custkey AS project, {path_of('o_orderkey')} AS path FROM orders"
FIRST = """CASE o_orderkey % 8 WHEN 0 THEN 'use crate::m' || CAST(o_orderkey % 7 AS STRING) || '::x;' WHEN 1 THEN 'use std::io;' WHEN 2 THEN 'use {a, b};'
  WHEN 3 THEN 'from src.m' || CAST(o_orderkey % 5 AS STRING) || ' import y' WHEN 4 THEN 'import lib' WHEN 5 THEN 'const x = require(''tests/m'') ;'
  WHEN 6 THEN '  use super::app::f::{a, b};; ' ELSE 'use crate' END"""
SECOND = "CASE o_orderkey % 5 WHEN 0 THEN 'use m;' WHEN 1 THEN 'import crates.k' WHEN 2 THEN 'use crate;' WHEN 3 THEN 'let y = 1;' ELSE 'x = require(`bin' END"
SOURCES = f"SELECT o_custkey AS project, {path_of('o_orderkey')} AS file, {FIRST} AS first_line, {SECOND} AS second_line FROM orders"

SYMBOL = "CASE l_partkey % 6 WHEN 0 THEN 'login' WHEN 1 THEN 'hash_it' WHEN 2 THEN 'token' WHEN 3 THEN 'test_run' ELSE 'f' END || CAST(l_partkey AS STRING)"
HUNK_LINES = f"""SELECT l_orderkey AS diff_id, l_linenumber AS n, CASE WHEN l_linenumber <= 4 THEN 0 ELSE 1 END AS hunk_idx,
  CASE l_returnflag WHEN 'A' THEN 'add' WHEN 'R' THEN 'del' ELSE 'ctx' END AS line_kind, {SYMBOL} AS symbol, l_suppkey % 3 AS shape,
  CASE l_suppkey % 3 WHEN 0 THEN 'pub fn ' || {SYMBOL} || '(x: u8) {{' WHEN 1 THEN '    let y = ' || CAST(l_suppkey AS STRING) || ';' ELSE '// pub fn gone() TODO' END AS content FROM lineitem"""
CHANGES = "CASE o_orderkey % 4 WHEN 0 THEN 'modified' WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' ELSE 'renamed' END"
STARTS = ("CAST(o_custkey % 50 + 1 AS INT)", "CAST(o_custkey % 40 + 2 AS INT)")  # of the first hunk on the old and the new side; the second: 100 more
NAME = "CASE o_orderkey % 8 WHEN 0 THEN 'log_metrics' WHEN 1 THEN 'serve' WHEN 2 THEN 'parseIt' WHEN 3 THEN 'api.Log_it' WHEN 4 THEN 'x.y.trace_format' WHEN 5 THEN 'fmt.reformat' WHEN 6 THEN 'lru_cache' ELSE 'debug.on' END"

# Lines that declare something in some language, or nothing: ~ is a name in lower case, ^ one that begins with a capital, | a tab, ` a quote.
DECLARATIONS = (
    "pub fn ~(x: u8) {", "pub async fn ~<T>(", "|pub struct ^", "pub enum ^ {", " pub trait ^", "use crate::~;", "pub const ^ : u8 = 1;", "export async function ~(", "export class ^ {", "class ^:", "import ~ from `./~`",
    "  def ~(", "def _~(", "class ^(", "func ^(", "func ~(", "type ^ struct {", "public class ^ {", "private static int ~(", "app.get(`/~`)", "|// app.post(`/~`) TODO", "+ MAX_A = 1", "| # def ~(", "let y = 1; // Sql deprecated",
    "r.delete( `/api/~` ) -- sql Deprecated", "def __~(", "x.Patch(`/a/~`) fixme", "", "export function ~<", "||use super::~;", "- LIMIT: 2", "protected final String ~ (",
)
DECLARED_NAME = "CASE CAST(l_partkey % 9 AS INT) WHEN 0 THEN 'login' WHEN 1 THEN 'guard' WHEN 2 THEN 'hash' WHEN 3 THEN 'token' WHEN 4 THEN 'test_it' WHEN 5 THEN 'jwt' WHEN 6 THEN 'permission' WHEN 7 THEN 'encrypt' ELSE 'f' END || CAST(l_partkey % 3 AS STRING)"


def _declared(template: str) -> str:
    parts = {"~": f"' || {DECLARED_NAME} || '", "^": f"' || upper(substring({DECLARED_NAME}, 1, 1)) || substring({DECLARED_NAME}, 2) || '", "|": "' || chr(9) || '", "`": "' || chr(39) || '"}
    return "'" + "".join(parts.get(c, c) for c in template) + "'"


DECLARED_LINES = f"""SELECT l_orderkey AS diff_id, l_linenumber AS n, CASE WHEN l_linenumber <= 4 THEN 0 ELSE 1 END AS hunk_idx, CASE l_returnflag WHEN 'A' THEN 'add' WHEN 'R' THEN 'del' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'add' ELSE 'ctx' END END AS line_kind,
  '' AS symbol, 0 AS shape, CASE CAST((l_partkey + l_suppkey * 5) % {len(DECLARATIONS)} AS INT) {" ".join(f"WHEN {k} THEN {_declared(t)}" for k, t in enumerate(DECLARATIONS))} END AS content FROM lineitem"""
DECLARED_PATH = "CASE CAST(o_orderkey % 11 AS INT) " + " ".join(f"WHEN {k} THEN '{a}' || CAST(o_orderkey AS STRING) || '{b}'" for k, (a, b) in enumerate((("src/m", ".rs"), ("web/f", ".ts"), ("web/f", ".JSX"), ("lib/x", ".py"), ("cmd/g", ".go"), ("java/J", ".java"), ("db/q", ".sql"), ("db/migration/v", ".txt"), ("db/Schema", ""), ("tests/a_test.", ".rs"), ("crates/k", "/src/z.rs")))) + " END"

GRAPH_NODES = "SELECT 'g' || CAST(CAST(floor(p_partkey / 50) AS INT) AS STRING) AS graph, CAST(p_partkey % 50 AS INT) AS j FROM part"
NODES = f"SELECT graph, 'n' || CAST(j AS STRING) AS node FROM ({GRAPH_NODES}) t"
EDGES = f"""SELECT graph, 'n' || CAST(j AS STRING) AS node, 'n' || CAST(CAST(floor(j / 2) AS INT) AS STRING) AS dep FROM ({GRAPH_NODES}) t WHERE j > 1
  UNION SELECT graph, 'n' || CAST(j AS STRING) AS node, 'n' || CAST(CAST(floor(j / 3) AS INT) AS STRING) AS dep FROM ({GRAPH_NODES}) t WHERE j > 2
  UNION SELECT graph, 'n' || CAST(j AS STRING) AS node, 'zz' || CAST(j AS STRING) AS dep FROM ({GRAPH_NODES}) t WHERE j % 37 = 36
  UNION SELECT graph, 'n1' AS node, 'n' || CAST(j AS STRING) AS dep FROM ({GRAPH_NODES}) t WHERE (graph LIKE '%3' OR graph LIKE '%7') AND j IN (4, 9)"""
SKILLS = f"""SELECT graph, 'n' || CAST(j AS STRING) AS node, CASE j % 23 WHEN 18 THEN 'failed' WHEN 21 THEN 'timed_out' ELSE 'ok' END AS outcome, CAST(j AS BIGINT) AS own,
  CASE WHEN j % 29 = 28 THEN 'in9' ELSE 'in' || CAST(j % 4 AS STRING) END AS input, CASE WHEN j % 17 = 13 THEN '1.1' ELSE '1.0' END AS version FROM ({GRAPH_NODES}) t"""

CALLED = """SELECT o_custkey AS graph, 'o' || CAST(o_orderkey AS STRING) AS source, 'p' || CAST(l_partkey AS STRING) AS target FROM (SELECT o_custkey, o_orderkey FROM orders) o, (SELECT l_orderkey, l_partkey FROM lineitem) l WHERE l_orderkey = o_orderkey
  UNION SELECT o_custkey AS graph, 'p' || CAST(l_partkey AS STRING) AS source, 'c' || CAST(o_custkey AS STRING) AS target FROM (SELECT o_custkey, o_orderkey FROM orders) o, (SELECT l_orderkey, l_partkey FROM lineitem) l WHERE l_orderkey = o_orderkey AND l_partkey % 40 = 0
  UNION SELECT o_custkey AS graph, 'c' || CAST(o_custkey AS STRING) AS source, 'o' || CAST(o_orderkey AS STRING) AS target FROM orders"""
CALLERS = "SELECT o_custkey AS graph, 'o' || CAST(o_orderkey AS STRING) AS node FROM orders"
_LINE, _SLASH = "', chr(10), '", "', chr(92), '"  # escapes in literals differ between engines
REPLY = """CASE CAST(conv_id * 3 + turn AS INT) % 9 WHEN 0 THEN concat('Here:~```json~{"path": "f', turn, '", "n": [1, 2, {"a": "}"}]}~```~', text)
  WHEN 1 THEN concat(text, '~```~text~[', turn, ', 2]~```') WHEN 2 THEN concat(' {"n": ', turn, '} ~') WHEN 3 THEN concat('say ', turn, ' {not} it: {"k": "v } ^" ]", "z": [1, {"y": null}]} and {"b": 2}')
  WHEN 4 THEN concat('{"broken": [1, 2', text) WHEN 5 THEN concat('[1, 2) }] then [', turn, '] "x') WHEN 6 THEN concat('{"a": [1}', turn, ' {"b": [true, false]}.') WHEN 7 THEN concat('```json {"a" ', turn, '}``` ') ELSE text END""".replace("~", _LINE).replace("^", _SLASH)

EVIDENCE_NAME = "CASE l_partkey % 4 WHEN 0 THEN 'login' WHEN 1 THEN 'hash_' WHEN 2 THEN 'a::tok' ELSE 'f' END || CAST(l_partkey % 12 AS STRING)"
EVIDENCE_SYMBOLS = f"SELECT o_custkey AS capability, {EVIDENCE_NAME} AS symbol, CASE WHEN l_returnflag = 'R' THEN 'private' ELSE 'pub' END AS visibility FROM (SELECT o_custkey, o_orderkey FROM orders) o, (SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem) l WHERE l_orderkey = o_orderkey"
EVIDENCE_RULES = "SELECT o_custkey AS capability, CASE WHEN o_orderstatus = 'F' THEN 'high' ELSE 'low' END AS severity FROM orders WHERE o_orderkey % 3 = 0"
EVIDENCE_TEXTS = """SELECT c_custkey AS capability, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'calls relogin' || CAST(c_custkey % 12 AS STRING) || '_x and hash_' || CAST(c_custkey % 11 AS STRING) || '.'
  WHEN 2 THEN 'see a::tok' || CAST(c_custkey % 12 AS STRING) || ', f' || CAST(c_custkey % 12 AS STRING) || ' ' || repeat('login', 20) || CAST(c_custkey % 12 AS STRING) WHEN 3 THEN CAST(NULL AS STRING) ELSE 'nothing, f1 f2 f3 f5 login0 login4 hash_1 hash_9' END AS fragment FROM customer"""

CAME_FROM = "CASE WHEN r = 1 THEN CAST(NULL AS INT) WHEN r % 9 = 3 THEN r * 2 WHEN r % 8 = 0 THEN -r ELSE CAST(floor(r / 2) AS INT) END"
VERSIONS = f"""SELECT c * 10 + r % 3 AS id, r AS version, CASE WHEN {CAME_FROM} IS NOT NULL THEN c * 10 + {CAME_FROM} % 3 END AS from_id, {CAME_FROM} AS from_version
  FROM (SELECT o_custkey AS c, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS r FROM orders) t"""

WORDS = "CASE {0} % 9 WHEN 0 THEN 'user_login' WHEN 1 THEN 'User Logout' WHEN 2 THEN 'get-health' WHEN 3 THEN 'delete_user' WHEN 4 THEN 'parseConfig' WHEN 5 THEN 'ParseConfig' WHEN 6 THEN 'parse_config' WHEN 7 THEN 'x' ELSE 'a_b_cc' END"
STATUS = "CASE {0} % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END"
CATEGORY_SETS = (("security",), ("breaking", "security"), ("Security",), ("domain", "performance"), ())


def categories(number: str, array: str) -> str:
    """An array of categories for a number; array: how the engine writes one of strings, with {} for its items."""
    sets = [array.format(", ".join(f"'{c}'" for c in s)) for s in CATEGORY_SETS]
    return f"CASE CAST({number} % {len(sets)} AS INT) " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(sets)) + " END"


def case_tables(array: str) -> tuple[str, str]:
    """Expected and actual capabilities: all lines of an order but each fourth, and all but each third."""
    line = "SELECT DISTINCT 'c' || CAST(l_orderkey AS STRING) AS case_id, {} AS name, {} AS status, {} AS categories FROM lineitem WHERE l_linenumber % {} <> 0"
    status = STATUS.format("l_partkey")
    return line.format(WORDS.format("l_partkey"), status, categories("l_partkey", array), 4), line.format(WORDS.format("(l_partkey + l_suppkey % 2)"), status, categories("(l_partkey + l_suppkey % 3)", array), 3)


_LINE, _SLASH = "', chr(10), '", "', chr(92), '"  # escapes in literals differ between engines
REPLY = """CASE CAST(conv_id * 3 + turn AS INT) % 9 WHEN 0 THEN concat('Here:~```json~{"path": "f', turn, '", "n": [1, 2, {"a": "}"}]}~```~', text)
  WHEN 1 THEN concat(text, '~```~text~[', turn, ', 2]~```') WHEN 2 THEN concat(' {"n": ', turn, '} ~') WHEN 3 THEN concat('say ', turn, ' {not} it: {"k": "v } ^" ]", "z": [1, {"y": null}]} and {"b": 2}')
  WHEN 4 THEN concat('{"broken": [1, 2', text) WHEN 5 THEN concat('[1, 2) }] then [', turn, '] "x') WHEN 6 THEN concat('{"a": [1}', turn, ' {"b": [true, false]}.') WHEN 7 THEN concat('```json {"a" ', turn, '}``` ') ELSE text END""".replace("~", _LINE).replace("^", _SLASH)

EVIDENCE_NAME = "CASE l_partkey % 4 WHEN 0 THEN 'login' WHEN 1 THEN 'hash_' WHEN 2 THEN 'a::tok' ELSE 'f' END || CAST(l_partkey % 12 AS STRING)"
EVIDENCE_SYMBOLS = f"SELECT o_custkey AS capability, {EVIDENCE_NAME} AS symbol, CASE WHEN l_returnflag = 'R' THEN 'private' ELSE 'pub' END AS visibility FROM (SELECT o_custkey, o_orderkey FROM orders) o, (SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem) l WHERE l_orderkey = o_orderkey"
EVIDENCE_RULES = "SELECT o_custkey AS capability, CASE WHEN o_orderstatus = 'F' THEN 'high' ELSE 'low' END AS severity FROM orders WHERE o_orderkey % 3 = 0"
EVIDENCE_TEXTS = """SELECT c_custkey AS capability, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'calls relogin' || CAST(c_custkey % 12 AS STRING) || '_x and hash_' || CAST(c_custkey % 11 AS STRING) || '.'
  WHEN 2 THEN 'see a::tok' || CAST(c_custkey % 12 AS STRING) || ', f' || CAST(c_custkey % 12 AS STRING) || ' ' || repeat('login', 20) || CAST(c_custkey % 12 AS STRING) WHEN 3 THEN CAST(NULL AS STRING) ELSE 'nothing, f1 f2 f3 f5 login0 login4 hash_1 hash_9' END AS fragment FROM customer"""

CAME_FROM = "CASE WHEN r = 1 THEN CAST(NULL AS INT) WHEN r % 9 = 3 THEN r * 2 WHEN r % 8 = 0 THEN -r ELSE CAST(floor(r / 2) AS INT) END"
VERSIONS = f"""SELECT c * 10 + r % 3 AS id, r AS version, CASE WHEN {CAME_FROM} IS NOT NULL THEN c * 10 + {CAME_FROM} % 3 END AS from_id, {CAME_FROM} AS from_version
  FROM (SELECT o_custkey AS c, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS r FROM orders) t"""

WORDS = "CASE {0} % 7 WHEN 0 THEN 'user_login' WHEN 1 THEN 'user logout' WHEN 2 THEN 'get-health' WHEN 3 THEN 'delete_user' WHEN 4 THEN 'parse_config' WHEN 5 THEN 'render_page' ELSE 'a_b_cc' END"
STATUS = "CASE {0} % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END"
EXPECTED = f"SELECT DISTINCT 'c' || CAST(l_orderkey AS STRING) AS case_id, {WORDS.format('l_partkey')} AS name, {STATUS.format('l_partkey')} AS status, {{}} AS categories FROM lineitem WHERE l_linenumber <= 3"
ACTUAL = f"SELECT DISTINCT 'c' || CAST(l_orderkey AS STRING) AS case_id, {WORDS.format('l_suppkey')} AS name, {STATUS.format('l_partkey')} AS status, {{}} AS categories FROM lineitem WHERE l_linenumber IN (1, 2, 4)"


def view(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """The SELECT over the tables of a folder."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if t in select}
    return spark.sql(select.replace(" FROM ", " FROM ") if not used else _named(select, used), **used)


def _named(select: str, used: dict[str, DataFrame]) -> str:
    import re

    return re.sub(r"\bFROM (" + "|".join(used) + r")\b", lambda m: "FROM {" + m[1] + "}", select.replace("{", "{{").replace("}", "}}"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, file, content."""
    return view(spark, sf_dir, SOURCES).selectExpr("project", "file", "concat(first_line, '\\n\\r\\n', second_line) AS content")


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """So many partitions that each holds about as many items at any size; coalescing by bytes would fill a task with millions of short rows."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // ITEMS_A_TASK))


def diffs(spark: SparkSession, sf_dir: str, hunk_lines: str = HUNK_LINES, path: str = path_of("o_orderkey")) -> DataFrame:
    """diff_id, diff: one file an order, a line an item, in hunks of at most four lines."""
    n = tasks(spark, sf_dir)
    lines = view(spark, sf_dir, hunk_lines)
    lines = lines.selectExpr("diff_id", "struct(hunk_idx, n, concat(CASE line_kind WHEN 'add' THEN '+' WHEN 'del' THEN '-' ELSE ' ' END, content) AS line) AS line").repartition(n, "diff_id")
    lines = lines.groupBy("diff_id").agg({"line": "collect_list"}).selectExpr("diff_id", "array_sort(`collect_list(line)`) AS lines")
    files = view(spark, sf_dir, f"SELECT o_orderkey AS diff_id, {path} AS file, {CHANGES} AS change, {STARTS[0]} AS a, {STARTS[1]} AS b, {NAME} AS name FROM orders").repartition(n, "diff_id")
    head = """concat('diff --git a/old.txt b/', file, '\\n', CASE change WHEN 'added' THEN 'new file mode 100644\\n' WHEN 'deleted' THEN 'deleted file mode 100644\\n' WHEN 'renamed' THEN concat('rename from old.txt\\nrename to ', file, '\\n') ELSE '' END,
      '--- ', CASE change WHEN 'added' THEN '/dev/null' WHEN 'deleted' THEN concat('a/', file) ELSE 'a/old.txt' END, '\\n+++ ', CASE change WHEN 'deleted' THEN '/dev/null' ELSE concat('b/', file) END)"""
    body = "array_join(transform(filter(lines, x -> x.hunk_idx = h), x -> x.line), '\\n')"
    hunks = f"transform(array_distinct(transform(lines, x -> x.hunk_idx)), h -> concat('@@ -', a + 100 * h, ',9 +', b + 100 * h, ' @@ ', name, '\\n', {body}))"
    return lines.join(files, "diff_id").selectExpr("diff_id", f"concat({head}, '\\n', array_join({hunks}, '\\n')) AS diff")


def dags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, NODES), view(spark, sf_dir, EDGES)


def cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected and actual capabilities."""
    expected, actual = case_tables("CAST(array({}) AS ARRAY<STRING>)")
    # Dealt by case before repeats go: what follows compares within a case.
    n = tasks(spark, sf_dir)
    return tuple(view(spark, sf_dir, s.replace("SELECT DISTINCT", "SELECT", 1)).repartition(n, "case_id").distinct() for s in (expected, actual))
