"""Unified diffs as tables of lines, symbols in changed lines, and rules over them. Everything is regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

# Patterns of declarations by language, in order of precedence: (pattern, group, added, removed, confidence added, removed).
SYMBOLS = {
    "rust": [
        (r"^\s*pub\s+(async\s+)?fn\s+(\w+)\s*([<(].*)$", 2, "function_added", "function_removed", 1.0, 1.0),
        (r"^\s*pub\s+struct\s+(\w+)", 1, "struct_added", "unknown", 1.0, 0.7),
        (r"^\s*pub\s+enum\s+(\w+)", 1, "enum_added", "unknown", 1.0, 0.7),
        (r"^\s*pub\s+trait\s+(\w+)", 1, "trait_added", "unknown", 1.0, 0.7),
        (r"^\s*use\s+(.+);", 1, "import_added", "import_removed", 0.95, 0.95),
        (r"^\s*pub\s+const\s+(\w+)\s*:", 1, "constant_added", "constant_removed", 0.9, 0.9),
    ],
    "typescript": [
        (r"^\s*export\s+(?:async\s+)?function\s+(\w+)", 1, "function_added", "function_removed", 0.95, 0.95),
        (r"^\s*(?:export\s+)?class\s+(\w+)", 1, "struct_added", "unknown", 1.0, 0.7),
        (r"^\s*import\s+(.+)\s+from\s+['\"](\S+)['\"]", 1, "import_added", "import_removed", 0.95, 0.95),
    ],
    "python": [
        (r"^\s*def\s+(\w+)\s*[<(]", 1, "function_added", "function_removed", 0.95, 0.95),
        (r"^\s*class\s+(\w+)\s*[:(]", 1, "struct_added", "unknown", 1.0, 0.7),
    ],
    "go": [
        (r"^\s*func\s+(\w+)\s*[<(]", 1, "function_added", "function_removed", 0.95, 0.95),
        (r"^\s*type\s+(\w+)\s+struct", 1, "struct_added", "unknown", 1.0, 0.7),
    ],
    "java": [
        (r"^\s*(?:public\s+)?class\s+(\w+)", 1, "struct_added", "unknown", 1.0, 0.7),
        (r"^\s*(?:public|private|protected)\s+(?:\w+\s+)+(\w+)\s*[<(]", 1, "function_added", "function_removed", 0.9, 0.9),
    ],
}
# Patterns for all languages, languages with the patterns of another, and changes that break callers.
GENERIC = [
    (r"(?i)(?:\.get|\.post|\.put|\.delete|\.patch)\s*[<(]\s*['\"](/[/\w{}\-]*)['\"]", 1, "http_route_added", "http_route_removed", 0.85, 0.85),
    (r"^[-+]\s*([A-Z_]+)\s*[=:]", 1, "constant_added", "constant_changed", 0.7, 0.7),
]
SAME_AS = {"javascript": "typescript"}
BREAKING = ("function_removed", "function_signature_changed", "struct_field_removed", "enum_variant_removed", "http_route_removed", "constant_removed")


def lines(diffs: DataFrame, numbered: bool = False) -> DataFrame:
    """diffs: diff_id, diff. One row per line of a hunk: file, change, language, hunk_idx, old_start, new_start, line_idx, line_kind, content;
    if numbered, line_no as `line_numbers` gives it. A diff falls apart into files, hunks and lines where it stands: no shuffle, no sort."""
    d = diffs.select("diff_id", F.split("diff", r"\r?\n(?=diff --git)").alias("_files"))
    # What stands before the first file has number 0.
    d = d.select("diff_id", F.get("_files", F.lit(0)).startswith("diff --git").cast("bigint").alias("_first"), F.posexplode("_files").alias("_at", "_file"))
    d = d.select("diff_id", (F.col("_first") + F.col("_at")).alias("file_no"), F.split("_file", r"\r?\n(?=@@)").alias("_hunks"))
    top = F.get("_hunks", F.lit(0))
    d = d.select("*", top.startswith("@@").cast("bigint").alias("_bare"), F.split(top, r"\r?\n").alias("_head"))
    first = lambda cond: F.when(F.col("_bare") == 0, F.get(F.filter("_head", cond), F.lit(0)))
    side = lambda mark: first(lambda x: x.startswith(f"{mark} ") & ~x.startswith(f"{mark} /dev/null"))
    new, old = F.regexp_replace(side("+++"), r"^\+\+\+ (b/)?", ""), F.regexp_replace(side("---"), r"^--- (a/)?", "")
    moved = F.regexp_replace(first(lambda x: x.startswith("rename to ")), "^rename to ", "")
    named = F.regexp_extract(first(lambda x: x.startswith("diff --git")), r"^diff --git a/.* b/(.*)$", 1)
    has = lambda mark: first(lambda x: x.startswith(mark)).isNotNull()
    change = X.case((has("new file"), "added"), (has("deleted file"), "deleted"), (moved.isNotNull(), "renamed"), otherwise="modified")
    d = d.select("diff_id", "file_no", F.coalesce(new, moved, old, named).alias("file"), change.alias("change"), "_bare", "_hunks")
    d = d.select("diff_id", "file_no", "file", "change", X.language(F.col("file")).alias("language"), "_bare", F.posexplode("_hunks").alias("_at", "_hunk"))
    span = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    start = lambda g: F.regexp_extract("_hunk", span, g).try_cast("int")
    kind = lambda x: X.case((x.startswith("+"), "add"), (x.startswith("-"), "del"), (x.startswith(" "), "ctx"), otherwise=F.lit(None).cast("string"))
    line = lambda x, i: F.struct((i - 1).alias("line_idx"), kind(x).alias("line_kind"), F.substring(x, 2, 2**31 - 1).alias("content"))
    rows = F.filter(F.transform(F.split("_hunk", r"\r?\n"), line), lambda x: x["line_kind"].isNotNull())
    hunk = ["diff_id", "file_no", "file", "change", "language", (F.col("_at") + F.col("_bare") - 1).alias("hunk_idx")]
    d = d.where("_at + _bare > 0").select(*hunk, start(1).alias("old_start"), start(2).alias("new_start"), rows.alias("_lines"))
    if numbered:
        # A line's place among those of its side is its number there.
        of = lambda side, begin: F.transform(F.filter("_lines", lambda x: x["line_kind"] != side), lambda x, i: F.struct(x["line_idx"], x["line_kind"], x["content"], (F.col(begin) + i.cast("bigint")).alias("line_no")))
        gone = F.filter(of("add", "old_start"), lambda x: x["line_kind"] == "del")
        d = d.withColumn("_lines", F.concat(of("del", "new_start"), gone))
    return d.select(*d.columns[:-1], F.inline("_lines"))


def line_numbers(diff_lines: DataFrame) -> DataFrame:
    """Line numbers on the side where a line lives: new for added and kept lines, old for removed ones."""
    w = Window.partitionBy("diff_id", "file_no", "hunk_idx").orderBy("line_idx")
    before = lambda kinds: F.sum(F.col("line_kind").isin(*kinds).cast("int")).over(w) - 1
    return diff_lines.withColumn("line_no", F.when(F.col("line_kind") == "del", F.col("old_start") + before(["del", "ctx"])).otherwise(F.col("new_start") + before(["add", "ctx"])))


def summary_by_language(diff_lines: DataFrame) -> DataFrame:
    n = lambda k: F.sum((F.col("line_kind") == k).cast("bigint"))
    return diff_lines.groupBy("diff_id", "language").agg(F.countDistinct("file_no").alias("n_files"), n("add").alias("additions"), n("del").alias("deletions"))


def _symbol(content: Column, added: Column, pattern: str, group: int, on: str, off: str, c_on: float, c_off: float, lang: str) -> Column:
    name = F.regexp_extract(content, "(?m)" + pattern, group)
    seen = content.rlike("(?m)" + pattern)
    if lang == "python" and on == "function_added":
        seen = seen & ~name.rlike("^_[^_]")
    if lang == "go" and on == "function_added":
        seen = seen & name.rlike("^[A-Z]")
    return F.when(seen, F.struct(F.when(added, on).otherwise(off).alias("change_type"), name.alias("symbol"), F.when(added, c_on).otherwise(c_off).alias("confidence")))


def raw_changes(diff_lines: DataFrame) -> DataFrame:
    """Symbols of added, then removed lines of each hunk, numbered in order within a diff; the first of its kind on (file, line, symbol, type) stays."""
    content, added, lang = F.col("content"), F.col("line_kind") == "add", F.col("language")
    generic = [_symbol(content, added, *p, "generic") for p in GENERIC]
    by_lang = {name: F.coalesce(*(_symbol(content, added, *p, name) for p in ps), *generic) for name, ps in SYMBOLS.items()}
    found = X.case(*((lang.isin(name, *(k for k, v in SAME_AS.items() if v == name)), c) for name, c in by_lang.items()), otherwise=F.coalesce(*generic))
    d = diff_lines.where("line_kind <> 'ctx'").where(~F.col("content").rlike(r"(?U)^\s*(//|#)"))
    # A generator finds a line's symbol once; a filter on it would run the patterns again.
    d = d.select("*", F.inline(F.array_compact(F.array(found))))
    d = d.withColumns({"line_start": F.when(added, F.col("new_start")).otherwise(F.col("old_start")), "removed": (~added).cast("int")})
    # Every hit takes a number; repeats go afterwards, and leave gaps.
    order = Window.partitionBy("diff_id").orderBy("file_no", "hunk_idx", "removed", "line_idx")
    once = F.row_number().over(Window.partitionBy("diff_id", "file", "line_start", "symbol", "change_type").orderBy("file_no", "hunk_idx", "removed", "line_idx"))
    d = d.withColumns({"change_id": F.format_string("rc_%05d", F.row_number().over(order)), "_once": once}).where("_once = 1")
    return d.select("diff_id", "change_id", "file", "language", "line_start", "change_type", "symbol", "confidence", "content")


def is_breaking(change_type: Column) -> Column:
    return change_type.isin(*BREAKING)


def file_tree(files: DataFrame) -> DataFrame:
    """path to nodes: node, parent ('' at the top), depth, is_file."""
    parts = F.split("path", "/")
    n = files.select("path", F.posexplode(parts).alias("depth", "name"), parts.alias("p"))
    node = lambda k: F.array_join(F.slice("p", 1, k), "/")
    return n.select(node(F.col("depth") + 1).alias("node"), F.when(F.col("depth") == 0, "").otherwise(node(F.greatest("depth", F.lit(1)))).alias("parent"), "depth", (F.size("p") == F.col("depth") + 1).alias("is_file")).groupBy("node", "parent", "depth").agg(F.max("is_file").alias("is_file"))


# Parts of names that are no behaviour, in order, and what they are for.
REASONS = (("log", "logging"), ("metric", "metrics"), ("trace", "tracing"), ("cache", "cache"), ("format", "formatting"), ("debug", "internal"))


def behaviour_boundaries(diffs: DataFrame) -> DataFrame:
    """Last token of each hunk header, its module (what stands before its first dot), and whether it is behaviour; if not, why."""
    h = diffs.select("diff_id", F.posexplode(F.split("diff", r"\r?\n")).alias("at", "line")).where(F.col("line").startswith("@@"))
    h = h.withColumn("name", F.element_at(F.split(X.stripped(F.col("line")), r"\s+"), -1))
    reason = X.case(*((F.col("name").contains(part), why) for part, why in REASONS), otherwise=F.lit(None).cast("string"))
    return h.select("diff_id", "at", "name", F.substring_index("name", ".", 1).alias("module"), reason.isNull().alias("behavioural"), reason.alias("reason"))
