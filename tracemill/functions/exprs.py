"""Scalar building blocks as Columns; no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of tools by category, and the narrower sets for edits, reads and checks.
CATEGORY_TOOLS = {
    "locate": ("read", "grep", "glob", "search_codebase", "web_search", "web_fetch", "ls", "list"),
    "modify": ("write", "edit", "search_replace", "delete_file", "bash", "run_command"),
    "verify": ("test", "cargo", "check", "lint", "clippy", "build", "compile"),
    "commit": ("commit", "git", "push", "pull_request"),
}
CATEGORIES = ("locate", "modify", "verify", "commit", "other")
EDIT_TOOLS = ("write", "edit", "search_replace", "delete_file")
READ_TOOLS = ("read", "grep", "glob", "search_codebase", "ls", "list")
CHECK_TOOLS = ("test", "check", "lint", "clippy", "build")
# File clusters by extension.
CLUSTER_EXTENSIONS = {
    "rust": (".rs", ".toml", ".lock"),
    "ts_js": (".ts", ".tsx", ".js", ".jsx", ".json"),
    "python": (".py",),
    "go": (".go",),
    "doc": (".md", ".txt"),
}
CLUSTERS = ("rust", "ts_js", "python", "go", "doc", "src", "test", "other")


def case(*pairs: tuple[Column, object], otherwise: object = None) -> Column:
    """CASE WHEN over (condition, value) pairs."""
    (cond, value), *rest = pairs
    out = reduce(lambda acc, p: acc.when(*p), rest, F.when(cond, value))
    return out.otherwise(otherwise)


def tool_category(tool: Column) -> Column:
    return case(*((tool.isin(*names), cat) for cat, names in CATEGORY_TOOLS.items()), otherwise="other")


def is_edit(tool: Column) -> Column:
    return tool.isin(*EDIT_TOOLS)


def is_read(tool: Column) -> Column:
    return tool.isin(*READ_TOOLS)


def is_check(tool: Column) -> Column:
    return tool.isin(*CHECK_TOOLS)


def arg_path(args: Column) -> Column:
    """args.path, or args.file where there is no path; null unless it is a JSON string."""
    v = F.try_parse_json(args)
    path, file = (F.try_variant_get(v, f"$.{k}", "variant") for k in ("path", "file"))
    found = F.coalesce(path, file)
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def file_scope(path: Column) -> Column:
    """What precedes the last slash, or the last backslash where there is no slash; else ''."""
    slash = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    back = F.regexp_extract(path, r"(?s)^(.*)\\[^\\]*$", 1)
    return F.when(path.contains("/"), slash).otherwise(back)


def file_cluster(path: Column) -> Column:
    ext = F.regexp_extract(path, r"(?s)(\.[^.]*)$", 1)
    by_dir = case((path.contains("src/"), "src"), (path.contains("tests/"), "test"), otherwise="other")
    return F.when(ext == "", by_dir).otherwise(case(*((ext.isin(*exts), name) for name, exts in CLUSTER_EXTENSIONS.items()), otherwise="other"))


def language(path: Column) -> Column:
    """By the extension, whatever its case; a leading dot starts no extension."""
    # Languages by extension.
    names = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "go": "go", "java": "java"}
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)/*$", 1))
    return case(*((ext == e, name) for e, name in names.items()), otherwise="unknown")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def total(xs: list[Column]) -> Column:
    """Left-to-right sum: thresholds on sums of doubles depend on the order."""
    return reduce(lambda a, b: a + b, xs)


def fuzzy_jaccard(a: list[Column], b: list[Column]) -> Column:
    """Sum of minima over sum of maxima of dense histograms; 1 where both are empty."""
    low, high = total([F.least(x, y) for x, y in zip(a, b, strict=True)]), total([F.greatest(x, y) for x, y in zip(a, b, strict=True)])
    return F.when(high > 0, F.try_divide(low, high)).otherwise(1.0)


def histogram_cosine(a: list[Column], b: list[Column]) -> Column:
    """Cosine of dense histograms: 1 where both are empty, 0 where one is."""
    dot = total([x * y for x, y in zip(a, b, strict=True)])
    na, nb = (F.sqrt(total([x * x for x in v])) for v in (a, b))
    return case(((na == 0) & (nb == 0), 1.0), ((na == 0) | (nb == 0), 0.0), otherwise=F.try_divide(dot, na * nb))


def cosine(a: list[Column], b: list[Column]) -> Column:
    """Cosine of vectors; 0 where a norm is 0; within [-1, 1]."""
    dot = total([x * y for x, y in zip(a, b, strict=True)])
    norm = F.sqrt(total([x * x for x in a])) * F.sqrt(total([x * x for x in b]))
    return clamp(F.coalesce(F.try_divide(dot, norm), F.lit(0.0)), -1.0, 1.0)


def quick_round(c: Column, digits: int) -> Column:
    """F.round of a double, to the same last bit: by whole numbers, which is many times faster, but for large values and those within a
    millionth of a tie, where decimals decide."""
    up = c * F.lit(10.0**digits)
    whole = F.floor(up + 0.5)
    clear = (F.abs(up) < 1e9) & (F.abs(up + 0.5 - F.rint(up + 0.5)) > 1e-6)
    return F.when(clear, whole / F.lit(10.0**digits)).otherwise(F.round(c, digits))


def array_cosine(a: Column, b: Column) -> Column:
    """The same for arrays of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return clamp(F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)), -1.0, 1.0)


def euclidean(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(total([(x - y) * (x - y) for x, y in zip(a, b, strict=True)]))


def set_jaccard(a: Column, b: Column) -> Column:
    """0 where either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))))


def dense_jaccard(a: Column, b: Column) -> Column:
    """Arrays of doubles: 0 where lengths differ, 1 where both are empty."""
    fold = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, v: s + v)
    return case((F.size(a) != F.size(b), 0.0), (F.size(a) == 0, 1.0), otherwise=ratio(fold(lambda x, y: F.least(x, y)), fold(lambda x, y: F.greatest(x, y))))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation, 0 where a variance is below 1e-12."""
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
    return F.when((F.var_pop(x) > 1e-12) & (F.var_pop(y) > 1e-12), clamp(F.coalesce(r, F.lit(0.0)), -1.0, 1.0)).otherwise(0.0)


def entropy_of(p: Column) -> Column:
    """Aggregate: Shannon entropy in bits of the shares p."""
    return F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0)), F.lit(0.0))


def bounded_entropy(h: Column, most: Column) -> Column:
    top = F.log2(most.cast("double"))
    return F.when(top > 0, clamp(F.coalesce(F.try_divide(h, top), F.lit(0.0)), 0.0, 1.0)).otherwise(0.0)


def log_compress(x: Column) -> Column:
    return F.when(x > 0, clamp(F.log2(x + 1.0), 0.0, 1.0)).otherwise(0.0)


def robust_scale(xs: list[Column]) -> list[Column]:
    """(x - median) / interquartile range across the given columns of one row; unchanged where the range vanishes."""
    n, s = len(xs), F.array_sort(F.array(*xs))
    at = lambda k: F.element_at(s, k + 1)
    middle = at(n // 2) if n % 2 else (at(n // 2 - 1) + at(n // 2)) / 2.0
    spread = at(3 * n // 4) - at(n // 4)
    return [F.when(F.abs(spread) < 1e-8, x).otherwise(F.coalesce(F.try_divide(x - middle, spread), x)) for x in xs]


def canonical_call(tool: Column, args: Column) -> Column:
    """Equal for calls with equal tool and equal JSON arguments, whatever the order of keys."""
    return F.concat_ws("\x01", tool, F.coalesce(F.to_json(F.try_parse_json(args)), args, F.lit("")))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between timestamps; 0 where negative or unknown."""
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(F.timestamp_diff("MILLISECOND", start, end), F.lit(0).cast("bigint")))


def rfc3339(text: Column) -> Column:
    """Timestamp of an RFC 3339 string, null for anything else."""
    ok = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.when(ok, F.try_to_timestamp(text))


def name_tokens(text: Column) -> Column:
    """Sorted distinct lower-case parts of at least two bytes: cut at _, - and spaces, and before a capital after what is none."""
    cut = F.regexp_replace(text, r"(?<=\P{IsUppercase})(?=\p{IsUppercase})", "_")
    parts = F.filter(F.transform(F.split(cut, "[_\\- ]+"), F.lower), lambda x: F.octet_length(x) >= 2)
    return F.array_sort(F.array_distinct(parts))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def glob_match(text: Column, pattern: str) -> Column:
    """Case-blind: with * as a wildcard over the whole text, else as a part of it."""
    import re

    if "*" in pattern:
        return F.lower(text).rlike("(?s)^" + ".*".join(re.escape(p) for p in pattern.lower().split("*")) + "$")
    return F.lower(text).contains(pattern.lower())


def preview(text: Column, chars: int = 200) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def task_category(message: Column) -> Column:
    m = F.lower(message)
    has = lambda *words: reduce(lambda a, b: a | b, [m.contains(w) for w in words])
    return case((has("fix", "bug", "hotfix"), "bug_fix"), (has("refactor", "clean"), "refactor"), (has("test", "spec"), "test"), (has("doc", "readme"), "doc"), (has("feat", "add", "feature"), "feature"), otherwise="general")
