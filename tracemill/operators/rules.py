"""Rules with trigger trees over raw changes, and the capabilities that follow from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


@dataclass(frozen=True)
class Trigger:
    """kind: symbol, change, path, content (leaves with values, of which one must hold), all, any, not (over parts)."""

    kind: str
    values: tuple[str, ...] = ()
    parts: tuple[Trigger, ...] = ()

    def column(self) -> Column:
        any_of = lambda cs: reduce(lambda a, b: a | b, cs)
        symbol, content = F.lower(F.coalesce("symbol", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
        return {
            "symbol": lambda: any_of([X.glob_match(symbol, v) for v in self.values]),
            "change": lambda: F.col("change_type").isin(*self.values),
            "path": lambda: any_of([X.glob_match(F.col("file"), v) for v in self.values]),
            "content": lambda: any_of([content.contains(v) for v in self.values]),
            "any": lambda: any_of([p.column() for p in self.parts]),
            "all": lambda: reduce(lambda a, b: a & b, [p.column() for p in self.parts]),
            "not": lambda: ~self.parts[0].column(),
        }[self.kind]()


def _of(kind: str):
    return lambda *values: Trigger(kind, values)


symbol, change, path, content = map(_of, ("symbol", "change", "path", "content"))
# The built-in rules (id, category, severity, trigger).
RULES = (
    ("sec_auth_001", "security", "high", symbol("auth", "login")),
    ("sec_auth_002", "security", "high", symbol("guard", "permission")),
    ("sec_crypto_001", "security", "high", symbol("hash", "encrypt", "decrypt")),
    ("sec_sql_001", "security", "high", content("sql")),
    ("sec_token_001", "security", "high", symbol("token", "jwt", "session")),
    ("breaking_001", "breaking", "high", Trigger("all", parts=(change("function_removed", "http_route_removed"), Trigger("not", parts=(symbol("test"),))))),
    ("breaking_002", "breaking", "high", change("function_signature_changed")),
    ("breaking_003", "breaking", "medium", change("struct_field_removed")),
    ("breaking_004", "breaking", "high", change("enum_variant_removed")),
    ("breaking_005", "breaking", "medium", change("constant_removed")),
    ("perf_001", "performance", "medium", path("*.sql")),
    ("perf_002", "performance", "medium", path("*migration*", "*schema*")),
    ("deprec_001", "deprecation", "low", content("deprecat")),
    ("deprec_002", "deprecation", "low", content("todo", "fixme")),
    ("misc_test_001", "domain", "low", path("*test*", "*_test.*")),
)


def _found(rules) -> Column:
    """The rules that hold for a row. They are literals of the plan: no join."""
    return F.array_compact(F.array(*(F.when(t.column(), F.struct(F.lit(i).alias("rule_id"), F.lit(c).alias("category"), F.lit(s).alias("severity"))) for i, c, s, t in rules)))


def matches(changes: DataFrame, rules=RULES) -> DataFrame:
    """changes with rule_id, category and severity, a row per rule that holds."""
    return changes.withColumn("rule", F.explode(_found(rules))).select(*changes.columns, "rule.*")


def capabilities(changes: DataFrame, rules=RULES) -> DataFrame:
    """A capability per change: its status and the sorted categories of its rules, found where the change stands: no shuffle."""
    t = F.col("change_type")
    status = X.case((t.endswith("_added"), "added"), (t.endswith("_removed"), "removed"), otherwise="modified")
    categories = F.array_sort(F.array_distinct(F.transform(_found(rules), lambda x: x["category"])))
    return changes.select("diff_id", "change_id", F.col("symbol").alias("name"), status.alias("status"), categories.alias("categories"))
