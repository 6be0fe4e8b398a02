"""Redaction of secrets by ordered patterns, then literal replacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and replacements in order, by switch.
PATTERNS = {
    "api_keys": (
        (r"(?i)(api_?key|apikey)[=:]\s*[^\s,;]+", "api_key=***REDACTED***"),
        (r"(?i)(token|secret|password)[=:]\s*[^\s,;]+", "$1=***REDACTED***"),
    ),
    "auth_header": (
        (r"(?i)(authorization|auth)[=:]\s*[^\s,;]+", "$1=***REDACTED***"),
        (r"(?i)bearer\s+[^\s,;]+", "Bearer ***REDACTED***"),
    ),
    "env_values": ((r"(?i)(SECRET|PASSWORD|TOKEN|KEY)_?[=:]?\s*[^\s,;]+", "$1=***REDACTED***"),),
}


def redact(text: Column, switches: tuple[str, ...] = ("api_keys", "auth_header"), literal: tuple[tuple[str, str], ...] = ()) -> Column:
    out = reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), (p for s in switches for p in PATTERNS[s]), text)
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), literal, out)


def redact_args(args: Column, **options) -> Column:
    """Only arguments that are a JSON string are touched."""
    v = F.try_parse_json(args)
    is_text = F.coalesce(F.schema_of_variant(v) == "STRING", v.isNull())
    plain = F.coalesce(F.try_variant_get(v, "$", "string"), args)
    clean = redact(plain, **options)
    return F.when(is_text, F.when(v.isNull(), clean).otherwise(F.to_json(F.to_variant_object(F.array(clean))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(clean)))) - 2))).otherwise(args)
