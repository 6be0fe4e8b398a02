"""Readers of agent logs: completion lines, run logs and session logs become canonical traces.

A parser takes a DataFrame of texts (`source`, `raw`) and returns canonical rows; bad input gives rows in `rejected`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prefix

CALL = "struct<index:int,message:struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>,finish_reason:string>"
COMPLETION = f"struct<id:string,object:string,model:string,created:bigint,choices:array<{CALL}>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>"
RUN_LOG = f"struct<run_id:string,turns:array<struct<index:int,prompt:string,response:{COMPLETION},timestamp:string>>>"
BLOCK = "struct<type:string,text:string,id:string,name:string,input:string>"
SESSION = f"struct<messages:array<struct<type:string,text:string,content:array<{BLOCK}>,tool_use_id:string>>>"
SESSION_LINE = f"struct<id:string,type:string,content:array<{BLOCK}>,usage:struct<input_tokens:bigint,output_tokens:bigint>,model:string>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: source, raw."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("raw"))


def detect(raw: Column) -> Column:
    """Name of the format, from the first 4096 characters; the most specific first."""
    head = F.substring(raw, 1, 4096)
    has = lambda *keys: [head.contains(f'"{k}"') for k in keys]
    run, turns, choices, ident, messages, kind, obj = has("run_id", "turns", "choices", "id", "messages", "type", "object")
    openai = choices & obj & head.contains("chat.completion")
    return F.when(run & turns, "run_log").when(openai, "openai").when(choices & ident, "deepseek").when(messages & kind, "session").when(kind & head.contains("assistant"), "session_lines").otherwise(F.lit(None).cast("string"))


def lines(texts: DataFrame) -> DataFrame:
    out = texts.select("source", F.posexplode(F.split("raw", r"\r?\n")).alias("line_no", "line"))
    return out.where(F.trim("line") != "")


def args_json(text: Column) -> Column:
    """Canonical JSON, or a JSON string of what can't be parsed."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def _split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.col("j").isNotNull() & F.col("key").isNotNull()
    return parsed.where(good), parsed.where(~good).select("source", "line_no", "line")


def completions(texts: DataFrame, agent: str = "deepseek") -> tuple[DataFrame, DataFrame]:
    """One completion a line. (traces, rejected): good lines are kept whatever the bad ones."""
    j = lines(texts).withColumn("j", F.from_json("line", COMPLETION)).withColumn("key", F.col("j.id"))
    good, bad = _split(j)
    return _of_completions(good.select("source", F.col("key").alias("session_id"), F.col("j").alias("c"), F.lit("").alias("prompt"), F.lit(None).cast("string").alias("at")), agent), bad


def run_logs(texts: DataFrame, agent: str = "deepseek") -> tuple[DataFrame, DataFrame]:
    """One object per text with run_id and turns."""
    j = texts.select("source", F.lit(0).alias("line_no"), F.col("raw").alias("line"), F.from_json("raw", RUN_LOG).alias("j")).withColumn("key", F.col("j.run_id"))
    good, bad = _split(j)
    turns = good.select("source", F.col("key").alias("session_id"), F.explode("j.turns").alias("t"))
    return _of_completions(turns.select("source", "session_id", F.col("t.response").alias("c"), F.col("t.prompt").alias("prompt"), F.col("t.timestamp").alias("at")), agent), bad


def _of_completions(rows: DataFrame, agent: str) -> DataFrame:
    at = F.coalesce("at", F.date_format(F.timestamp_seconds("c.created"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    flat = F.flatten(F.transform("c.choices", lambda x: F.coalesce(x["message"]["tool_calls"], F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"))))
    calls = F.transform(flat, lambda x, k: F.struct(F.format_string(f"call_{agent}_%s_%03d", F.col("session_id"), k + 1).alias("id"), x["function"]["name"].alias("tool_name"), args_json(x["function"]["arguments"]).alias("args"), at.alias("timestamp"), F.lit(0).cast("bigint").alias("duration_ms")))
    text = F.array_join(F.filter(F.transform("c.choices", lambda x: x["message"]["content"]), lambda x: x.isNotNull()), "\n")
    tokens = F.struct(F.coalesce("c.usage.prompt_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("c.usage.completion_tokens", F.lit(0)).alias("output_tokens"))
    return rows.select("source", "session_id", "prompt", calls.alias("tool_calls"), text.alias("final_output"), tokens.alias("token_usage"), at.alias("started_at"), F.lit(agent).alias("adapter"))


def sessions(texts: DataFrame, agent: str = "claude") -> tuple[DataFrame, DataFrame]:
    """One object per text with typed messages; the first user text is the prompt."""
    j = texts.select("source", F.lit(0).alias("line_no"), F.col("raw").alias("line"), F.from_json("raw", SESSION).alias("j")).withColumn("key", F.col("j.messages").cast("string"))
    good, bad = _split(j)
    m = F.col("j.messages")
    said = lambda kind: F.flatten(F.transform(F.filter(m, lambda x: x["type"] == kind), lambda x: F.coalesce(F.when(x["text"].isNotNull(), F.array(x["text"])), F.transform(F.filter(x["content"], lambda b: b["type"] == "text"), lambda b: b["text"]), F.array().cast("array<string>"))))
    return good.select("source", F.col("source").alias("session_id"), F.coalesce(F.get(said("user"), F.lit(0)), F.lit("")).alias("prompt"), _blocks(F.flatten(F.transform(F.filter(m, lambda x: x["type"] == "assistant"), lambda x: F.coalesce(x["content"], F.array().cast(f"array<{BLOCK}>")))), agent).alias("tool_calls"), F.array_join(said("assistant"), "\n").alias("final_output"), F.lit(agent).alias("adapter")), bad


def session_lines(texts: DataFrame, agent: str = "claude") -> tuple[DataFrame, DataFrame]:
    """One message a line; assistant lines count, bad lines are passed over and listed."""
    j = lines(texts).withColumn("j", F.from_json("line", SESSION_LINE)).withColumn("key", F.col("j.type"))
    good, bad = _split(j)
    a = good.where("key = 'assistant'")
    text = F.array_join(F.transform(F.filter("j.content", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    rows = a.select("source", F.coalesce("j.id", "source").alias("session_id"), F.lit("").alias("prompt"), _blocks(F.coalesce("j.content", F.array().cast(f"array<{BLOCK}>")), agent).alias("tool_calls"), text.alias("final_output"), F.struct(F.coalesce("j.usage.input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("j.usage.output_tokens", F.lit(0)).alias("output_tokens")).alias("token_usage"), F.lit(agent).alias("adapter"))
    return rows, bad


def _blocks(blocks: Column, agent: str) -> Column:
    return F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b, k: F.struct(F.coalesce(b["id"], F.format_string(f"call_{agent}_%03d", k + 1)).alias("id"), b["name"].alias("tool_name"), args_json(F.coalesce(b["input"], F.lit("{}"))).alias("args")))


PARSERS: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {
    "deepseek": completions,
    "run_log": run_logs,
    "session": sessions,
    "session_lines": session_lines,
    "openai": lambda t: completions(t, "openai"),
}


def parse(texts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """By format name, whatever its case."""
    return PARSERS[name.lower()](texts)


def import_stats(good: DataFrame, bad: DataFrame) -> DataFrame:
    return good.agg(F.count("*").alias("imported")).join(F.broadcast(bad.agg(F.count("*").alias("skipped"))))


def calls_of(traces: DataFrame) -> DataFrame:
    """The long table of calls: trace_id, idx and the call's fields."""
    return traces.select("trace_id", F.posexplode("tool_calls").alias("idx", "c")).select("trace_id", "idx", "c.*")


def golden_cases(spark: SparkSession, folder: str) -> DataFrame:
    """YAML cases below a local folder, sorted by id: few and small."""
    from pathlib import Path

    import yaml

    found = [yaml.safe_load(p.read_text()) for p in sorted(Path(folder).rglob("*.yaml"))]
    rows = [(c["id"], c.get("name"), c.get("category"), x.get("name"), x.get("status"), sorted(x.get("categories") or [])) for c in sorted(found, key=lambda c: c["id"]) for x in (c.get("expected") or {}).get("capabilities") or [{}]]
    return spark.createDataFrame(rows, "case_id string, title string, category string, name string, status string, categories array<string>")


# Extensions of source files, and folders without any.
SOURCE_EXTENSIONS = ("rs", "toml", "md", "json", "yaml", "yml", "html", "css", "js", "ts", "py", "go", "java", "c", "cpp", "h", "hpp")
SKIPPED_FOLDERS = ("target", ".git", "node_modules", "__pycache__")


def source_tree(files: DataFrame, by: list[str] = (), order: list[str] = ("path",), extensions: tuple[str, ...] = SOURCE_EXTENSIONS, skipped: tuple[str, ...] = SKIPPED_FOLDERS, budget: int = 131_072) -> DataFrame:
    """files: path, length. Those of known extensions outside the skipped folders, in path order, while their running size (running_bytes) fits
    the budget; `by`: a budget for each."""
    ok = F.regexp_extract("path", r"\.([^./]*)$", 1).isin(*extensions) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skipped)))
    return prefix.within_budget(files.where(ok), list(order), F.col("length"), budget, by)
