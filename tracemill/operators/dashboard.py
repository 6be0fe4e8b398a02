"""Nested views for a dashboard: tasks, trials with graders, tool pattern and code change, capability nodes and links.

A view is a row a task, whatever it holds; lists within it are cut to their first or last entries before they are gathered, so that
no row grows without bound, and say how many there were. Rank limits reach the partial side of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JSON = {"ignoreNullFields": "false"}


def gathered(rows: DataFrame, by: list[str], order: list[Column], entry: Column, name: str, most: int) -> DataFrame:
    """by, an array of the entries of the first `most` rows in order, and n_<name>, how many rows there were."""
    n = rows.groupBy(*by).agg(F.count("*").alias(f"n_{name}"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= most)
    lists = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_rank", entry.alias("e")))).alias("_l"))
    return n.join(lists.select(*by, F.transform("_l", lambda x: x["e"]).alias(name)), by)


def tasks_view(tasks: DataFrame) -> DataFrame:
    """tasks: id, description, category, modules, success_criteria (arrays). (id, json)."""
    return tasks.select("id", F.to_json(F.struct("id", "description", "category", "modules", "success_criteria"), JSON).alias("json"))


def trials_view(evals: DataFrame, graders: DataFrame, symbols: DataFrame, most_trials: int = 50, most_each: int = 20) -> DataFrame:
    """evals: task_id, description, eval_id, trial_index, outcome, created_at, tool_pattern (struct or null), files, additions, deletions, modules
    (array); graders: eval_id, name, passed; symbols: eval_id, action (added, removed), name, kind, file. (task_id, n_trials, json) with the last
    `most_trials` trials in order, and the first `most_each` graders and symbols of each by name."""
    recent = evals.withColumn("_r", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("trial_index"), F.desc("eval_id")))).where(F.col("_r") <= most_trials)
    g = gathered(graders, ["eval_id"], [F.col("name"), F.col("passed")], F.struct("name", "passed"), "graders", most_each)
    parts = {}
    for action in ("added", "removed"):
        one = symbols.where(F.col("action") == action)
        parts[action] = gathered(one, ["eval_id"], [F.col("name"), F.col("kind"), F.col("file")], F.struct("name", "kind", "file"), action, most_each)
    e = recent.join(g, "eval_id", "left").join(parts["added"], "eval_id", "left").join(parts["removed"], "eval_id", "left")
    listed = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    symbol = "struct<name:string,kind:string,file:string>"
    change = F.struct("files", "additions", "deletions", "modules", listed(F.col("added"), symbol).alias("symbols_added"), listed(F.col("removed"), symbol).alias("symbols_removed"))
    task = F.struct(F.col("task_id").alias("id"), "description")
    doc = F.struct("trial_index", "eval_id", "outcome", listed(F.col("graders"), "struct<name:string,passed:boolean>").alias("grader_results"), "tool_pattern", change.alias("code_change"), "created_at", task.alias("task"))
    lists = e.groupBy("task_id").agg(F.array_sort(F.collect_list(doc), lambda a, b: F.when(a["trial_index"] != b["trial_index"], F.signum(a["trial_index"] - b["trial_index"]).cast("int")).when(a["eval_id"] < b["eval_id"], -1).when(a["eval_id"] > b["eval_id"], 1).otherwise(0)).alias("trials"))
    n = evals.groupBy("task_id").agg(F.count("*").alias("n_trials"))
    return n.join(lists, "task_id").select("task_id", "n_trials", F.to_json(F.struct("task_id", "trials"), JSON).alias("json"))


def capability_nodes(symbols: DataFrame) -> DataFrame:
    """symbols: change, ordinal, name, kind, file, action. A node for each, added and removed alike."""
    return symbols.select("change", "ordinal", F.concat_ws("::", "file", "name").alias("id"), "name", "kind", "file", "action")


def capability_links(symbols: DataFrame) -> DataFrame:
    """Each two symbols of a change in one file, the earlier first: as many rows as there are such pairs, by definition."""
    s = symbols.select("change", "file", "ordinal", F.concat_ws("::", "file", "name").alias("id"))
    other = s.select("change", "file", F.col("ordinal").alias("_o"), F.col("id").alias("target"))
    return s.join(other, ["change", "file"]).where("ordinal < _o").select("change", F.col("id").alias("source"), "target", F.lit(1).alias("value"))


def linked_symbols(symbols: DataFrame) -> DataFrame:
    """symbols: file, symbol. (symbol, other, n_files): each two symbols that stand in a file together, and in how many. What travels is a row
    per symbol of a file with the later ones as an array; pairs are made where they are counted."""
    files = symbols.where("file is not null").groupBy("file").agg(F.array_sort(F.collect_set("symbol")).alias("_all"))
    rows = files.where(F.size("_all") > 1).select("_all", F.posexplode("_all").alias("_at", "symbol"))
    others = F.slice("_all", F.col("_at") + 2, F.size("_all")).alias("_others")
    rows = rows.where(F.col("_at") + 1 < F.size("_all")).select("symbol", others).repartition("symbol")
    return rows.select("symbol", F.explode("_others").alias("other")).groupBy("symbol", "other").agg(F.count("*").alias("n_files"))
