"""Source files and symbols by module: imports, dependencies, clusters, history and discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import modules as M
from ..functions.exprs import ratio, stripped


def imported(line: Column) -> Column:
    """The path that a line of source imports, with slashes; null if it imports nothing."""
    c = stripped(line)
    parts = F.split(F.regexp_replace(F.substr(c, F.lit(5)), ";+$", ""), "::")
    first = F.element_at(parts, 1)
    local = first.isin("crate", "self", "super") & (F.size(parts) >= 2)
    used = F.when(local, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/")).when(~first.contains("{"), F.array_join(parts, "/"))
    named = F.replace(F.try_element_at(F.split(c, r"\s+"), F.lit(2)), F.lit("."), F.lit("/"))
    call = r"require\(([^)]*)\)"
    required = F.when(c.rlike(call), F.regexp_replace(stripped(F.regexp_extract(c, call, 1)), "^['\"`]+|['\"`]+$", ""))
    return F.when(c.startswith("use "), used).when(c.startswith("from ") | c.startswith("import "), named).when(c.contains("require("), required)


def imports(files: DataFrame) -> DataFrame:
    """files: project, file, content. (project, file, import) for each importing line."""
    at = files.select("project", "file", F.explode(F.split("content", r"\r?\n")).alias("line"))
    return at.select("project", "file", imported(F.col("line")).alias("import")).where("import is not null")


def dependencies(files: DataFrame, most: float = 10.0) -> DataFrame:
    """(project, a, b, weight): modules of a project's files, joined where a line imports what starts with the other's name or is part of
    it; by unordered pair, cut at `most`. Modules of one project meet its imports only."""
    here = M.module_short(F.col("file"))
    mods = files.select("project", here.alias("module")).distinct()
    imp = imports(files).groupBy("project", here.alias("src"), "import").agg(F.count("*").alias("n"))
    hit = F.col("import").startswith(F.col("module")) | F.col("module").contains(F.col("import"))
    j = imp.join(mods, "project").where(hit & (F.col("src") != F.col("module")))
    weight = F.least(F.sum("n").cast("double"), F.lit(most))
    return j.groupBy("project", F.least("src", "module").alias("a"), F.greatest("src", "module").alias("b")).agg(weight.alias("weight"))


def clusters(changed: DataFrame, symbols: DataFrame, tasks: DataFrame) -> DataFrame:
    """changed: project, file. symbols: project, symbol, file, added. tasks: project, module, n_tasks. A row per module: n_symbols,
    n_tasks and cluster_type, Changed if a file or an added symbol of it changed, else Active with tasks, else Cold."""
    module = M.cluster_module(F.col("file")).alias("module")
    zero, one = F.lit(0).alias("n"), F.lit(1).alias("n")
    seen = changed.select("project", module, zero, F.lit(True).alias("hot")).unionByName(symbols.select("project", module, one, F.col("added").alias("hot")))
    g = seen.groupBy("project", "module").agg(F.sum("n").alias("n_symbols"), F.bool_or("hot").alias("hot")).join(tasks, ["project", "module"], "left")
    n = F.coalesce("n_tasks", F.lit(0))
    kind = F.when(F.col("hot"), "Changed").when(n > 0, "Active").otherwise("Cold")
    return g.select("project", "module", "n_symbols", n.alias("n_tasks"), kind.alias("cluster_type"))


def cluster_links(symbols: DataFrame) -> DataFrame:
    """Pairs of modules that share the file of a symbol, with strength 0.5. symbols: project, module, file."""
    s = symbols.select("project", "module", "file").distinct()
    j = s.join(s.withColumnRenamed("module", "other"), ["project", "file"]).where("module < other")
    return j.select("project", "module", "other").distinct().withColumn("strength", F.lit(0.5))


def cluster_summary(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Counts of modules by kind, and the mean strength of links (0 without), by project."""
    n = lambda kind: F.count_if(F.col("cluster_type") == kind).alias(f"n_{kind.lower()}")
    s = links.groupBy("project").agg(F.avg("strength").alias("avg_coupling"))
    out = nodes.groupBy("project").agg(F.count("*").alias("n_modules"), n("Changed"), n("Active"), n("Cold"))
    return out.join(s, "project", "left").fillna(0.0, ["avg_coupling"])


def module_changes(log: DataFrame) -> DataFrame:
    """log: line, of a history with names only. Files by module; dates (from 20..) and empty lines don't count."""
    line = F.trim("line")
    return log.where((line != "") & ~line.startswith("20")).groupBy(M.module_short(line).alias("module")).agg(F.count("*").alias("n_changes"))


def discovered(files: DataFrame) -> DataFrame:
    """files: path. Top folders (root for files without one) with their category and number of files."""
    top = F.when(F.col("path").contains("/"), F.element_at(F.split("path", "/"), 1)).otherwise("root")
    return files.groupBy(top.alias("module")).agg(F.count("*").alias("n_files")).withColumn("category", M.directory_category(F.col("module")))


def flow_risks(flows: DataFrame) -> DataFrame:
    """flows: risk_level. How many are high, medium, or anything else (LOW); levels without flows have no row."""
    level = F.when(F.col("risk_level").isin("high", "medium"), F.upper("risk_level")).otherwise("LOW")
    return flows.groupBy(level.alias("risk")).agg(F.count("*").alias("n"))


def most_common(values: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The k most frequent values with counts; ties by value, nulls don't count."""
    return values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def review_stats(reviews: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v.lower())
    return reviews.groupBy("capability").agg(F.count("*").alias("total"), *map(n, ("Approved", "Rejected", "Corrected", "Flagged")))


def mapping_stats(mappings: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("test_status") == v).alias(v.lower())
    return mappings.agg(F.countDistinct("capability").alias("mapped"), *map(n, ("Passing", "Failing", "Missing")))


def degradation(runs: DataFrame) -> DataFrame:
    """runs: suite, status, detail. Counts by suite; runs out of time count as failed."""
    failed = F.col("status").isin("Failed", "TimedOut")
    n = lambda c, name: F.count_if(c).alias(name)
    return runs.groupBy("suite").agg(F.count("*").alias("total"), n(F.col("status") == "Ok", "n_ok"), n(F.col("status") == "Skipped", "n_skipped"), n(failed, "n_failed")).withColumn("ok_share", ratio(F.col("n_ok"), F.col("total")))


def degradation_reasons(runs: DataFrame) -> DataFrame:
    reason = F.when(F.col("status") == "Skipped", "Upstream dependency failed").otherwise(F.coalesce("detail", F.lit("Unknown error")))
    status = F.when(F.col("status") == "Skipped", "skipped").otherwise("failed")
    return runs.where("status <> 'Ok'").select("suite", "run", status.alias("status"), reason.alias("reason"))
