"""What follows from what: everything downstream of a capability, a capability's way through snapshot versions, and the run of a skill graph.

Downstream nodes grow round by round: each round joins what the last one found with the edges and drops what was found before, so
cycles end by themselves. Rounds are written to the shared folder in buckets, so that only what is new is shuffled. Ways through versions
are a recursive query, a row a step and start, which ends where a step was visited before. A run goes layer by layer and carries
values forward.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.scratch import deal, stash, unstash
from . import graph

MERGE = 8  # rounds are put together when so many tables are open
ROWS_A_TASK, SMALL_GRAPH = 100_000, 1000  # edges


def impact(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """edges: graph, source, target; starts: graph, node. (graph, start, node, hops): all nodes that are reached by outgoing edges, with the
    fewest edges to them; a start that lies on a cycle is not downstream of itself. Repeated edges and starts count once, null ends
    reach nothing. Where every graph is small, whole graphs are dealt to tasks and rounds shuffle nothing; else rows are dealt by node."""
    e = stash(edges.select("graph", "source", "target").where("source is not null and target is not null"), "edges")
    n, largest = e.groupBy("graph").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    parts = max(e.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK))
    by_source, by_node = (["graph"], ["graph"]) if largest <= SMALL_GRAPH else (["graph", "source"], ["graph", "start", "node"])
    with _some_keys_suffice(e.sparkSession):
        return _rounds(e, starts, parts, by_source, by_node)


@contextmanager
def _some_keys_suffice(spark):
    """Rows that were dealt by some of the keys of a join are not dealt again."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _rounds(edges: DataFrame, starts: DataFrame, parts: int, by_source: list[str], by_node: list[str]) -> DataFrame:
    key = ["graph", "start", "node"]
    e = deal(edges.repartition(parts, *by_source).distinct(), "edges", parts, *by_source)
    unstash(edges)
    begin = starts.select("graph", F.col("node").alias("start"), "node").repartition(parts, *by_node).distinct()
    last = deal(begin.withColumn("hops", F.lit(0)), "reach", parts, *by_node)
    found, hops = [last], 0
    while not last.isEmpty():
        hops += 1
        step = last.select("graph", "start", F.col("node").alias("source")).join(e, ["graph", "source"]).select("graph", "start", F.col("target").alias("node"))
        # What was found stands where the step is dealt to, and is met there.
        step = reduce(lambda s, f: s.join(f, key, "left_anti"), found, step.repartition(parts, *by_node).distinct())
        last = deal(step.withColumn("hops", F.lit(hops)), "reach", parts, *by_node)
        if len(found) == MERGE:
            merged = deal(reduce(DataFrame.unionByName, found), "reach", parts, *by_node)
            unstash(*found)
            found = [merged]
        found.append(last)
    return reduce(DataFrame.unionByName, found).where("hops > 0").select("graph", "start", "node", "hops")


def recursive(tables: dict[str, DataFrame], select: str, name: str) -> DataFrame:
    """The rows of a recursive SELECT over the tables, written down. The limit on rows of a recursion doesn't hold meanwhile: it is for
    queries that don't end, and those here do."""
    spark = next(iter(tables.values())).sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        return stash(spark.sql(select, **tables), name)
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def evolution(links: DataFrame, most_steps: int = 100) -> DataFrame:
    """links: id, version, from_id, from_version (null: it began there), a row for each capability and version. For each, (id, version, steps,
    path, ended): the way back, joined by '<' as id@version, and how it ended: at an origin, at one that is missing, or on a cycle, at the step
    before the repeat. A way of more than `most_steps` steps is an error, not a shorter way."""
    step = "struct({0} AS id, {1} AS version)"
    select = f"""WITH RECURSIVE walk(id, version, at, seen) MAX RECURSION LEVEL {most_steps + 1} AS (
        SELECT id, version, {step.format("id", "version")}, array({step.format("id", "version")}) FROM {{links}}
        UNION ALL
        SELECT w.id, w.version, {step.format("l.from_id", "l.from_version")}, array_append(w.seen, {step.format("l.from_id", "l.from_version")})
        FROM walk w JOIN {{links}} l ON l.id = w.at.id AND l.version = w.at.version
        WHERE l.from_id IS NOT NULL AND l.from_version IS NOT NULL AND NOT array_contains(w.seen, {step.format("l.from_id", "l.from_version")}))
      SELECT id, version, max_by(seen, size(seen)) AS seen FROM walk GROUP BY id, version"""
    ways = recursive({"links": links.select("id", "version", "from_id", "from_version")}, select, "evolution")
    ends = links.select(F.struct("id", "version").alias("_at"), F.lit(True).alias("_there"), (F.col("from_id").isNull() | F.col("from_version").isNull()).alias("_origin"))
    w = ways.withColumn("_at", F.element_at("seen", -1)).join(ends, "_at", "left")
    path = F.array_join(F.transform("seen", lambda s: F.concat_ws("@", s["id"].cast("string"), s["version"].cast("string"))), "<")
    ended = X.case((F.col("_there").isNull(), "missing"), (F.col("_origin"), "origin"), otherwise="cycle")
    return w.select("id", "version", (F.size("seen") - 1).alias("steps"), path.alias("path"), ended.alias("ended"))


def run(nodes: DataFrame, edges: DataFrame, needs: DataFrame, core: DataFrame, gather: dict[str, Column], make: dict[str, Column]) -> DataFrame:
    """The run of a skill graph, layer by layer.

    nodes: graph, node, outcome (ok, failed, timed_out: what the skill itself does) and whatever `make` reads; edges: graph, node, dep; needs: graph,
    node, input, version, the schema versions a skill asks for; core: input, version, those there are. A skill is skipped if one of its
    dependencies wasn't ok, missing ones included (reason upstream_skip), or else if it asks for a version that isn't there
    (no_compat_path); else it ends as its outcome says. gather: aggregates over the values that its dependencies made, named as they made
    them; make: values of a skill, of its own columns and what was gathered, null unless it is ok. Both are aggregates and Columns, so that a
    skill with very many dependencies needs no room for them. Skills on or behind a cycle or a missing one run in no layer (-1) and
    are skipped: the first of them have no dependency that was ok.

    Returns graph, node, layer, status, reason, n_inputs (dependencies with a value) and the columns of gather and make."""
    key = ["graph", "node"]
    kinds = {**_kinds(nodes, make, gather)}
    misfit = needs.join(core.select("input", "version", F.lit(True).alias("_fits")), ["input", "version"], "left").where("_fits is null").select(*key).distinct()
    todo = nodes.join(graph.layers(nodes, edges), key).join(misfit.withColumn("_misfit", F.lit(True)), key, "left")
    todo = stash(todo, "skills")
    wants = stash(edges.select(*key, "dep").distinct().join(todo.select(*key, "layer"), key), "wants")
    done: list[DataFrame] = []
    depth = todo.agg(F.max("layer")).first()[0]
    for k in range(0, (depth if depth is not None else -1) + 1):
        here = todo.where(F.col("layer") == k)
        if done:
            before = reduce(DataFrame.unionByName, done).select("graph", F.col("node").alias("dep"), F.col("status").alias("_status"), *make)
            met = wants.where(F.col("layer") == k).join(before, ["graph", "dep"], "left")
            some = F.coalesce(F.col("_status") == "ok", F.lit(False))
            first = next(iter(make))
            met = met.groupBy(*key).agg(F.count_if(~some).alias("_bad"), F.count_if(F.col(first).isNotNull()).alias("n_inputs"), *(c.alias(n) for n, c in gather.items()))
            here = here.join(met, key, "left")
        else:
            here = here.withColumns({"_bad": F.lit(0), "n_inputs": F.lit(0).cast("bigint")} | {n: F.lit(None).cast(kinds[n]) for n in gather})
        done.append(stash(_decided(here.fillna(0, ["_bad", "n_inputs"]), gather, make), "run"))
    out = todo.where("layer < 0").withColumns({"status": F.lit("skipped"), "reason": F.lit("upstream_skip"), "n_inputs": F.lit(0).cast("bigint")} | {n: F.lit(None).cast(kinds[n]) for n in (*gather, *make)})
    cols = [*key, "layer", "status", "reason", "n_inputs", *gather, *make]
    return reduce(DataFrame.unionByName, [d.select(*cols) for d in done], out.select(*cols))


def _decided(here: DataFrame, gather: dict[str, Column], make: dict[str, Column]) -> DataFrame:
    reason = X.case((F.col("_bad") > 0, "upstream_skip"), (F.col("_misfit").isNotNull(), "no_compat_path"), otherwise=F.lit(None).cast("string"))
    here = here.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNotNull(), "skipped").otherwise(F.col("outcome")))
    return here.select("graph", "node", "layer", "status", "reason", "n_inputs", *gather, *(F.when(F.col("status") == "ok", c).alias(n) for n, c in make.items()))


def _kinds(nodes: DataFrame, make: dict[str, Column], gather: dict[str, Column]) -> dict[str, str]:
    """Types of made and gathered values, as the first layer and the second would have them."""
    blank = nodes.limit(0).withColumns({n: F.lit(None).cast("double") for n in gather})
    made = blank.select(*(c.alias(n) for n, c in make.items()))
    gathered = made.agg(*(c.alias(n) for n, c in gather.items()))
    again = nodes.limit(0).withColumns({n: F.lit(None).cast(t) for n, t in gathered.dtypes}).select(*(c.alias(n) for n, c in make.items()))
    return dict(gathered.dtypes) | dict(again.dtypes)
