"""Dependency graphs: layers, cycles, fan-in and fan-out, flows and failure propagation.

Layers, reachability and cycles grow by joins of a frontier with the edges. Layers and reachability end when a round adds
nothing, and write each round to the shared folder, so that a plan reads tables and repeats no round.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.scratch import stash


def missing_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (node, dep) whose dep is no node."""
    return edges.join(nodes.select(F.col("node").alias("dep")), "dep", "left_anti").select("node", "dep")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest dependency chain of each node (graph, node, layer); -1 for nodes on or behind a cycle or a missing node. A round for
    each layer, until one adds nothing; rounds carry counts of dependencies that are still open, and are written."""
    wants = edges.select("graph", "node", "dep").distinct()
    n = wants.groupBy("graph", "node").agg(F.count("*").alias("n"))
    rest = stash(nodes.select("graph", "node").distinct().join(n, ["graph", "node"], "left").fillna(0, ["n"]), "open")
    placed = []
    for k in count():
        ready = rest.where("n = 0").select("graph", "node")
        if ready.isEmpty():
            break
        placed.append(ready.withColumn("layer", F.lit(k)))
        met = wants.join(ready.withColumnRenamed("node", "dep"), ["graph", "dep"]).groupBy("graph", "node").agg(F.count("*").alias("met"))
        left = rest.where("n > 0").join(met, ["graph", "node"], "left").select("graph", "node", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n"))
        rest = stash(left, "open")
    stuck = rest.select("graph", "node", F.lit(-1).alias("layer"))
    return reduce(DataFrame.unionByName, placed, stuck)


def cycles(edges: DataFrame, most: int = 5) -> DataFrame:
    """Simple cycles of 2 to `most` edges (graph, path): each once, from its least node, joined by '>'."""
    e = edges.select("graph", F.col("node").alias("a"), F.col("dep").alias("b")).distinct()
    path = e.where("a < b").select("graph", F.array("a", "b").alias("p"), F.col("b").alias("at"))
    out = None
    for _ in range(2, most + 1):
        step = path.join(e.withColumnRenamed("a", "at"), ["graph", "at"])
        home = step.where(F.col("b") == F.element_at("p", 1)).select("graph", F.array_join("p", ">").alias("path"), F.size("p").alias("length"))
        out = home if out is None else out.unionByName(home)
        path = step.where((F.col("b") > F.element_at("p", 1)) & ~F.array_contains("p", F.col("b"))).select("graph", F.concat("p", F.array("b")).alias("p"), F.col("b").alias("at"))
    return out


def loop_ratio(trans: DataFrame, frm: str = "from_phase", to: str = "to_phase") -> DataFrame:
    """Repetitions of cycles (the least count along a cycle) over transitions, by trace; at most 1."""
    n = trans.groupBy(F.col("trace_id").alias("graph"), F.col(frm).alias("node"), F.col(to).alias("dep")).agg(F.count("*").alias("n"))
    c = cycles(n.where("node <> dep"))
    hops = c.select("graph", "path", F.split("path", ">").alias("p")).select("graph", "path", F.posexplode("p").alias("k", "node"), "p")
    hops = hops.select("graph", "path", "node", F.element_at("p", (F.col("k") + 1) % F.size("p") + 1).alias("dep"))
    least = hops.join(n, ["graph", "node", "dep"]).groupBy("graph", "path").agg(F.min("n").alias("times")).groupBy("graph").agg(F.sum("times").alias("loops"))
    total = trans.groupBy(F.col("trace_id").alias("graph")).agg(F.count("*").alias("n"))
    return total.join(least, "graph", "left").select(F.col("graph").alias("trace_id"), F.least(F.lit(1.0), X.ratio(F.coalesce("loops", F.lit(0)), F.col("n"))).alias("loop_ratio"))


def fan_in_out(edges: DataFrame) -> DataFrame:
    """Nodes with outgoing edges: fan_out, fan_in (every edge counts), high_coupling (over 10) and risk (over 20: high)."""
    out = edges.groupBy("graph", "node").agg(F.count("dep").alias("fan_out"))
    inn = edges.groupBy("graph", F.col("dep").alias("node")).agg(F.count("node").alias("fan_in"))
    j = out.join(inn, ["graph", "node"], "left").fillna(0, ["fan_in"])
    both = F.col("fan_in") + F.col("fan_out")
    return j.withColumns({"high_coupling": both > 10, "risk": X.case((both > 20, "high"), (both > 10, "medium"), otherwise="low")})


def flows(edges: DataFrame, entries: DataFrame, steps: int = 20) -> DataFrame:
    """From each entry, the first unvisited successor in the order of `seq`, up to `steps` nodes. A graph must fit a task."""

    def run(key: tuple, e: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values("seq")
        after = e.groupby("node", sort=False)["dep"].apply(list).to_dict()
        out = []
        for s in sorted(starts["entry"]):
            path = [s]
            while len(path) < steps:
                nxt = next((d for d in after.get(path[-1], ()) if d not in path), None)
                if nxt is None:
                    break
                path.append(nxt)
            out.append((key[0], s, ">".join(path), len(path)))
        return pd.DataFrame(out, columns=["graph", "entry", "path", "n_nodes"])

    kind = dict(edges.dtypes)["graph"]
    return edges.groupBy("graph").cogroup(entries.groupBy("graph")).applyInPandas(run, f"graph {kind}, entry string, path string, n_nodes int")


def blocked(edges: DataFrame, status: DataFrame) -> DataFrame:
    """Nodes that can't run: a dependency failed, is missing, or is itself blocked. status: graph, node, ok."""
    bad = edges.join(status.select("graph", F.col("node").alias("dep"), "ok"), ["graph", "dep"], "left").where(~F.coalesce("ok", F.lit(False))).select("graph", "node").distinct()
    bad = last = stash(bad, "blocked")
    while True:
        new = edges.join(last.select("graph", F.col("node").alias("dep")), ["graph", "dep"]).select("graph", "node").distinct().join(bad, ["graph", "node"], "left_anti")
        last = stash(new, "blocked")
        if last.isEmpty():
            break
        bad = bad.unionByName(last)
    return bad


def run_risk(failed, skipped):
    return X.case((failed > 0, "high"), (skipped > 0, "medium"), otherwise="low")


def node_phase(name):
    """By words in a node's name; the first phase with a word in it."""
    n = F.lower(name)
    # Words of phases, in order.
    words = {"input": "read|parse|input", "validation": "valid|check|verify", "persistence": "save|write|store|db", "output": "output|print|render|display"}
    return X.case(*((n.rlike(w), phase) for phase, w in words.items()), otherwise="business_logic")


def trigger(entry):
    """What starts a flow, by words in its entry's name, in this case."""
    # Words of triggers, in order.
    words = {"CLI": "main|cli", "HTTP": "handler|route|controller", "MQ": "consumer|worker"}
    return X.case(*((entry.rlike(w), kind) for kind, w in words.items()), otherwise="CLI")


def is_entry_point(path):
    # How the paths of entry points end.
    return path.rlike(r"(main\.rs|main\.go|main\.py|index\.ts|app\.ts)$") | (path == "src/bin")
