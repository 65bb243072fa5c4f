"""Graph operators on edge tables: ranking, traversal, components, levels, reachability.

Edges have columns src and dst (any type that orders).  Iterations are driver loops over DataFrame
steps; rows are cut to the shared folder every few rounds, and only counts reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking, smallgraph
from .state import cut, dealt

#: Up to so many edges a personalised PageRank runs as one numpy task (16 bytes an edge).
SMALL_EDGES = 2_000_000
#: Up to so many nodes reachability runs in one task as bit sets (n * n / 8 bytes: 50 MB).
SMALL_NODES = 20_000
#: Kinds and direction of the question presets.
PRESETS = {
    "callers": (("Calls",), "in"),
    "callees": (("Calls",), "out"),
    "subclasses": (("Extends",), "in"),
    "implementations": (("Implements",), "in"),
    "impact": (("Calls", "Imports", "Implements", "Extends"), "in"),
    "cross-file": (("Imports",), "out"),
}


def edges_of_kinds(edges: DataFrame, kinds: list[str] | tuple[str, ...], least: float = 0.0) -> DataFrame:
    """src, dst of the edges of these kinds with at least this confidence; no kinds, no edges."""
    return edges.where(F.col("kind").isin(list(kinds)) & (F.col("confidence") >= least)).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))


def preset(edges: DataFrame, name: str, least: float = 0.5) -> DataFrame:
    """src, dst in the direction of a preset question."""
    kinds, way = PRESETS[name]
    e = edges_of_kinds(edges, kinds, least)
    return e if way == "out" else reverse(e)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverses; repeated ones stay and count."""
    return edges.unionByName(reverse(edges))


def nodes_of(edges: DataFrame, *more: DataFrame) -> DataFrame:
    """node: every end of an edge, and the given ones."""
    out = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    for m in more:
        out = out.unionByName(m.select("node"))
    return out.distinct()


def _once(edges: DataFrame) -> DataFrame:
    """The edges, written unless they are a written frame already: they are counted before they are used."""
    written = edges._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRDD"
    return edges if written else cut(edges.select("src", "dst"))


def _is_small(edges: DataFrame, mode: str, most: int = SMALL_EDGES) -> bool:
    """Whether an operator runs in one task: as told, or by a count that stops at the bound."""
    if mode not in ("auto", "task", "joins"):
        raise ValueError(f"mode {mode!r} is none of auto, task, joins")
    return mode == "task" or mode == "auto" and edges.limit(most + 1).count() <= most


def _in_task(edges: DataFrame, nodes: DataFrame | None, f, shape: str) -> DataFrame:
    """f(names, src, dst) -> columns, over the whole of a small graph in one task."""
    kind = edges.schema["src"].dataType.simpleString()
    e = edges.select(F.lit(0).alias("one"), "src", "dst")
    n = (nodes if nodes is not None else edges.select(F.col("src").alias("node"))).select(F.lit(0).alias("one"), "node").distinct()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([left["src"].to_numpy(), left["dst"].to_numpy(), right["node"].to_numpy()]), return_inverse=True)
        return pd.DataFrame(f(names, at[: len(left)], at[len(left) : 2 * len(left)]))

    return e.groupBy("one").cogroup(n.groupBy("one")).applyInPandas(run, shape.format(kind))


def _ppr_numpy(edges: DataFrame, entries: DataFrame, damping: float, rounds: int) -> DataFrame:
    e = edges.select(F.lit(0).alias("one"), F.col("src").cast("long"), F.col("dst").cast("long"))
    s = entries.select(F.lit(0).alias("one"), F.col("node").cast("long"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        start = np.unique(right["node"].to_numpy()) if len(right) else np.zeros(0, np.int64)
        if not len(start):
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        src, dst = (left[c].to_numpy() for c in ("src", "dst")) if len(left) else (start[:0], start[:0])
        names, at = np.unique(np.concatenate([src, dst, start]), return_inverse=True)
        u, v, n = at[: len(src)], at[len(src) : 2 * len(src)], len(names)
        home = np.zeros(n)
        home[at[2 * len(src) :]] = 1 / len(start)
        degree = np.bincount(u, minlength=n)
        p = home.copy()
        for _ in range(rounds):
            flow = np.bincount(v, p[u] / degree[u], minlength=n) if len(u) else np.zeros(n)
            p = (1 - damping) * home + damping * (flow + p[degree == 0].sum() * home)
        return pd.DataFrame({"node": names, "score": p})

    return e.groupBy("one").cogroup(s.groupBy("one")).applyInPandas(run, "node long, score double")


def ppr(edges: DataFrame, entries: DataFrame, damping: float = 0.85, rounds: int = 30, mode: str = "auto", every: int = 1) -> DataFrame:
    """node, score: personalised PageRank over a fixed number of rounds.

    Starts at the entries (node) alike and returns there; nodes without out-edges return all they
    have.  Repeated edges count as often as they stand.  Entries without edges are nodes too, nodes
    never reached score 0, and without entries there is no result.  The edges are counted: `auto` and
    `task` run small graphs as one numpy task, others as joins, as no task holds a graph of any size;
    both give the same scores.
    """
    if mode not in ("auto", "task", "joins"):
        raise ValueError(f"mode {mode!r} is none of auto, task, joins")
    entries = cut(entries.select("node").distinct())
    edges = _once(edges)
    if mode != "joins" and edges.schema["src"].dataType.typeName() in ("long", "integer") and _is_small(edges, "auto"):
        return _ppr_numpy(edges, entries, damping, rounds)
    if not (n_entries := entries.count()):
        return entries.withColumn("score", F.lit(1.0))
    # nodes are joined by sorted runs: they may be few enough for a broadcast, but one in each round adds up on the driver
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    home = F.when(F.col("is_entry"), F.lit(1.0 / n_entries)).otherwise(0.0)
    nodes = nodes_of(edges, entries).join(entries.withColumn("is_entry", F.lit(True)).hint("merge"), "node", "left")
    nodes = nodes.join(degree.withColumnRenamed("src", "node").hint("merge"), "node", "left").select("node", home.alias("home"), F.col("degree").isNull().alias("ends"))
    p = cut(nodes.withColumn("score", F.col("home")))
    weighted = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")))
    weighted = dealt(weighted.groupBy("src").agg(F.sum("m").alias("degree"), F.collect_list(F.struct("dst", "m")).alias("out")))
    for i in range(1, rounds + 1):
        sent = weighted.join(p.select(F.col("node").alias("src"), "score").hint("merge"), "src").select((F.col("score") / F.col("degree")).alias("each"), F.inline("out"))
        flow = sent.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("m") * F.col("each")).alias("flow"))
        lost = p.agg(F.coalesce(F.sum(F.when(F.col("ends"), F.col("score"))), F.lit(0.0)).alias("lost"))
        score = (1 - damping) * F.col("home") + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("home"))
        p = p.join(flow.hint("merge"), "node", "left").crossJoin(F.broadcast(lost)).select("node", "home", "ends", score.alias("score"))
        if i % every == 0 and i < rounds:
            p = cut(p)
    return p.select("node", "score")


def bfs(edges: DataFrame, entries: DataFrame, depth: int = 10, branching: int | None = 4, order: list[str] | None = None, terminal: list[str] | None = None) -> DataFrame:
    """node, level: breadth-first from the entries.

    At each step a node follows its first `branching` out-edges per kind (edges: src, dst, kind; in
    `order`, by dst at last); nodes reached by a terminal kind are not followed further.
    """
    e = edges if "kind" in edges.columns else edges.withColumn("kind", F.lit(""))
    if branching is not None:
        e = ranking.top_k(e, ["src", "kind"], [*[F.col(c) for c in order or []], F.col("dst")], branching, "_branch").drop("_branch")
    e = cut(e.select("src", "dst", "kind"))
    seen = cut(entries.select("node").distinct().withColumn("level", F.lit(0)))
    front = seen.select("node")
    for level in range(1, depth + 1):
        step = e.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.col("kind").isin(terminal or []).alias("stop"))
        new = cut(step.groupBy("node").agg(F.min("stop").alias("stop")).join(seen, "node", "left_anti"))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new.select("node", F.lit(level).alias("level"))))
        front = new.where("NOT stop").select("node")
    return seen


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """node: everything the entries lead to, themselves included."""
    return bfs(edges.select("src", "dst").distinct(), entries, depth=1 << 30, branching=None).select("node")


def attack_surface(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """reachable, total: nodes that entry nodes of the graph lead to; nothing without edges or entries."""
    nodes = nodes_of(edges)
    inside = entries.select("node").join(nodes, "node", "left_semi")
    return nodes.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(reachable(edges, inside).agg(F.count(F.lit(1)).alias("reachable")))).select("reachable", "total")


def closure(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) with a path from src to dst, semi-naive: each round only extends what the last one found."""
    e = cut(edges.select("src", "dst").distinct())
    seen, new = e, e
    while True:
        step = new.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        new = cut(step.join(seen, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new))


def blast_radius(edges: DataFrame, nodes: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """node, blast: how many other nodes lead to it, directly or not; a row for every node."""
    edges = _once(edges)
    if mode == "task" or mode == "auto" and _is_small(edges, mode) and nodes_of(edges, *([nodes] if nodes is not None else [])).count() <= SMALL_NODES:
        return _in_task(edges, nodes, lambda names, s, d: {"node": names, "blast": smallgraph.dependents(s, d, smallgraph.components(s, d, len(names)))}, "node {}, blast long")
    every = nodes_of(edges, *([nodes] if nodes is not None else []))
    back = closure(edges).where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(back, "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("blast"))


def blast_radius_sampled(edges: DataFrame, most: int = 5000) -> DataFrame:
    """Like blast_radius, but in graphs of over `most` nodes only for an even sample of them and the node of highest in-degree; others get 0."""
    nodes = nodes_of(edges)
    n = nodes.count()
    if n <= most:
        return blast_radius(edges)
    top = edges.distinct().groupBy(F.col("dst").alias("node")).count().orderBy(F.desc("count"), "node").limit(1).select("node")
    picked = ranking.number_rows(nodes, ["node"]).where(F.pmod(F.col("id") - 1, F.lit(-(-n // most))) == 0).select("node").unionByName(top).distinct()
    pairs = cut(picked.select(F.col("node").alias("root"), "node"))
    back = cut(reverse(edges).distinct())
    seen = front = pairs
    while True:
        step = front.join(back.withColumnRenamed("src", "node"), "node").select("root", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    count = seen.where("root <> node").groupBy(F.col("root").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(count, "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("blast"))


def _scc_task(names, src, dst) -> dict:
    comp = smallgraph.components(src, dst, len(names))
    first = np.full(int(comp.max(initial=-1)) + 1, len(names))
    np.minimum.at(first, comp, np.arange(len(names)))
    return {"node": names, "scc": names[first[comp]]}


def _levels_task(names, src, dst) -> dict:
    comp = smallgraph.components(src, dst, len(names))
    return {"node": names, "level": smallgraph.levels(src, dst, comp)[comp].astype(np.int32)}


def scc(edges: DataFrame, nodes: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """node, scc: strongly connected components, named by their smallest node; a graph counted small runs in one task.

    Forward and backward colouring: every open node takes the smallest name that reaches it; within a
    colour, what reaches the node of that name is its component and leaves.  Nodes without open
    in- or out-edges are components of their own and leave first.
    """
    edges = _once(edges)
    if _is_small(edges, mode):
        return _in_task(edges, nodes, _scc_task, "node {0}, scc {0}")
    every = cut(nodes_of(edges, *([nodes] if nodes is not None else [])))
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    done = None
    open_ = every
    while True:
        # trim
        while True:
            live = e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node")))
            alone = cut(open_.join(live, "node", "left_anti"))
            if alone.isEmpty():
                break
            part = alone.select("node", F.col("node").alias("scc"))
            done = part if done is None else cut(done.unionByName(part))
            open_ = cut(open_.join(alone, "node", "left_anti"))
            e = cut(e.join(alone.withColumnRenamed("node", "src"), "src", "left_anti").join(alone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        if open_.isEmpty():
            return done if done is not None else every.select("node", F.col("node").alias("scc"))
        colour = cut(open_.select("node", F.col("node").alias("colour")))
        while True:
            low = e.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("low"))
            new = cut(colour.join(low, "node", "left").select("node", F.least("colour", F.coalesce("low", "colour")).alias("colour"), (F.coalesce("low", "colour") < F.col("colour")).alias("moved")))
            colour, moved = new.select("node", "colour"), new.where("moved")
            if moved.isEmpty():
                break
        inner = cut(e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c = c2").select("src", "dst"))
        found = cut(colour.where("node = colour").select("node", F.col("colour").alias("scc")))
        front = found
        while True:
            step = inner.join(front.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "scc").distinct()
            front = cut(step.join(found, "node", "left_anti"))
            if front.isEmpty():
                break
            found = cut(found.unionByName(front))
        done = found if done is None else cut(done.unionByName(found))
        open_ = cut(open_.join(found, "node", "left_anti"))
        gone = found.select("node")
        e = cut(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))


def levels(edges: DataFrame, components: DataFrame | None = None, mode: str = "auto") -> DataFrame:
    """node, level: longest path over components to one without outgoing edges; a component's nodes share it."""
    edges = _once(edges)
    if _is_small(edges, mode):
        return _in_task(edges, components.select("node") if components is not None else None, _levels_task, "node {}, level int")
    comp = cut(components if components is not None else scc(edges, mode=mode))
    name = lambda side: comp.select(F.col("node").alias(side), F.col("scc").alias(f"{side}_c"))
    dag = cut(edges.select("src", "dst").join(name("src"), "src").join(name("dst"), "dst").where("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct())
    level = cut(comp.select(F.col("scc").alias("node")).distinct().withColumn("level", F.lit(0)))
    front = level
    while True:
        up = dag.join(front.select(F.col("node").alias("dst"), "level"), "dst").groupBy(F.col("src").alias("node")).agg((F.max("level") + 1).alias("up"))
        new = cut(level.join(up, "node", "left").select("node", F.greatest("level", F.coalesce("up", "level")).alias("level"), (F.coalesce("up", "level") > F.col("level")).alias("moved")))
        level, front = new.select("node", "level"), new.where("moved").select("node", "level")
        if front.isEmpty():
            return comp.join(level.withColumnRenamed("node", "scc"), "scc").select("node", F.col("level").cast("int").alias("level"))


def upward_violations(edges: DataFrame, level: DataFrame, components: DataFrame) -> DataFrame:
    """Edges that lead up, or stay inside a component of several nodes: src, src_level, dst, dst_level, widest first."""
    size = components.groupBy("scc").agg(F.count(F.lit(1)).alias("size"))
    info = components.join(size, "scc").join(level, "node", "left")
    side = lambda s: info.select(F.col("node").alias(s), F.col("scc").alias(f"{s}_c"), F.col("size").alias(f"{s}_n"), F.coalesce("level", F.lit(0)).alias(f"{s}_level"))
    e = edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")
    bad = (F.col("src_level") < F.col("dst_level")) | ((F.col("src_c") == F.col("dst_c")) & (F.col("src_n") > 1) & (F.col("src") != F.col("dst")))
    return e.where(bad).select("src", "src_level", "dst", "dst_level").orderBy(F.desc(F.abs(F.col("src_level") - F.col("dst_level"))), "src", "dst")


def snapshot(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbol edges as distinct edges between files (src, dst), without those inside a file."""
    s = symbols.select("id", "path")
    e = edges.join(s.select(F.col("id").alias("from_id"), F.col("path").alias("src")), "from_id").join(s.select(F.col("id").alias("to_id"), F.col("path").alias("dst")), "to_id")
    return e.where("src <> dst").select("src", "dst").distinct()


def _present(scores: DataFrame, entries: DataFrame, symbols: DataFrame, top: int, extra: Column | None = None) -> DataFrame:
    rest = scores.join(entries.select("node").distinct(), "node", "left_anti")
    rows = rest.join(symbols.select(F.col("id").alias("node"), "path", "name", "kind"), "node")
    return ranking.dedupe_ranked(rows.select(F.col("node").alias("id"), "path", "name", "kind", "score"), [], [F.desc("score"), F.asc("id")], top)


def query_graph(symbols: DataFrame, edges: DataFrame, subject: str, kinds=("Calls", "Imports", "Implements", "Extends"), least: float = 0.5, damping: float = 0.85, rounds: int = 30, undirected: bool = True, top: int = 5, mode: str = "auto") -> DataFrame:
    """The symbols that a walk from all symbols of that name meets most: id, path, name, kind, score."""
    entries = symbols.where(F.col("name") == subject).select(F.col("id").alias("node"))
    e = edges_of_kinds(edges, kinds, least)
    return _present(ppr(both_ways(e) if undirected else e, entries, damping, rounds, mode), entries, symbols, top)


def list_callers(symbols: DataFrame, edges: DataFrame, name: str, top: int = 5, least: float = 0.5, damping: float = 0.85, rounds: int = 30, mode: str = "auto") -> DataFrame:
    """Who calls it, by a walk against the call edges; confidence is the best direct edge from the caller to the name, else 0."""
    entries = symbols.where(F.col("name") == name).select(F.col("id").alias("node"))
    calls = edges.where((F.col("kind") == "Calls") & (F.col("confidence") >= least))
    walk = reverse(calls.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")))
    found = _present(ppr(walk, entries, damping, rounds, mode), entries, symbols, top)
    direct = calls.join(entries.select(F.col("node").alias("to_id")), "to_id", "left_semi").groupBy(F.col("from_id").alias("id")).agg(F.max("confidence").alias("confidence"))
    return found.join(direct, "id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
