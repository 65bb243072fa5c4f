"""Architecture metrics over a file graph: modularity, inequality, culprits, quality score, structure matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import graph, ranking


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, out, in_: distinct neighbours either way, 0 where there are none."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_"))
    return nodes.select("node").distinct().join(out, "node", "left").join(into, "node", "left").select("node", F.coalesce("out", F.lit(0)).cast("long").alias("out"), F.coalesce("in_", F.lit(0)).cast("long").alias("in_"))


def gini(values: DataFrame, column: str) -> DataFrame:
    """gini: 2 * sum(i * v_i) / (n * sum(v)) - (n + 1) / n over ascending values; 0 for none or a zero sum.

    Equal values are counted together first, so the running rank is over distinct values only.
    """
    v = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranks = F.col("c") * F.col("below") + F.col("c") * (F.col("c") + 1) / 2
    s = ranking.running_total(v, ["v"], "c", "upto").withColumn("below", F.col("upto") - F.col("c")).agg(F.sum(F.col("v") * ranks).alias("iv"), F.sum(F.col("v") * F.col("c")).alias("sv"), F.sum("c").alias("n"))
    value = F.when((F.coalesce("n", F.lit(0)) == 0) | (F.col("sv") == 0), 0.0).otherwise(2 * F.col("iv") / (F.col("n") * F.col("sv")) - (F.col("n") + 1) / F.col("n"))
    return s.select(value.cast("double").alias("gini"))


def newman_q(edges: DataFrame, module: Column | None = None) -> DataFrame:
    """q: directed modularity of distinct edges under `module`, a function of the column `node`."""
    module = tx.module_of(F.col("node")) if module is None else module
    m = graph.nodes_of(edges).select("node", module.alias("module"))
    e = edges.select("src", "dst").distinct().join(m.select(F.col("node").alias("src"), F.col("module").alias("a")), "src").join(m.select(F.col("node").alias("dst"), F.col("module").alias("b")), "dst")
    sides = e.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.lit(1).alias("out"), F.lit(0).alias("in_"), (F.col("a") == F.col("b")).cast("int").alias("intra")), F.struct(F.col("b").alias("c"), F.lit(0).alias("out"), F.lit(1).alias("in_"), F.lit(0).alias("intra")))).alias("x")).select("x.*")
    per = sides.groupBy("c").agg(F.sum("out").alias("kout"), F.sum("in_").alias("kin"), F.sum("intra").alias("intra"))
    total = per.agg(F.sum("kout").alias("m"))
    q = F.sum(F.col("intra") / F.col("m") - F.col("kout") * F.col("kin") / (F.col("m") * F.col("m")))
    return per.crossJoin(F.broadcast(total)).agg(F.coalesce(q, F.lit(0.0)).alias("q"))


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """median: element n // 2 of the ascending values, 0 if there are none; by counts of distinct values."""
    v = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = v.agg(F.sum("c").alias("n"))
    got = ranking.running_total(v, ["v"], "c", "upto").crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("n") / 2)).agg(F.min("v").alias("m"))
    return got.select(F.coalesce("m", F.lit(0)).alias("median"))


def declares_module(src: Column, dst: Column) -> Column:
    """Whether an edge only declares a module; none does so far.  Such edges count for no metric."""
    return F.lit(False)


def file_metrics(edges: DataFrame, nodes: DataFrame, module: Column | None = None, components: DataFrame | None = None) -> DataFrame:
    """node, module, level, blast, out, in_, cross_out, upward: the table that all culprit lists are cut from."""
    module = tx.module_of(F.col("node")) if module is None else module
    e = graph.cut(edges.select("src", "dst").where((F.col("src") != F.col("dst")) & ~declares_module(F.col("src"), F.col("dst"))).distinct())
    comp = graph.scc(e, nodes) if components is None else components
    level = graph.levels(e, comp)
    info = nodes.select("node").distinct().withColumn("module", module).join(level, "node")
    side = lambda s: info.select(F.col("node").alias(s), F.col("module").alias(f"{s}_m"), F.col("level").alias(f"{s}_l"))
    ends = e.join(side("src"), "src").join(side("dst"), "dst")
    per = ends.groupBy(F.col("src").alias("node")).agg(F.count_if(F.col("src_m") != F.col("dst_m")).alias("cross_out"), F.count_if(F.col("dst_l") > F.col("src_l")).alias("upward"))
    out = info.join(graph.blast_radius(e, nodes), "node").join(degrees(e, nodes), "node").join(per, "node", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("cross_out", "upward")})


def is_barrel(path: Column) -> Column:
    return F.lower(F.regexp_extract(tx.norm_slashes(path), r"([^/]*)$", 1)).rlike(r"^(index|exports)\.")


def modularity_culprits(metrics: DataFrame, k: int = 10) -> DataFrame:
    score = F.col("cross_out") * F.sqrt("out")
    return metrics.select("node", F.round(score, 3).alias("score"), "cross_out", "out", "module").orderBy(F.desc(score), "node").limit(k)


def depth_culprits(metrics: DataFrame, k: int = 10) -> DataFrame:
    return metrics.select("node", "level", "blast", "out").orderBy(F.desc("level"), F.desc("blast"), "node").limit(k)


def blast_culprits(metrics: DataFrame, k: int = 10) -> DataFrame:
    return metrics.where(~is_barrel(F.col("node"))).select("node", "blast", "in_", "out").orderBy(F.desc("blast"), "node").limit(k)


def equality_culprits(metrics: DataFrame, k: int = 10) -> DataFrame:
    m = metrics.crossJoin(F.broadcast(upper_median(metrics, "out"))).withColumn("deviation", F.abs(F.col("out") - F.col("median")))
    return m.select("node", "out", "deviation").orderBy(F.desc("deviation"), "node").limit(k)


def matrix_culprits(levels: DataFrame, edges: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """Three lists from a structure matrix (node, level) and its edges: cross-module share, depth, upward edges."""
    two = lambda c: tx.module_of_two(F.col(c))
    per = edges.groupBy("src").agg(F.count(F.lit(1)).alias("total"), F.count_if(two("src") != two("dst")).alias("cross"))
    share = per.select(F.col("src").alias("node"), (F.col("cross") / F.col("total") * F.sqrt("total")).alias("score"), "cross", "total", F.round(F.col("cross") / F.col("total"), 3).alias("ratio"))
    top = levels.agg(F.max("level").alias("top"))
    deep = levels.crossJoin(F.broadcast(top)).where("level >= top - 1")
    side = lambda s: levels.select(F.col("node").alias(s), F.col("level").alias(f"{s}_l"))
    up = edges.join(side("src"), "src").join(side("dst"), "dst").where("dst_l > src_l")
    touch = up.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("upward_touches"))
    return {
        "modularity": share.orderBy(F.desc("score"), "node").limit(k),
        "depth": deep.select("node", "level", F.col("top").alias("max_level")).orderBy(F.desc("level"), "node").limit(k),
        "acyclicity": touch.orderBy(F.desc("upward_touches"), "node").limit(k),
    }


def structure(components: DataFrame, level: DataFrame) -> DataFrame:
    """cycles, scc_count, max_level, max_depth, longest_chain_edges of a graph's components and levels."""
    size = components.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("cycles"), F.count(F.lit(1)).alias("scc_count"))
    top = level.agg(F.coalesce(F.max("level"), F.lit(0)).cast("long").alias("max_level"))
    return size.crossJoin(F.broadcast(top)).select("cycles", "scc_count", "max_level", F.greatest(F.lit(0), F.col("max_level") - 1).cast("long").alias("max_depth"), F.col("max_level").alias("longest_chain_edges"))


def quality_score(q: Column, cycles: Column, depth: Column, gini_cc: Column, waste: Column, total: Column) -> Column:
    """Five dimensions in [0, 1] and 10000 times their geometric mean."""
    dims = {"modularity": (q + 0.5) / 1.5, "acyclicity": 1 / (1 + cycles), "depth": 1 / (1 + depth / 8), "equality": 1 - gini_cc, "redundancy": 1 - waste / total}
    product = None
    for d in dims.values():
        product = d if product is None else product * d
    return F.struct(*[d.alias(n) for n, d in dims.items()], (F.pow(product, F.lit(0.2)) * 10000).alias("signal"))


def structure_matrix(edges: DataFrame, level: DataFrame) -> DataFrame:
    """size, above, below, same_level, density, propagation_cost (reachable pairs over all pairs)."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    side = lambda s: level.select(F.col("node").alias(s), F.col("level").alias(f"{s}_l"))
    counts = e.join(side("src"), "src").join(side("dst"), "dst").agg(F.count_if(F.col("src_l") < F.col("dst_l")).alias("above"), F.count_if(F.col("src_l") > F.col("dst_l")).alias("below"), F.count_if(F.col("src_l") == F.col("dst_l")).alias("same_level"), F.count(F.lit(1)).alias("m"))
    n = level.agg(F.count(F.lit(1)).alias("size"))
    pairs = graph.closure(e).where("src <> dst").agg(F.count(F.lit(1)).alias("pairs"))
    both = counts.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(pairs))
    return both.select("size", "above", "below", "same_level", (F.col("m") / F.greatest(F.col("size") * (F.col("size") - 1), F.lit(1))).alias("density"), (F.col("pairs") / F.greatest(F.col("size") * F.col("size"), F.lit(1))).alias("propagation_cost"))


def diagnostics(edges: DataFrame, nodes: DataFrame, project: str, module: Column | None = None) -> DataFrame:
    """One row: project, counts, aggregates struct, and the four culprit lists as arrays of structs."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    comp = graph.cut(graph.scc(e, nodes))
    m = graph.cut(file_metrics(e, nodes, module, comp))
    s = structure(comp, m.select("node", "level"))
    agg = s.crossJoin(F.broadcast(newman_q(e, module))).crossJoin(F.broadcast(gini(m, "out"))).crossJoin(F.broadcast(upper_median(m, "out"))).crossJoin(F.broadcast(m.agg(F.count_distinct("module").alias("module_count"), F.count(F.lit(1)).alias("file_count"), F.sum("out").alias("edge_count"))))
    listed = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))  # noqa: E731  at most ten rows
    out = agg.select(F.lit(project).alias("project"), F.current_timestamp().alias("timestamp"), "file_count", "edge_count", F.struct("cycles", "max_depth", F.col("max_level").alias("max_level_raw"), "longest_chain_edges", F.round("q", 4).alias("modularity_q"), F.round("gini", 4).alias("gini_out_degree"), F.round(1 - F.col("gini"), 4).alias("equality_proxy"), "scc_count", F.col("median").alias("median_out"), "module_count").alias("aggregates"))
    for df, name in ((modularity_culprits(m), "modularity_culprits"), (depth_culprits(m), "depth_culprits"), (blast_culprits(m), "blast_culprits"), (equality_culprits(m), "equality_culprits")):
        out = out.crossJoin(F.broadcast(listed(df, name)))
    return out
