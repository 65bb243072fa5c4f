"""Graph ranking, traversal, components, levels and architecture metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archmetrics as am
from ..operators import graph
from . import views
from .registry import query

S, E, FE = views.SYMBOLS, views.EDGES, views.FILE_EDGES
REACH, SCC, LEVELS, METRICS = views.REACH, views.SCC, views.LEVELS, views.METRICS


def ppr_sql(edges: str, entries: str, rounds: int) -> str:
    """CTEs that end in p<rounds>(node, score); `edges` selects src, dst and `entries` node."""
    ctes = [
        f"ge AS ({edges})", f"en AS (SELECT DISTINCT node FROM ({entries}))",
        "nd AS (SELECT src AS node FROM ge UNION SELECT dst FROM ge UNION SELECT node FROM en)",
        "dg AS (SELECT src AS node, count(*) AS d FROM ge GROUP BY src)",
        "hm AS (SELECT nd.node, CASE WHEN en.node IS NULL THEN 0.0 ELSE 1.0 / (SELECT count(*) FROM en) END::DOUBLE AS home, dg.d FROM nd LEFT JOIN en USING (node) LEFT JOIN dg USING (node))",
        "p0 AS (SELECT node, home AS score FROM hm)",
    ]
    for i in range(1, rounds + 1):
        ctes.append(f"p{i} AS MATERIALIZED (SELECT hm.node, 0.15 * hm.home + 0.85 * (coalesce(f.flow, 0) + (SELECT coalesce(sum(score), 0) FROM p{i - 1} JOIN hm h USING (node) WHERE h.d IS NULL) * hm.home) AS score FROM hm LEFT JOIN (SELECT ge.dst AS node, sum(q.score / dg.d) AS flow FROM ge JOIN p{i - 1} q ON q.node = ge.src JOIN dg ON dg.node = ge.src GROUP BY ge.dst) f ON f.node = hm.node)")
    return ", ".join(ctes)


_NAMED = "SELECT id AS node FROM symbols WHERE name = 'red widget'"


@query(f"WITH {E}, {S}, {ppr_sql('SELECT from_id AS src, to_id AS dst FROM edges', _NAMED, 5)} SELECT node, round(score, 9) AS score FROM p5")
def ppr_5iter(spark, d):
    """Five rounds of personalised PageRank from all symbols of one name, as joins."""
    e = views.edges(spark, d).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    entries = views.symbols(spark, d).where("name = 'red widget'").select(F.col("id").alias("node"))
    return graph.ppr(e, entries, rounds=5, mode="joins").select("node", F.round("score", 9).alias("score"))


_BOTH = "SELECT from_id AS src, to_id AS dst FROM edges WHERE confidence >= 0.5 UNION ALL SELECT to_id, from_id FROM edges WHERE confidence >= 0.5"
_TOP = "r AS (SELECT p.node AS id, s.path, s.name, s.kind, p.score, row_number() OVER (PARTITION BY s.path, s.name ORDER BY p.score DESC, p.node) AS rn FROM p30 p JOIN symbols s ON s.id = p.node WHERE p.node NOT IN (SELECT node FROM en))"


@query(f"WITH {E}, {S}, {ppr_sql(_BOTH, _NAMED, 30)}, {_TOP} SELECT id, path, name, kind, round(score, 9) AS score FROM r WHERE rn = 1 ORDER BY r.score DESC, id LIMIT 5")
def query_graph(spark, d):
    """The five symbols that a walk from one name meets most, edges taken both ways."""
    got = graph.query_graph(views.symbols(spark, d), views.edges(spark, d), "red widget")
    return got.withColumn("score", F.round("score", 9))


@query(f"""WITH {E}, {S}, {ppr_sql("SELECT to_id AS src, from_id AS dst FROM edges WHERE kind = 'Calls' AND confidence >= 0.5", _NAMED, 30)}, {_TOP},
t AS (SELECT * FROM r WHERE rn = 1 ORDER BY score DESC, id LIMIT 5), c AS (SELECT from_id AS id, max(confidence) AS confidence FROM edges WHERE kind = 'Calls' AND confidence >= 0.5 AND to_id IN (SELECT node FROM en) GROUP BY from_id)
SELECT t.id, t.path, t.name, t.kind, round(t.score, 9) AS score, coalesce(c.confidence, 0.0)::DOUBLE AS confidence FROM t LEFT JOIN c USING (id)""")
def list_callers(spark, d):
    """Who calls one name, with the best direct confidence."""
    got = graph.list_callers(views.symbols(spark, d), views.edges(spark, d), "red widget")
    return got.select("id", "path", "name", "kind", F.round("score", 9).alias("score"), "confidence")


@query(f"""WITH RECURSIVE {E}, {S}, br AS (SELECT src, dst FROM (SELECT from_id AS src, to_id AS dst, row_number() OVER (PARTITION BY from_id, kind ORDER BY to_id) AS rn FROM edges WHERE confidence >= 0.5) WHERE rn <= 4),
l1 AS (SELECT DISTINCT dst AS node FROM br WHERE src IN ({_NAMED}) AND dst NOT IN ({_NAMED})),
l2 AS (SELECT DISTINCT dst AS node FROM br WHERE src IN (SELECT node FROM l1) AND dst NOT IN ({_NAMED}) AND dst NOT IN (SELECT node FROM l1))
SELECT node, 0 AS level FROM ({_NAMED}) UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2""")
def bfs_depth2_branch4(spark, d):
    """Two steps from one name, at most four edges of a kind at each node."""
    e = views.edges(spark, d).where("confidence >= 0.5").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "kind")
    entries = views.symbols(spark, d).where("name = 'red widget'").select(F.col("id").alias("node"))
    return graph.bfs(e, entries, depth=2, branching=4)


@query(f"WITH {E}, {S} SELECT to_id AS src, from_id AS dst FROM edges WHERE kind = 'Extends' AND confidence >= 0.5")
def preset_subclasses(spark, d):
    """The edges that the question for subclasses walks."""
    return graph.preset(views.edges(spark, d), "subclasses")


@query(f"WITH {E}, {S} SELECT DISTINCT a.path AS src, b.path AS dst FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.id = e.to_id WHERE a.path <> b.path")
def snapshot_projection(spark, d):
    """Symbol edges as file edges."""
    return graph.snapshot(views.edges(spark, d), views.symbols(spark, d))


@query(f"WITH {FE} SELECT src, dst FROM fe")
def file_edges(spark, d):
    return views.file_edges(spark, d)


@query(f"WITH RECURSIVE {FE}, {REACH}, nodes AS (SELECT src AS node FROM fe UNION SELECT dst FROM fe), en AS (SELECT node FROM nodes WHERE node LIKE '%/s9.ts') SELECT (SELECT count(*) FROM (SELECT node FROM en UNION SELECT dst FROM reach WHERE src IN (SELECT node FROM en))) AS reachable, (SELECT count(*) FROM nodes) AS total")
def attack_surface(spark, d):
    """How many files the files of one size lead to."""
    entries = views.files(spark, d).where("node LIKE '%/s9.ts'")
    return graph.attack_surface(views.file_edges(spark, d), entries)


@query(f"WITH RECURSIVE {FE}, {REACH} SELECT f.node, count(r.src) AS blast FROM files f LEFT JOIN reach r ON r.dst = f.node AND r.src <> r.dst GROUP BY f.node")
def blast_radius(spark, d):
    return graph.blast_radius(views.file_edges(spark, d), views.files(spark, d))


@query(f"WITH RECURSIVE {FE}, {REACH}, {SCC} SELECT node, scc FROM scc")
def scc(spark, d):
    return graph.scc(views.file_edges(spark, d), views.files(spark, d))


@query(f"WITH RECURSIVE {FE}, {REACH}, {SCC}, {LEVELS} SELECT node, level FROM levels")
def levels(spark, d):
    e = views.file_edges(spark, d)
    return graph.levels(e, graph.scc(e, views.files(spark, d)))


@query(f"""WITH RECURSIVE {FE}, {REACH}, {SCC}, {LEVELS}, n AS (SELECT scc, count(*) AS n FROM scc GROUP BY scc)
SELECT fe.src, a.level AS src_level, fe.dst, b.level AS dst_level FROM fe JOIN levels a ON a.node = fe.src JOIN levels b ON b.node = fe.dst JOIN scc sa ON sa.node = fe.src JOIN scc sb ON sb.node = fe.dst JOIN n ON n.scc = sa.scc
WHERE a.level < b.level OR (sa.scc = sb.scc AND n.n > 1 AND fe.src <> fe.dst)""")
def upward_violations(spark, d):
    e = graph.cut(views.file_edges(spark, d))
    comp = graph.cut(graph.scc(e, views.files(spark, d)))
    return graph.upward_violations(e, graph.levels(e, comp), comp)


@query(f"WITH RECURSIVE {FE}, {REACH}, {SCC}, {LEVELS}, n AS (SELECT scc, count(*) AS n FROM scc GROUP BY scc) SELECT (SELECT count(*) FROM n WHERE n.n > 1) AS cycles, (SELECT count(*) FROM n) AS scc_count, max(level)::BIGINT AS max_level, greatest(0, max(level) - 1)::BIGINT AS max_depth, max(level)::BIGINT AS longest_chain_edges FROM levels")
def structure_summary(spark, d):
    e = graph.cut(views.file_edges(spark, d))
    comp = graph.cut(graph.scc(e, views.files(spark, d)))
    return am.structure(comp, graph.levels(e, comp))


_DEGREE = "deg AS (SELECT f.node, coalesce(o.n, 0) AS o, coalesce(i.n, 0) AS i FROM files f LEFT JOIN (SELECT src AS node, count(*) AS n FROM fe GROUP BY src) o USING (node) LEFT JOIN (SELECT dst AS node, count(*) AS n FROM fe GROUP BY dst) i USING (node))"


@query(f'WITH {FE}, {_DEGREE} SELECT node, o AS "out", i AS in_ FROM deg')
def degrees(spark, d):
    return am.degrees(views.file_edges(spark, d), views.files(spark, d))


@query(f"WITH {FE}, {_DEGREE}, r AS (SELECT o, row_number() OVER (ORDER BY o, node) AS i, count(*) OVER () AS n FROM deg) SELECT round(CASE WHEN sum(o) = 0 THEN 0 ELSE 2.0 * sum(i * o) / (max(n) * sum(o)) - (max(n) + 1.0) / max(n) END, 9) AS gini FROM r")
def gini_outdegree(spark, d):
    return am.gini(am.degrees(views.file_edges(spark, d), views.files(spark, d)), "out").select(F.round("gini", 9).alias("gini"))


@query(f"WITH {FE}, {_DEGREE}, r AS (SELECT o, row_number() OVER (ORDER BY o) - 1 AS i, count(*) OVER () AS n FROM deg) SELECT o AS median FROM r WHERE i = n // 2")
def median_outdegree(spark, d):
    return am.upper_median(am.degrees(views.file_edges(spark, d), views.files(spark, d)), "out")


@query(f"""WITH {FE}, x AS (SELECT regexp_extract(src, '^(.*)/[^/]*$', 1) AS a, regexp_extract(dst, '^(.*)/[^/]*$', 1) AS b FROM fe), m AS (SELECT count(*)::DOUBLE AS m FROM x),
c AS (SELECT c, sum(k) AS kout, sum(i) AS kin, sum(t) AS intra FROM (SELECT a AS c, 1 AS k, 0 AS i, CASE WHEN a = b THEN 1 ELSE 0 END AS t FROM x UNION ALL SELECT b, 0, 1, 0 FROM x) GROUP BY c)
SELECT round(sum(intra / m - kout * kin / (m * m)), 9) AS q FROM c, m""")
def newman_q(spark, d):
    return am.newman_q(views.file_edges(spark, d)).select(F.round("q", 9).alias("q"))


_M = f"WITH RECURSIVE {FE}, {REACH}, {SCC}, {LEVELS}, {METRICS}"


def _metrics(spark, d):
    return am.file_metrics(graph.cut(views.file_edges(spark, d)), views.files(spark, d))


@query(f'{_M} SELECT node, module, level, blast, "out", in_, cross_out, upward FROM m')
def file_metrics(spark, d):
    """Everything that is known of each file; the culprit lists are cut from it."""
    return _metrics(spark, d).select("node", "module", "level", "blast", "out", "in_", "cross_out", "upward")


@query(f'{_M} SELECT node, round(cross_out * sqrt("out"), 3) AS score, cross_out, "out", module FROM m ORDER BY cross_out * sqrt("out") DESC, node LIMIT 10')
def culprits_modularity(spark, d):
    return am.modularity_culprits(_metrics(spark, d))


@query(f'{_M} SELECT node, level, blast, "out" FROM m ORDER BY level DESC, blast DESC, node LIMIT 10')
def culprits_depth(spark, d):
    return am.depth_culprits(_metrics(spark, d))


@query(f'{_M} SELECT node, blast, in_, "out" FROM m ORDER BY blast DESC, node LIMIT 10')
def culprits_blast(spark, d):
    return am.blast_culprits(_metrics(spark, d))


@query(f'{_M}, md AS (SELECT "out" AS median FROM (SELECT "out", row_number() OVER (ORDER BY "out") - 1 AS i, count(*) OVER () AS n FROM m) WHERE i = n // 2) SELECT node, "out", abs("out" - median) AS deviation FROM m, md ORDER BY deviation DESC, node LIMIT 10')
def culprits_equality(spark, d):
    return am.equality_culprits(_metrics(spark, d))


@query(f"""WITH RECURSIVE {FE}, {REACH}, {SCC}, {LEVELS}, c AS (SELECT count(*) FILTER (a.level < b.level) AS above, count(*) FILTER (a.level > b.level) AS below, count(*) FILTER (a.level = b.level) AS same_level, count(*) AS m FROM fe JOIN levels a ON a.node = fe.src JOIN levels b ON b.node = fe.dst),
n AS (SELECT count(*) AS size FROM levels), p AS (SELECT count(*) AS pairs FROM reach WHERE src <> dst)
SELECT size, above, below, same_level, round(m / (size * (size - 1))::DOUBLE, 9) AS density, round(pairs / (size * size)::DOUBLE, 9) AS propagation_cost FROM c, n, p""")
def dsm_summary(spark, d):
    e = graph.cut(views.file_edges(spark, d))
    level = graph.cut(graph.levels(e, graph.scc(e, views.files(spark, d))))
    return am.structure_matrix(e, level).withColumns({c: F.round(c, 9) for c in ("density", "propagation_cost")})


@query(f"""WITH RECURSIVE {FE}, {REACH}, {SCC}, {LEVELS}, t AS (SELECT max(level) AS top FROM levels) SELECT node, level, top AS max_level FROM levels, t WHERE level >= top - 1 ORDER BY level DESC, node LIMIT 20""")
def matrix_depth(spark, d):
    """The files on the two top levels, as read off a structure matrix."""
    e = graph.cut(views.file_edges(spark, d))
    return am.matrix_culprits(graph.cut(graph.levels(e, graph.scc(e, views.files(spark, d)))), e)["depth"]


@query("""WITH x AS (SELECT n_nationkey AS k, count(*) AS c, avg(c_acctbal) AS b, count(*) FILTER (c_acctbal < 0) AS w FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey),
y AS (SELECT k, (k / 50.0 + 0.5) / 1.5 AS modularity, 1.0 / (1 + k % 4) AS acyclicity, 1.0 / (1 + k / 8.0) AS depth, 1 - k / 100.0 AS equality, 1 - w / c::DOUBLE AS redundancy FROM x)
SELECT k AS node, round(modularity, 6)::DOUBLE AS modularity, round(acyclicity, 6)::DOUBLE AS acyclicity, round(depth, 6)::DOUBLE AS depth, round(equality, 6)::DOUBLE AS equality, round(redundancy, 6) AS redundancy, round(pow(modularity * acyclicity * depth * equality * redundancy, 0.2) * 10000, 4) AS signal FROM y""")
def five_dim_score(spark, d):
    """The five-dimension score of figures by nation: key as modularity and depth, negative balances as waste."""
    x = views.table(spark, d, "customer").join(views.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_nationkey").cast("long").alias("node")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("c_acctbal") < 0).alias("w"))
    s = am.quality_score(F.col("node") / 50.0, F.col("node") % 4, F.col("node"), F.col("node") / 100.0, F.col("w"), F.col("c"))
    got = x.select("node", s.alias("s")).select("node", "s.*")
    return got.select("node", *[F.round(c, 6).alias(c) for c in ("modularity", "acyclicity", "depth", "equality", "redundancy")], F.round("signal", 4).alias("signal"))
