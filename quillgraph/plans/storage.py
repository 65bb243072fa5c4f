"""Look-ups, edge tables and name resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ranking, resolve, store
from . import views
from .registry import query

S, E, A = views.SYMBOLS, views.EDGES, views.ATTEMPTS


@query(f"WITH {S} SELECT id, kind, path FROM symbols WHERE name = 'red widget'")
def symbol_lookup(spark, d):
    return store.by_name(views.symbols(spark, d), "red widget").select("id", "kind", "path")


@query(f"WITH {S} SELECT * FROM symbols WHERE id = 7")
def symbol_by_id(spark, d):
    return store.by_id(views.symbols(spark, d), 7)


@query(f"WITH {S} SELECT DISTINCT path FROM symbols")
def files(spark, d):
    return store.files(views.symbols(spark, d))


@query(f"WITH {S} SELECT id, name, start_line FROM symbols WHERE path = 'Brand#2'")
def symbols_in_file(spark, d):
    return store.in_file(views.symbols(spark, d), "Brand#2").select("id", "name", "start_line")


@query(f"WITH {S} SELECT name, min(id) AS id FROM symbols GROUP BY name HAVING count(*) = 1")
def global_unique_name(spark, d):
    return resolve.unique_names(views.symbols(spark, d))


@query(f"WITH {S} SELECT path, arg_min(id, start_line::BIGINT * 1000000000 + id) AS from_id FROM symbols GROUP BY path")
def first_in_file(spark, d):
    return resolve.first_symbols(views.symbols(spark, d))


@query(f"WITH {E} SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edges_by_kind(spark, d):
    return store.count_by_kind(views.edges(spark, d))


@query(f"WITH {E} SELECT kind, round(confidence, 1) AS bucket, count(*) AS n FROM edges GROUP BY ALL")
def edges_by_kind_conf(spark, d):
    return store.count_by_kind_and_confidence(views.edges(spark, d))


@query(f"WITH {E} SELECT * FROM edges")
def edge_first_wins(spark, d):
    return views.edges(spark, d)


@query(f"WITH {E}, {S} SELECT e.from_id, e.to_id, e.kind, e.confidence, a.name AS from_name, a.path AS from_path, b.name AS to_name, b.path AS to_path FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.id = e.to_id WHERE e.kind = 'Calls'")
def edges_dump(spark, d):
    return store.dump_edges(views.edges(spark, d), views.symbols(spark, d), "Calls")


@query(f"WITH {E}, {S} SELECT e.from_id, e.to_id, e.kind, e.confidence, a.name AS from_name, a.path AS from_path, b.name AS to_name, b.path AS to_path FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.id = e.to_id ORDER BY e.from_id, e.to_id, e.kind LIMIT 100")
def edges_dump_limited(spark, d):
    """The first hundred edges of any kind: the limit is the report's own."""
    return store.dump_edges(views.edges(spark, d), views.symbols(spark, d), None, 100)


@query(f"WITH {E} SELECT from_id AS src, to_id AS dst FROM edges WHERE kind IN ('Calls', 'Extends') AND confidence >= 0.9")
def edges_filtered(spark, d):
    from ..operators import graph

    return graph.edges_of_kinds(views.edges(spark, d), ["Calls", "Extends"], 0.9)


@query(f"WITH {A} SELECT kind, count(*) FILTER (confidence >= 0.9) AS resolved, count(*) FILTER (confidence < 0.9) AS unresolved FROM attempts GROUP BY kind")
def edge_stats(spark, d):
    """Attempts by kind; one below 0.9 counts as unresolved here."""
    tries = views.attempts(spark, d).select("kind", F.when(F.col("confidence") >= 0.9, F.col("confidence")).alias("confidence"))
    return resolve.edge_stats(tries)


@query(f"WITH {E}, {S} SELECT DISTINCT a.path, b.path AS target FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.id = e.to_id WHERE e.kind = 'Imports'")
def import_targets(spark, d):
    return resolve.import_targets(views.edges(spark, d), views.symbols(spark, d))


_REFS = "refs AS (SELECT * FROM (SELECT id AS ref, path, lead(name) OVER (PARTITION BY kind ORDER BY id) AS name, kind AS qualifier FROM symbols) WHERE name IS NOT NULL)"
_HERE = "here AS (SELECT path, name, min(id) AS id FROM symbols GROUP BY ALL), uniq AS (SELECT name, min(id) AS id FROM symbols GROUP BY name HAVING count(*) = 1)"
_TARGETS = "used AS (SELECT a.path, b.path AS target, count(*) AS n FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.id = e.to_id WHERE e.kind = 'Imports' AND a.path <> b.path GROUP BY ALL), targets AS (SELECT path, target FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n, target) AS r FROM used) WHERE r <= 2)"
_VIA = "via AS (SELECT path, name, id FROM (SELECT r.path, r.name, h.id, row_number() OVER (PARTITION BY r.path, r.name ORDER BY t.target, h.id) AS rn FROM (SELECT DISTINCT path, name FROM refs) r JOIN targets t ON t.path = r.path JOIN here h ON h.path = t.target AND h.name = r.name) WHERE rn = 1)"


def _references(spark, d):
    w = Window.partitionBy("kind").orderBy("id")
    s = views.symbols(spark, d)
    return s.select(F.col("id").alias("ref"), "path", F.lead("name").over(w).alias("name"), F.col("kind").alias("qualifier")).where("name IS NOT NULL")


def _rare_targets(spark, d):
    """Each file's two least used import targets, so that all three steps of the resolver find something."""
    s = views.symbols(spark, d).select("id", "path")
    e = views.edges(spark, d).where("kind = 'Imports'").join(s.select(F.col("id").alias("from_id"), "path"), "from_id").join(s.select(F.col("id").alias("to_id"), F.col("path").alias("target")), "to_id")
    n = e.where("path <> target").groupBy("path", "target").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_k(n, ["path"], [F.asc("n"), F.asc("target")], 2).select("path", "target")


@query(f"""WITH {E}, {S}, {_REFS}, {_HERE}, {_TARGETS}, {_VIA}
SELECT r.ref, r.path, r.name, coalesce(h.id, v.id, u.id) AS to_id, CAST(CASE WHEN h.id IS NOT NULL THEN 1.0 WHEN v.id IS NOT NULL THEN 0.9 WHEN u.id IS NOT NULL THEN 0.7 END AS DOUBLE) AS confidence
FROM refs r LEFT JOIN here h ON h.path = r.path AND h.name = r.name LEFT JOIN via v ON v.path = r.path AND v.name = r.name LEFT JOIN uniq u ON u.name = r.name""")
def resolver_3step(spark, d):
    """Names resolved in the same file, then in imported files, then globally."""
    refs = _references(spark, d).drop("qualifier")
    return resolve.resolve_names(refs, views.symbols(spark, d), _rare_targets(spark, d))


_NS = "ns AS (SELECT path, kind AS alias, min(target) AS target_file FROM (SELECT DISTINCT path, kind FROM symbols) JOIN targets USING (path) WHERE kind <> 'ECONOMY' GROUP BY path, kind)"


@query(f"""WITH {E}, {S}, {_REFS}, {_HERE}, {_TARGETS}, {_VIA}, {_NS}
SELECT r.ref, r.path, r.name, r.qualifier, coalesce(n.id, h.id, v.id, u.id) AS to_id, CAST(CASE WHEN n.id IS NOT NULL THEN 0.9 WHEN h.id IS NOT NULL THEN 1.0 WHEN v.id IS NOT NULL THEN 0.9 WHEN u.id IS NOT NULL THEN 0.7 END AS DOUBLE) AS confidence
FROM refs r LEFT JOIN ns ON ns.path = r.path AND ns.alias = r.qualifier LEFT JOIN here n ON n.path = ns.target_file AND n.name = r.name
LEFT JOIN here h ON h.path = r.path AND h.name = r.name LEFT JOIN via v ON v.path = r.path AND v.name = r.name LEFT JOIN uniq u ON u.name = r.name""")
def namespace_resolve(spark, d):
    """The same with a namespace before the name, tried first."""
    t = _rare_targets(spark, d)
    ns = views.symbols(spark, d).select("path", "kind").distinct().where("kind <> 'ECONOMY'").join(t, "path").groupBy(F.col("path").alias("file"), F.col("kind").alias("alias")).agg(F.min("target").alias("target_file"))
    return resolve.resolve_names(_references(spark, d), views.symbols(spark, d), t, ns)


@query(f"""WITH {S}, c AS (SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, p.p_brand AS path, CAST(l_quantity AS INTEGER) AS row FROM lineitem JOIN part p ON p.p_partkey = l_partkey),
k AS (SELECT DISTINCT path, row FROM c),
m AS (SELECT k.path, k.row, s.id AS from_id, row_number() OVER (PARTITION BY k.path, k.row ORDER BY s.end_line - s.start_line, s.start_line, s.id) AS rn FROM k JOIN symbols s ON s.path = k.path AND k.row BETWEEN s.start_line AND s.end_line)
SELECT path, "row", from_id FROM m WHERE rn = 1""")
def enclosing_interval(spark, d):
    """Every place (file, line) that a line item names, and the smallest symbol around it."""
    p = views.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path"))
    c = views.table(spark, d, "lineitem").join(p, "l_partkey").select("path", F.col("l_quantity").cast("int").alias("row")).distinct()
    return resolve.enclosing(c, views.symbols(spark, d)).select("path", "row", "from_id")


@query("""WITH f AS (SELECT DISTINCT regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL),
i AS (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS leaf FROM f),
c AS (SELECT path, unnest([dir || '/' || CAST(TRY_CAST(leaf AS BIGINT) + k AS VARCHAR) FOR k IN [1, 2, 3, 5, 8, 13, 21]]) AS cand, unnest([1, 2, 3, 4, 5, 6, 7]) AS pos FROM i WHERE TRY_CAST(leaf AS BIGINT) IS NOT NULL),
t AS (SELECT c.path, arg_min(c.cand, c.pos) AS target_file FROM c JOIN f ON f.path = c.cand GROUP BY c.path)
SELECT i.path, t.target_file FROM i LEFT JOIN t USING (path) WHERE TRY_CAST(i.leaf AS BIGINT) IS NOT NULL""")
def candidate_path_probe(spark, d):
    """Each page's address with the first existing one of an ordered list of neighbours."""
    f = views.table(spark, d, "pages").where("url IS NOT NULL").select(F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path")).distinct()
    leaf = F.expr("try_cast(regexp_extract(path, '([^/]*)$', 1) AS BIGINT)")
    tries = F.array(*[F.concat(F.regexp_replace("path", r"/[^/]*$", ""), F.lit("/"), (leaf + k).cast("string")) for k in (1, 2, 3, 5, 8, 13, 21)])
    return resolve.first_existing(f.where(leaf.isNotNull()).withColumn("tries", tries), f, "tries")


@query(f"""WITH {A} SELECT file, alias, target_file, target_member FROM (SELECT CAST(from_id AS VARCHAR) AS file, kind AS alias, CAST(to_id AS VARCHAR) AS target_file, CASE WHEN confidence = 1.0 THEN 'default' END AS target_member,
row_number() OVER (PARTITION BY from_id, kind ORDER BY l_orderkey, l_linenumber, l_suppkey, to_id) AS rn FROM attempts) WHERE rn = 1""")
def alias_first_wins(spark, d):
    """Alias declarations: of repeated (file, alias) the first stays; namespaces have no member."""
    rows = views.attempts(spark, d).select(F.col("from_id").cast("string").alias("file"), F.col("kind").alias("alias"), F.col("to_id").cast("string").alias("target_file"), F.when(F.col("confidence") == 1.0, "default").alias("target_member"), "l_orderkey", "l_linenumber", "l_suppkey", "to_id")
    return ranking.first_wins(rows, ["file", "alias"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "to_id")]).select("file", "alias", "target_file", "target_member")


@query(f"WITH {S}, r AS (SELECT id, path, name, kind, row_number() OVER (PARTITION BY path, name ORDER BY start_line DESC, id) AS rn, start_line AS score FROM symbols) SELECT id, path, name, kind, score FROM r WHERE rn = 1 ORDER BY score DESC, id LIMIT 25")
def dedupe_ranked(spark, d):
    """A ranked list of 25 without repeats of path and name."""
    s = views.symbols(spark, d).select("id", "path", "name", "kind", F.col("start_line").alias("score"))
    return ranking.dedupe_ranked(s, [], [F.col("score") * -1, F.col("id")], 25)


@query(f"WITH {S} SELECT row_number() OVER (ORDER BY path, start_line, id) AS number, id FROM symbols")
def numbered_symbols(spark, d):
    """Ids by (path, position), the same on every run."""
    s = views.symbols(spark, d).select("path", "start_line", "id")
    return ranking.number_rows(s, ["path", "start_line", "id"], "number").select("number", "id")


@query("SELECT regexp_extract(url, '^https?://[^/]*/?([^?#]*)', 1) AS path, CASE WHEN regexp_extract(url, '^https?://[^/]*/?([^?#]*)', 1) LIKE '%/%' THEN regexp_extract(regexp_extract(url, '^https?://[^/]*/?([^?#]*)', 1), '^(.*)/[^/]*$', 1) ELSE '<root>' END AS module, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY ALL")
def module_of(spark, d):
    p = views.table(spark, d, "pages").where("url IS NOT NULL").select(F.regexp_extract("url", r"^https?://[^/]*/?([^?#]*)", 1).alias("path"))
    return p.select("path", tx.module_of(F.col("path")).alias("module")).groupBy("path", "module").agg(F.count(F.lit(1)).alias("n"))
