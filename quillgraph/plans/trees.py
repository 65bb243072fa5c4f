"""Source trees, the edge builder, the store, reports and files, driven by text that is made of the driver's tables.

Parts of one brand are a file: a script whose functions each call the function of the next part, that
imports one function of the next file, and that ends in an interface and a class; and a Python file
with the same functions.  What extractors and resolvers find in them follows from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import text as tx
from ..operators import archmetrics as am
from ..operators import graph, ranking, resolve, store
from ..operators import retrieval as rt
from ..operators.state import shared_dir
from ..sources import reports, scan, walk
from . import retrieval, views
from .graphs import LEVELS, REACH, SCC, FE, S, E, _NAMED, ppr_sql
from .registry import query


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """k and the number b of its brand."""
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("b"))


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    """path, content, lang of a script for each brand."""
    p = _parts(spark, d)
    least = p.groupBy("b").agg(F.min("k").alias("m"))
    at = least.agg(F.array_sort(F.collect_list(F.struct("b", "m"))).alias("brands"))  # as many entries as there are brands
    line = F.concat(F.lit("export function fn_"), F.col("k").cast("string"), F.lit("() { fn_"), (F.col("k") + 1).cast("string"), F.lit("(); }\n"))
    body = p.groupBy("b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("t")))), lambda x: x["t"]), "").alias("body"))
    place = F.array_position(F.transform("brands", lambda x: x["b"]), F.col("b")).cast("int")
    after = F.element_at("brands", F.when(place == F.size("brands"), 1).otherwise(place + 1))
    rows = body.crossJoin(F.broadcast(at)).withColumn("n", after)
    head = F.concat(F.lit("import { fn_"), F.col("n")["m"].cast("string"), F.lit(' } from "./brand'), F.col("n")["b"], F.lit('"; // import x from "./no"\n'))
    tail = F.concat(F.lit("export interface I"), F.col("b"), F.lit(" {}\nexport class C"), F.col("b"), F.lit(" extends C"), F.col("n")["b"], F.lit(" implements I"), F.col("b"), F.lit(" {}\n"))
    return rows.select(F.concat(F.lit("lib/brand"), "b", F.lit(".ts")).alias("path"), F.concat(head, "body", tail).alias("content"), F.lit("typescript").alias("lang"))


def _symbols(found: DataFrame) -> DataFrame:
    """Numbered; to be written where they are read more than once."""
    return ranking.number_rows(scan.symbols_of(found), ["path", "byte", "name"])


PARTS = "p AS (SELECT p_partkey AS k, regexp_extract(p_brand, '([0-9]+)', 1) AS b FROM part)"
FILES = f"""{PARTS}, brands AS (SELECT b, min(k) AS m, count(*) AS n FROM p GROUP BY b),
f AS (SELECT b, m, n, coalesce(lead(b) OVER (ORDER BY b), first_value(b) OVER (ORDER BY b)) AS nb, coalesce(lead(m) OVER (ORDER BY b), first_value(m) OVER (ORDER BY b)) AS nm FROM brands),
fn AS (SELECT k, b, 'lib/brand' || b || '.ts' AS path, row_number() OVER (PARTITION BY b ORDER BY k) AS i FROM p)"""


@query(f"""WITH {FILES} SELECT 'function_declaration' AS kind, 'fn_' || k AS name, path, i + 1 AS start_line, i + 1 AS end_line, 'function fn_' || k || '() {{ fn_' || (k + 1) || '(); }}' AS snippet FROM fn
UNION ALL SELECT 'interface_declaration', 'I' || b, 'lib/brand' || b || '.ts', n + 2, n + 2, 'interface I' || b || ' {{}}' FROM f
UNION ALL SELECT 'class_declaration', 'C' || b, 'lib/brand' || b || '.ts', n + 3, n + 3, 'class C' || b || ' extends C' || nb || ' implements I' || b || ' {{}}' FROM f""")
def extract_scripts(spark, d):
    """Symbols of scripts: kind, name, place and text."""
    return _symbols(graph.cut(scan.extract(_scripts(spark, d)))).select("kind", "name", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "snippet")


@query(f"""WITH {PARTS}, fn AS (SELECT k, b, row_number() OVER (PARTITION BY b ORDER BY k) AS i, count(*) OVER (PARTITION BY b) AS n FROM p)
SELECT 'function_definition' AS kind, 'fn_' || k AS name, 'lib/b' || b || '.py' AS path, 2 * i - 1 AS start_line, 2 * i AS end_line FROM fn
UNION ALL SELECT DISTINCT 'class_definition', 'Brand', 'lib/b' || b || '.py', 2 * n + 1, 2 * n + 3 FROM fn UNION ALL SELECT DISTINCT 'function_definition', 'inner', 'lib/b' || b || '.py', 2 * n + 2, 2 * n + 3 FROM fn""")
def extract_python(spark, d):
    """Functions, classes and nested methods of Python files."""
    line = F.concat(F.lit("def fn_"), F.col("k").cast("string"), F.lit("(x):\n    return fn_"), (F.col("k") + 1).cast("string"), F.lit("(x)\n"))
    body = _parts(spark, d).groupBy("b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("t")))), lambda x: x["t"]), "").alias("body"))
    files = body.select(F.concat(F.lit("lib/b"), "b", F.lit(".py")).alias("path"), F.concat("body", F.lit("class Brand:\n    async def inner(self):\n        pass\n")).alias("content"), F.lit("python").alias("lang"))
    return _symbols(graph.cut(scan.extract(files))).select("kind", "name", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query(f"""WITH {FILES} SELECT 'fn_' || a.k AS from_name, 'fn_' || c.k AS to_name, 'Calls' AS kind, CAST(CASE WHEN a.b = c.b THEN 1.0 WHEN f.nb = c.b THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence FROM fn a JOIN fn c ON c.k = a.k + 1 JOIN f ON f.b = a.b
UNION ALL SELECT 'fn_' || m, 'fn_' || nm, 'Imports', 1.0 FROM f
UNION ALL SELECT 'C' || b, 'C' || nb, 'Extends', 0.9 FROM f UNION ALL SELECT 'C' || b, 'I' || b, 'Implements', 1.0 FROM f""")
def edge_builder(spark, d):
    """Edges of a tree: the import pass first, then calls, bases and interfaces by the resolver's three steps."""
    found = graph.cut(scan.extract(_scripts(spark, d)))
    s = graph.cut(_symbols(found))
    edges, _, _ = resolve.build_edges(s, scan.captures_of(found))
    name = lambda side: s.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    return edges.join(name("from"), "from_id").join(name("to"), "to_id").select("from_name", "to_name", "kind", "confidence")


@query(f"""WITH {FILES} SELECT 'Calls' AS kind, count(c.k) AS resolved, count(*) - count(c.k) AS unresolved FROM fn a LEFT JOIN fn c ON c.k = a.k + 1
UNION ALL SELECT unnest(['Imports', 'Extends', 'Implements']), count(*), 0 FROM f""")
def edge_builder_attempts(spark, d):
    """What the edge builder tried, by kind."""
    found = graph.cut(scan.extract(_scripts(spark, d)))
    _, _, attempts = resolve.build_edges(graph.cut(_symbols(found)), scan.captures_of(found))
    return resolve.edge_stats(attempts)


@query(f"WITH {FILES} SELECT 'lib/brand' || b || '.ts' AS file, 'fn_' || nm AS alias, 'lib/brand' || nb || '.ts' AS target_file, 'fn_' || nm AS target_member FROM f")
def alias_declarations(spark, d):
    """What each file's imports declare."""
    found = graph.cut(scan.extract(_scripts(spark, d)))
    _, aliases, _ = resolve.build_edges(graph.cut(_symbols(found)), scan.captures_of(found))
    return aliases.select("file", "alias", "target_file", "target_member")


@query(f"WITH {FILES} SELECT 'lib/brand' || b || '.ts' AS path, './brand' || nb AS spec FROM f")
def script_imports(spark, d):
    """Imports as the analyser reads them; those in comments are none."""
    return walk.script_imports(_scripts(spark, d))


@query(f"WITH {FILES} SELECT 'lib/brand' || b || '.ts' AS src, 'lib/brand' || nb || '.ts' AS dst FROM f")
def script_graph(spark, d):
    """Imports resolved to files by the analyser's candidates."""
    return walk.script_graph(_scripts(spark, d))


# files on disk


def _tree(spark: SparkSession, d: str) -> str:
    """A small tree of a file for each nation, some in folders that are skipped or ignored, some hidden, some no text."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    files = {".gitignore": b"src/r1/\n*.tmp.ts\n"}
    for r in views.table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():  # a table of fixed size
        k, folder = r["n_nationkey"], f"src/r{r['n_regionkey']}"
        folder += "/node_modules" if k % 5 == 0 else "/.hidden" if k % 7 == 0 else ""
        body = f"export function land_{k}() {{ land_{k + 1}(); }}\n".encode()
        files[f"{folder}/n{k}{'.tmp' if k % 9 == 4 else ''}.ts"] = b"\xff\xfe" + body if k % 11 == 3 else body
    for name, body in files.items():
        out = fs.create(path(f"{root}/{name}"))
        out.write(bytearray(body))
        out.close()
    return root


NATIONS = """files AS (SELECT n_nationkey AS k, n_regionkey AS r, 'src/r' || n_regionkey || CASE WHEN n_nationkey % 5 = 0 THEN '/node_modules' WHEN n_nationkey % 7 = 0 THEN '/.hidden' ELSE '' END || '/n' || n_nationkey || CASE WHEN n_nationkey % 9 = 4 THEN '.tmp' ELSE '' END || '.ts' AS path FROM nation),
seen AS (SELECT * FROM files WHERE (k % 5 = 0 OR k % 7 <> 0) AND r <> 1 AND k % 9 <> 4 AND k % 11 <> 3)"""


@query(f"WITH {NATIONS} SELECT path, CASE WHEN path NOT LIKE '%/node_modules/%' THEN 'typescript' END AS lang, length('export function land_() {{ land_(); }}') + 1 + length(k::VARCHAR) + length((k + 1)::VARCHAR) AS n FROM seen")
def tree_walk(spark, d):
    """A tree read from disk: ignored, hidden and undecodable files stay out, folders that are skipped have no language."""
    rows = walk.read_tree(spark, _tree(spark, d))
    return rows.select("path", walk.language_of(F.col("path")).alias("lang"), F.length("content").cast("long").alias("n"))


@query(f"WITH {NATIONS} SELECT path, path NOT LIKE '%/node_modules/%' AND path NOT LIKE '%/.hidden/%' AS script FROM files")
def script_filter(spark, d):
    """The files that the import analysis looks at."""
    n = views.table(spark, d, "nation")
    k = F.col("n_nationkey")
    folder = F.when(k % 5 == 0, "/node_modules").when(k % 7 == 0, "/.hidden").otherwise("")
    path = F.concat(F.lit("src/r"), F.col("n_regionkey").cast("string"), folder, F.lit("/n"), k.cast("string"), F.when(k % 9 == 4, ".tmp").otherwise(""), F.lit(".ts"))
    return n.select(path.alias("path"), walk.is_script(path).alias("script"))


@query(f"""WITH {NATIONS}, fn AS (SELECT k, path FROM seen WHERE path NOT LIKE '%/node_modules/%')
SELECT a.path, 'land_' || a.k AS name, CASE WHEN b.k IS NOT NULL THEN 'land_' || b.k END AS calls, CASE WHEN b.k IS NOT NULL THEN 0.7 END::DOUBLE AS confidence, (SELECT count(*) FROM fn) AS symbols, (SELECT count(*) FROM fn x JOIN fn y ON y.k = x.k + 1) AS edges
FROM fn a LEFT JOIN fn b ON b.k = a.k + 1""")
def index_repo(spark, d):
    """A tree indexed into a store: its symbols, whom each calls, and the counts that the operation returns."""
    e = Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}")
    got = e.index_repo(_tree(spark, d))
    s = e.symbols.select("id", "path", "name")
    to = e.edges.select(F.col("from_id").alias("id"), "to_id", "confidence").join(s.select(F.col("id").alias("to_id"), F.col("name").alias("calls")), "to_id").drop("to_id")
    return s.join(to, "id", "left").select("path", "name", "calls", "confidence", F.lit(got["symbols_indexed"]).cast("long").alias("symbols"), F.lit(got["edges_built"]).cast("long").alias("edges"))


@query("SELECT 'symbols' AS what, (SELECT count(*) FROM part WHERE p_brand <> 'Brand#13') + 1 AS n UNION ALL SELECT 'edges', 1 UNION ALL SELECT 'alias_decls', (SELECT count(*) FROM region) UNION ALL SELECT 'lengths', (SELECT count(*) FROM part WHERE p_brand <> 'Brand#13') + 1 UNION ALL SELECT 'after clear', 0 UNION ALL SELECT 'after an empty run', (SELECT count(*) FROM part WHERE p_brand <> 'Brand#13') + 1 UNION ALL SELECT 'needs reindex', 1")
def store_writes(spark, d):
    """Appending, replacing a path, inserting or ignoring, clearing, and a run that finds nothing."""
    st = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    s = views.symbols(spark, d).withColumns({"snippet": F.col("name"), "search_blob": F.lit(""), "embedding": F.array().cast("array<float>")})
    st.append(s.where("id % 2 = 0"))
    st.append(s.where("id % 2 = 1"))
    st.replace_paths(spark.createDataFrame([("Brand#13",)], "path string"), s.limit(1).select(F.lit(st.top_id() + 1).alias("id"), *[c for c in s.columns if c != "id"]))
    edge = spark.createDataFrame([(1, 2, "Imports", 0.9)], "from_id long, to_id long, kind string, confidence double")
    keep = st.table("symbols").orderBy("id").limit(2).agg(F.min("id").alias("from_id"), F.max("id").alias("to_id"))
    edge = edge.drop("from_id", "to_id").crossJoin(F.broadcast(keep))
    st.add_edges(edge)
    st.add_edges(edge.withColumn("confidence", F.lit(1.0)))
    flagged = store.needs_reindex(st.table("edges"), st.table("alias_decls"))
    a = views.table(spark, d, "region").select(F.col("r_name").alias("file"), F.lit("x").alias("alias"), F.lit("t").alias("target_file"), F.lit(None).cast("string").alias("target_member"))
    st.add_aliases(a.unionByName(a))
    st.add_aliases(a)
    count = lambda what, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    out = [count(t, st.table(t)) for t in ("symbols", "edges", "alias_decls")] + [count("lengths", st.index().lengths)]
    st.replace_unless_empty(s.where("false"), st.table("edges"), st.table("alias_decls"))
    out.append(count("after an empty run", st.table("symbols")))
    other = store.Store(spark, f"{st.path}-2")
    other.append(s)
    other.clear()
    out += [count("after clear", other.table("symbols")), spark.createDataFrame([("needs reindex", int(flagged))], "what string, n long")]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


@query(f"WITH {retrieval.bm25_sql(retrieval._ALL)} SELECT qid, id, round(bm25_score, 6) AS score FROM bm")
def stored_search(spark, d):
    """All questions over the store's full-text index: of the postings, only those of the questions' terms are read."""
    st = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    st.append(views.documents(spark, d).withColumn("embedding", F.array().cast("array<float>")))
    return rt.bm25(st.index(), retrieval.questions(spark)).select("qid", "id", F.round("bm25_score", 6).alias("score"))


@query(f"""WITH {E}, {S}, x AS (SELECT e.kind, e.confidence, a.path || ':' || a.name AS a, b.path || ':' || b.name AS b FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.id = e.to_id WHERE e.kind = 'Extends')
SELECT 'tsv' AS what, kind || '|' || CASE confidence WHEN 1 THEN '1.0' WHEN 0.9 THEN '0.9' ELSE '0.7' END || '|' || a || '|->|' || b AS line FROM x
UNION ALL SELECT 'json', r_regionkey || '|' || r_name FROM region UNION ALL SELECT 'pretty', r_regionkey || '|' || r_name FROM region UNION ALL SELECT 'columns', r_name FROM region UNION ALL SELECT 'report', count(*)::VARCHAR FROM region UNION ALL SELECT 'mirror', count(*)::VARCHAR FROM region""")
def report_files(spark, d):
    """Edge dumps, JSON results, table dumps and the mirrored report, written and read again."""
    base = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    region = views.table(spark, d, "region").select("r_regionkey", "r_name")
    reports.write_edges_tsv(store.dump_edges(views.edges(spark, d), views.symbols(spark, d), "Extends"), f"{base}/tsv")
    reports.write_json(region, f"{base}/json")
    reports.write_json(region, f"{base}/pretty", pretty_rows=True)
    reports.dump_columns(region, ["r_name", "no_such_column"], f"{base}/columns")
    reports.write_diagnostics(region.agg(F.count(F.lit(1)).alias("n")), f"{base}/report", f"{base}/mirror")
    row = "r_regionkey long, r_name string"
    both = F.concat_ws("|", F.col("r_regionkey").cast("string"), "r_name")
    pretty = spark.read.text(f"{base}/pretty", lineSep="}").where("value like '%{%'").select(F.from_json(F.concat("value", F.lit("}")), row).alias("x")).select("x.*")
    parts = {
        "tsv": spark.read.csv(f"{base}/tsv", sep="\t").select(F.concat_ws("|", "_c0", "_c1", "_c2", "_c3", "_c4").alias("line")),
        "json": spark.read.schema(row).json(f"{base}/json").select(both.alias("line")),
        "pretty": pretty.select(both.alias("line")),
        "columns": spark.read.json(f"{base}/columns").select(F.concat_ws("|", "*").alias("line")),
        "report": spark.read.json(f"{base}/report").select(F.col("n").cast("string").alias("line")),
        "mirror": spark.read.json(f"{base}/mirror").select(F.col("n").cast("string").alias("line")),
    }
    out = None
    for what, df in parts.items():
        df = df.select(F.lit(what).alias("what"), "line")
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT 'q' || n_nationkey AS id, n_regionkey::INTEGER AS axis, n_name AS query, 'src/' || n_name || '.ts' AS path, n_nationkey % 3 = 0 AS negative, false AS subject_unindexed FROM nation")
def query_set(spark, d):
    """An evaluation set read from one JSON array; what leaves `negative` out is not negative."""
    path = f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}"
    k = F.col("n_nationkey")
    row = F.struct(F.concat(F.lit("q"), k.cast("string")).alias("id"), F.col("n_regionkey").cast("int").alias("axis"), F.col("n_name").alias("query"), F.array(F.concat(F.lit("src/"), "n_name", F.lit(".ts"))).alias("expected_paths"), F.when(k % 3 == 0, True).alias("negative"))
    one = views.table(spark, d, "nation").agg(F.to_json(F.collect_list(row)).alias("value"))  # a table of fixed size
    one.coalesce(1).write.text(path)
    got = reports.read_queries(spark, path)
    return got.select("id", "axis", "query", F.col("expected_paths")[0].alias("path"), "negative", "subject_unindexed")


@query("""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation)
SELECT 'n' || a.k || '.ts' AS src, 'n' || b.k || '.ts' AS dst, a.r::INTEGER AS src_level, b.r::INTEGER AS dst_level FROM n a JOIN n b ON b.k = a.k + 1""")
def matrix_report(spark, d):
    """Levels and edges of a structure matrix report; edges to files that it does not list are left out."""
    path = f"{shared_dir(spark)}/matrix-{uuid.uuid4().hex}"
    k = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"), F.lit(".ts"))
    lines = views.table(spark, d, "nation").agg(
        F.array_join(F.collect_list(F.concat(F.col("n_regionkey").cast("string"), F.lit(" | "), name(k))), "\n").alias("files"),
        F.array_join(F.collect_list(F.concat(name(k), F.lit(" -> "), name(k + 1))), "\n").alias("edges"),
    )
    lines.select(F.concat(F.lit("# Matrix\n9 | no.ts\n## Files\n"), "files", F.lit("\n## Edges\n7 | neither.ts\n"), "edges", F.lit("\n")).alias("value")).coalesce(1).write.text(path)
    levels, edges = reports.read_matrix(spark, path)
    side = lambda s: levels.select(F.col("node").alias(s), F.col("level").alias(f"{s}_level"))
    return edges.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "src_level", "dst_level")


@query("""SELECT n_nationkey AS id, n_nationkey + 0.5 AS quality_signal, -0.25::DOUBLE AS modularity, 1.0::DOUBLE AS acyclicity, n_regionkey::DOUBLE AS depth, NULL::DOUBLE AS equality, 0.125::DOUBLE AS redundancy, 7.0::DOUBLE AS max_depth, n_regionkey::DOUBLE AS circular_dep_count, 3.0::DOUBLE AS god_file_count FROM nation""")
def health_report(spark, d):
    """The figures of a health report's text, null where it gives none."""
    text = F.format_string("Quality Signal: %s\nmodularity -0.25; ACYCLICITY: 1.0\ndepth: %s\nequality: n/a\nredundancy  .125\nmax_depth: 7\n%s: %s\ngod files 3", (F.col("n_nationkey") + 0.5).cast("string"), F.col("n_regionkey"), F.when(F.col("n_nationkey") % 2 == 0, "Cycles").otherwise("circular dep"), F.col("n_regionkey"))
    n = views.table(spark, d, "nation").select("n_nationkey", text.alias("text"))
    return n.select(F.col("n_nationkey").alias("id"), *reports.health_figures(F.col("text"))).withColumn("quality_signal", F.col("quality_signal").cast("decimal(20,1)").cast("double"))


# the ways of large graphs, on the same tables


@query(f"WITH RECURSIVE {FE}, {REACH}, {SCC} SELECT node, scc FROM scc")
def scc_joins(spark, d):
    """Strongly connected components by joins, as large graphs take them."""
    return graph.scc(views.file_edges(spark, d), views.files(spark, d), mode="joins")


@query(f"WITH RECURSIVE {FE}, {REACH}, {SCC}, {LEVELS} SELECT node, level FROM levels")
def levels_joins(spark, d):
    """Levels by joins."""
    e = graph.cut(views.file_edges(spark, d))
    return graph.levels(e, graph.cut(graph.scc(e, views.files(spark, d))), mode="joins")


@query(f"WITH RECURSIVE {FE}, {REACH} SELECT f.node, count(r.src) AS blast FROM files f LEFT JOIN reach r ON r.dst = f.node AND r.src <> r.dst GROUP BY f.node")
def blast_radius_joins(spark, d):
    """Blast radius by joins."""
    return graph.blast_radius(views.file_edges(spark, d), views.files(spark, d), mode="joins")


@query(f"WITH {E}, {S}, {ppr_sql('SELECT from_id AS src, to_id AS dst FROM edges', _NAMED, 10)} SELECT node, round(score, 9) AS score FROM p10")
def ppr_task(spark, d):
    """Ten rounds of personalised PageRank as one task; `ppr_5iter` runs by joins."""
    e = views.edges(spark, d).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    entries = views.symbols(spark, d).where("name = 'red widget'").select(F.col("id").alias("node"))
    return graph.ppr(e, entries, rounds=10, mode="task").select("node", F.round("score", 9).alias("score"))


@query(f"""WITH {E}, q AS (SELECT * FROM edges WHERE confidence >= 0.5)
SELECT 'callers' AS preset, to_id AS src, from_id AS dst FROM q WHERE kind = 'Calls' UNION ALL SELECT 'callees', from_id, to_id FROM q WHERE kind = 'Calls' UNION ALL SELECT 'subclasses', to_id, from_id FROM q WHERE kind = 'Extends'
UNION ALL SELECT 'implementations', to_id, from_id FROM q WHERE kind = 'Implements' UNION ALL SELECT 'impact', to_id, from_id FROM q UNION ALL SELECT 'cross-file', from_id, to_id FROM q WHERE kind = 'Imports'""")
def presets(spark, d):
    """The edges that each preset question walks."""
    e = graph.cut(views.edges(spark, d))
    out = None
    for name in graph.PRESETS:
        part = graph.preset(e, name).select(F.lit(name).alias("preset"), "src", "dst")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH RECURSIVE {FE}, {REACH}, {SCC}, {LEVELS}, two AS (SELECT src, dst, regexp_extract(src, '^([^/]*/[^/]*)', 1) AS a, regexp_extract(dst, '^([^/]*/[^/]*)', 1) AS b FROM fe),
m AS (SELECT src AS node, count(*) FILTER (a <> b) AS x, count(*) AS t FROM two GROUP BY src)
SELECT node, round(x / t::DOUBLE * sqrt(t), 6) AS score, x AS "cross", t AS total, round(x / t::DOUBLE, 3) AS ratio FROM m ORDER BY x / t::DOUBLE * sqrt(t) DESC, node LIMIT 20""")
def matrix_modularity(spark, d):
    """The twenty files with most references out of their module, as read off a structure matrix."""
    e = graph.cut(views.file_edges(spark, d))
    got = am.matrix_culprits(graph.cut(graph.levels(e, graph.scc(e, views.files(spark, d)))), e)["modularity"]
    return got.withColumn("score", F.round("score", 6))


# scalar rules


@query("SELECT page_id, url || ' a  b ' AS stripped FROM pages WHERE url IS NOT NULL")
def strip_comments(spark, d):
    """Comments taken out; the slashes of an address are none."""
    src = F.concat("url", F.lit(" a /* c\n"), F.col("page_id").cast("string"), F.lit(" */ b // tail"))
    return views.table(spark, d, "pages").where("url IS NOT NULL").select("page_id", tx.strip_comments(src).alias("stripped"))


@query(f"WITH {views.DOCUMENTS} SELECT id, search_blob || ' ' || search_blob AS blob, kind || ' ' || name || ' ' || name AS embed FROM symbols WHERE kind IS NOT NULL AND name IS NOT NULL")
def search_texts(spark, d):
    """What is searched and what is embedded of a symbol."""
    t = views.documents(spark, d).where("kind IS NOT NULL AND name IS NOT NULL")
    return t.select("id", tx.search_blob(F.col("name"), F.col("name")).alias("blob"), tx.embed_text(F.col("kind"), F.col("name"), F.col("name")).alias("embed"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'tie' WHEN (quality = 1) = (doc_id % 2 = 0) THEN 'A' ELSE 'B' END AS verdict FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def real_verdict(spark, d):
    """Verdicts on shown positions, turned back where the two were flipped."""
    t = views.table(spark, d, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    raw = F.when(F.col("toxic") == 1, "tie").when(F.col("quality") == 1, "A").otherwise("B")
    return t.select("doc_id", tx.real_verdict(raw, F.col("doc_id") % 2 != 0).alias("verdict"))


@query("SELECT c_custkey AS id, n, m FROM (SELECT c_custkey, c_name AS n, min(c_custkey) OVER (PARTITION BY c_name) AS m, count(*) OVER (PARTITION BY c_name) AS c FROM customer) WHERE c = 1")
def unique_customer_names(spark, d):
    """The rule for globally unique names where most are: customers by name."""
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.join(resolve.unique_names(c).withColumnRenamed("id", "m"), "name").select("id", F.col("name").alias("n"), "m")


@query("SELECT 'any' AS parameter, p_type AS kind, count(*) AS n FROM part GROUP BY p_type UNION ALL SELECT 'one', p_type, count(*) FROM part WHERE p_type = (SELECT min(p_type) FROM part) GROUP BY p_type")
def nullable_parameter(spark, d):
    """A filter whose parameter may be null: null lets everything through, a value that kind alone."""
    s = views.symbols(spark, d)
    s.createOrReplaceTempView("quillgraph_kinds")
    ask = lambda what, kind: spark.sql("SELECT kind, count(*) AS n FROM quillgraph_kinds WHERE :kind IS NULL OR kind = :kind GROUP BY kind", args={"kind": kind}).select(F.lit(what).alias("parameter"), "kind", "n")
    return ask("any", None).unionByName(ask("one", s.agg(F.min("kind")).first()[0]))
