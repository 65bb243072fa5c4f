"""The driver's tables seen as symbols, edges, files and judgements; each view once for Spark and once as SQL.

A part is a symbol, consecutive parts of an order are references from one to the next, and parts of one
brand and size are a file; references go to parts of equal or smaller size between files, so the file
graph has levels as well as cycles.  Every view covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ranking


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"))


SYMBOLS = "symbols AS (SELECT p_partkey AS id, p_type AS kind, p_name AS name, p_brand AS path, p_size AS start_line, p_size + 10 AS end_line FROM part)"


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """from_id, to_id, kind, confidence, and the order in which they come."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").select("*", F.lead("l_partkey").over(w).alias("v")).where("v IS NOT NULL AND v <> l_partkey")
    kind = F.when(F.col("l_returnflag") == "A", "Calls").when(F.col("l_returnflag") == "N", "Imports").otherwise("Extends")
    confidence = F.when(F.col("l_linestatus") == "F", 1.0).when(F.col("l_discount") < 0.05, 0.9).otherwise(0.7)
    return rows.select(F.col("l_partkey").alias("from_id"), F.col("v").alias("to_id"), kind.alias("kind"), confidence.alias("confidence"), "l_orderkey", "l_linenumber", "l_suppkey")


def edges(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("confidence")]
    return ranking.first_wins(attempts(spark, d), ["from_id", "to_id", "kind"], order).select("from_id", "to_id", "kind", "confidence")


ATTEMPTS = """pairs AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS v FROM lineitem),
attempts AS (SELECT l_partkey AS from_id, v AS to_id, CASE l_returnflag WHEN 'A' THEN 'Calls' WHEN 'N' THEN 'Imports' ELSE 'Extends' END AS kind,
  CAST(CASE WHEN l_linestatus = 'F' THEN 1.0 WHEN l_discount < 0.05 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence, l_orderkey, l_linenumber, l_suppkey FROM pairs WHERE v IS NOT NULL AND v <> l_partkey)"""
EDGES = f"""{ATTEMPTS},
edges AS (SELECT from_id, to_id, kind, confidence FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, kind ORDER BY l_orderkey, l_linenumber, l_suppkey, confidence) AS rn FROM attempts) WHERE rn = 1)"""


def file_of():
    return F.concat(F.regexp_replace("p_brand", "#", "/"), F.lit("/s"), F.col("p_size").cast("string"), F.lit(".ts"))


def file_edges(spark: SparkSession, d: str) -> DataFrame:
    """src, dst: distinct references between files, to equal or smaller sizes."""
    p = table(spark, d, "part").select("p_partkey", "p_size", file_of().alias("f"))
    e = edges(spark, d).select("from_id", "to_id")
    j = e.join(p.select(F.col("p_partkey").alias("from_id"), F.col("p_size").alias("a"), F.col("f").alias("src")), "from_id").join(p.select(F.col("p_partkey").alias("to_id"), F.col("p_size").alias("b"), F.col("f").alias("dst")), "to_id")
    return j.where("a >= b AND src <> dst").select("src", "dst").distinct()


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(file_of().alias("node")).distinct()


FILE = "replace(p_brand, '#', '/') || '/s' || CAST(p_size AS VARCHAR) || '.ts'"
FILE_EDGES = f"""{EDGES},
files AS (SELECT DISTINCT {FILE} AS node FROM part),
fe AS (SELECT DISTINCT replace(a.p_brand, '#', '/') || '/s' || CAST(a.p_size AS VARCHAR) || '.ts' AS src, replace(b.p_brand, '#', '/') || '/s' || CAST(b.p_size AS VARCHAR) || '.ts' AS dst
  FROM edges e JOIN part a ON a.p_partkey = e.from_id JOIN part b ON b.p_partkey = e.to_id
  WHERE a.p_size >= b.p_size AND (a.p_brand <> b.p_brand OR a.p_size <> b.p_size))"""
REACH = "reach(src, dst) AS (SELECT src, dst FROM fe UNION SELECT r.src, e.dst FROM reach r JOIN fe e ON r.dst = e.src)"
SCC = "scc AS (SELECT f.node, least(f.node, coalesce(min(r.dst), f.node)) AS scc FROM files f LEFT JOIN (SELECT a.src, a.dst FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src) r ON r.src = f.node GROUP BY f.node)"
LEVELS = """dag AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM fe JOIN scc a ON a.node = fe.src JOIN scc b ON b.node = fe.dst WHERE a.scc <> b.scc),
climb(node, level) AS (SELECT scc, 0 FROM scc UNION SELECT dag.src, climb.level + 1 FROM climb JOIN dag ON dag.dst = climb.node),
levels AS (SELECT scc.node, CAST(max(climb.level) AS INTEGER) AS level FROM scc JOIN climb ON climb.node = scc.scc GROUP BY scc.node)"""
METRICS = """blast AS (SELECT f.node, count(r.src) AS blast FROM files f LEFT JOIN reach r ON r.dst = f.node AND r.src <> r.dst GROUP BY f.node),
outs AS (SELECT src AS node, count(*) AS o FROM fe GROUP BY src), ins AS (SELECT dst AS node, count(*) AS i FROM fe GROUP BY dst),
m AS (SELECT f.node, regexp_extract(f.node, '^(.*)/[^/]*$', 1) AS module, l.level, b.blast, coalesce(o.o, 0) AS "out", coalesce(i.i, 0) AS in_,
  coalesce(x.cross_out, 0) AS cross_out, coalesce(x.upward, 0) AS upward
  FROM files f JOIN levels l USING (node) JOIN blast b USING (node) LEFT JOIN outs o USING (node) LEFT JOIN ins i USING (node)
  LEFT JOIN (SELECT fe.src AS node, count(*) FILTER (regexp_extract(fe.src, '^(.*)/[^/]*$', 1) <> regexp_extract(fe.dst, '^(.*)/[^/]*$', 1)) AS cross_out, count(*) FILTER (b.level > a.level) AS upward
    FROM fe JOIN levels a ON a.node = fe.src JOIN levels b ON b.node = fe.dst GROUP BY fe.src) x USING (node))"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as searchable symbols: the source is the name, the language the kind, the whole text the snippet."""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("source").alias("name"), F.concat_ws("/", "lang", "source").alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("text").alias("snippet"), tx.decompose(F.col("source")).alias("search_blob"))


DOCUMENTS = "symbols AS (SELECT doc_id AS id, lang AS kind, source AS name, concat_ws('/', lang, source) AS path, text AS snippet, trim(lower(regexp_replace(regexp_replace(source, '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS search_blob FROM documents)"


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Two judges of each labelled document: its quality label, and a grade from its length."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    grade = F.when(F.col("n_chars") < 200, 0).when(F.col("n_chars") < 1000, 1).when(F.col("n_chars") < 4000, 2).otherwise(3)
    return t.select("doc_id", "lang", "source", "quality", "toxic", "n_chars", grade.alias("grade"))


JUDGED = "judged AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, d.n_chars, CASE WHEN n_chars < 200 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 4000 THEN 2 ELSE 3 END AS grade FROM documents d JOIN labels l USING (doc_id))"
