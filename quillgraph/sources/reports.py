"""Readers of query sets and text reports, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

#: The figures of a health report, and the words that it calls them by.
FIGURES = {
    "quality_signal": ["quality signal"],
    "modularity": ["modularity"],
    "acyclicity": ["acyclicity"],
    "depth": ["depth"],
    "equality": ["equality"],
    "redundancy": ["redundancy"],
    "max_depth": ["max depth"],
    "circular_dep_count": ["cycles", "circular dep"],
    "god_file_count": ["god files"],
}


def figure(names: list[str]) -> str:
    """A pattern for a number behind one of the names, whose words may be joined by an underscore."""
    return f"(?i)({'|'.join(n.replace(' ', '[ _]') for n in names)})[\\s:]+(-?\\d*\\.?\\d+)"


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set, one JSON array or one object a line; `negative` is false unless given."""
    return spark.read.schema(schema.EVAL_QUERIES).json(path, multiLine=True).fillna({"negative": False, "subject_unindexed": False})


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A structure matrix report as levels (node, level) and edges (src, dst) between files that it lists.

    Files stand as `level | path` below a heading `## Files`, up to the next heading; edges as `a -> b` anywhere.
    """
    lines = F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")
    rows = spark.read.text(path, wholetext=True).select(lines).withColumn("line", F.trim("line"))
    heads = rows.where(F.col("line").startswith("##") | F.lower("line").startswith("# files")).select("n", F.lower("line").rlike(r"^##? files").alias("files"))
    marks = heads.agg(F.sort_array(F.collect_list(F.struct("n", "files"))).alias("heads"))  # a report has a few headings
    inside = F.try_element_at(F.filter("heads", lambda h: h["n"] <= F.col("n")), F.lit(-1))["files"]
    listed = rows.crossJoin(F.broadcast(marks)).where(F.size(F.filter("heads", lambda h: h["n"] <= F.col("n"))) > 0).where(inside & ~F.col("line").startswith("#"))
    levels = listed.select(F.regexp_extract("line", r"^-*(\d+)\s*\|", 0).alias("lead"), F.regexp_extract("line", r"^(-?\d+)\s*\|\s*(.*)$", 1).alias("level"), F.regexp_extract("line", r"^(-?\d+)\s*\|\s*(.*)$", 2).alias("node")).where("level <> ''").select("node", F.col("level").cast("int").alias("level"))
    pairs = rows.where(F.size(F.split("line", "->")) == 2).select(F.regexp_extract("line", r"(\S+)\s*->", 1).alias("src"), F.regexp_extract("line", r"->\s*(\S+)", 1).alias("dst"))
    known = levels.select("node")
    edges = pairs.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return levels, edges.select("src", "dst")


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """A health report's figures, null where it does not give one."""
    return spark.read.text(path, wholetext=True).select(*health_figures(F.col("value")))


def health_figures(text: Column) -> list[Column]:
    """The figures that a report's text gives."""
    return [F.nullif(F.regexp_extract(text, figure(names), 2), F.lit("")).cast("double").alias(n) for n, names in FIGURES.items()]


def write_json(df: DataFrame, path: str, pretty_rows: bool = False) -> None:
    """Rows as JSON lines; `pretty_rows` writes one indented object per row instead."""
    if pretty_rows:
        df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)


def write_edges_tsv(edges: DataFrame, path: str) -> None:
    """The edge dump's five columns, separated by tabs."""
    edges.select("kind", "confidence", F.concat_ws(":", "from_path", "from_name").alias("from"), F.lit("->").alias("to"), F.concat_ws(":", "to_path", "to_name").alias("target")).write.mode("overwrite").csv(path, sep="\t")


def write_diagnostics(report: DataFrame, path: str, mirror: str | None = None) -> None:
    """The one-row diagnostics report as JSON, and a second copy if asked for."""
    for p in filter(None, (path, mirror)):
        report.coalesce(1).write.mode("overwrite").json(p)


def dump_columns(df: DataFrame, wanted: list[str], path: str) -> None:
    """The wanted columns that exist, as JSON lines."""
    df.select(*[c for c in wanted if c in df.columns]).write.mode("overwrite").json(path)
