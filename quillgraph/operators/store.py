"""Tables on disk as snapshots: parts written once, then named by a pointer; looked up by plain filters.

A store is a folder with one sub-folder per write and a pointer table whose last row names the live
parts of every table.  A snapshot that replaces a table writes it anew; one that adds rows writes
these alone, and rows are taken away by listing their ids in `gone`, which readers leave out, so a
small batch costs what it holds and not the store.  When a table has more than ``MOST_PARTS`` parts
the store is written together.  An index run that embeds nothing leaves the live snapshot as it is, and readers
never see half of one.

With the symbols goes their full-text index, `postings` sorted by term and `lengths`: a search reads
the row groups of its own terms.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from . import ranking, retrieval

INDEX = {
    "postings": T.StructType([T.StructField("term", T.StringType()), T.StructField("id", T.LongType()), T.StructField("col", T.StringType()), T.StructField("pos", T.IntegerType())]),
    "lengths": T.StructType([T.StructField("id", T.LongType()), T.StructField("dl", T.LongType())]),
}
TABLES = {"symbols": schema.SYMBOLS, "edges": schema.EDGES, "alias_decls": schema.ALIASES}
GONE = T.StructType([T.StructField("id", T.LongType())])
SHAPES = TABLES | INDEX | {"gone": GONE}
#: Columns that hold a symbol's id.
IDS = {"symbols": ["id"], "postings": ["id"], "lengths": ["id"], "edges": ["from_id", "to_id"]}
MOST_PARTS = 16
POINTER = "seq long, name string, parts map<string, array<string>>"


class Store:
    """symbols, edges and alias_decls of the live snapshot below `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _pointer(self) -> tuple[int, str | None, dict[str, list[str]]]:
        if self._exists(f"{self.path}/live"):
            row = self.spark.read.schema(POINTER).json(f"{self.path}/live").orderBy(F.desc("seq")).first()
            if row:
                return row["seq"], row["name"], dict(row["parts"])
        return 0, None, {}

    def live(self) -> str | None:
        """The live snapshot's name."""
        return self._pointer()[1]

    def _read(self, name: str, parts: dict[str, list[str]]) -> DataFrame:
        out = None
        for folder in parts.get(name, []):
            part = self.spark.read.schema(SHAPES[name]).parquet(f"{self.path}/{folder}").select(*SHAPES[name].names)
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], SHAPES[name])
        if parts.get("gone") and name in IDS:
            gone = self._read("gone", parts)
            for c in IDS[name]:
                out = out.join(gone.select(F.col("id").alias(c)), c, "left_anti")
        return out.select(*SHAPES[name].names)

    def table(self, name: str) -> DataFrame:
        """A live table; empty with its schema before the first snapshot."""
        return self._read(name, self._pointer()[2])

    def index(self) -> retrieval.Index:
        """The live symbols' full-text index."""
        parts = self._pointer()[2]
        return retrieval.Index(self._read("postings", parts), self._read("lengths", parts))

    def _put(self, snap: str, name: str, df: DataFrame) -> str:
        """Write a part: edges by kind, postings by range of their terms.  A frequent term is cut between ids."""
        want = SHAPES[name]
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in want.fields])
        if name == "postings":
            df = df.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
        out = df.write.mode("append")
        (out.partitionBy("kind") if name == "edges" else out).parquet(f"{self.path}/{snap}/{name}")
        return f"{snap}/{name}"

    def _swap(self, replace: dict[str, DataFrame], add: dict[str, DataFrame]) -> str:
        seq, _, parts = self._pointer()
        old, snap = dict(parts), f"snapshot-{uuid.uuid4().hex}"
        if "symbols" in replace and old.get("gone"):  # their ids are written for the last time here, so who names them is too
            replace = {"edges": self._read("edges", old)} | replace
            parts.pop("gone")
        for name, df in (replace | add).items():
            part = self._put(snap, name, df)
            parts[name] = [part] if name in replace else [*parts.get(name, []), part]
            if name == "symbols":
                written = self.spark.read.schema(SHAPES[name]).parquet(f"{self.path}/{part}")
                for n, rows in (("postings", retrieval.postings(written)), ("lengths", retrieval.lengths(written))):
                    p = self._put(snap, n, rows)
                    parts[n] = [p] if name in replace else [*parts.get(n, []), p]
        self.spark.createDataFrame([(seq + 1, snap, parts)], POINTER).coalesce(1).write.mode("append").json(f"{self.path}/live")
        if max(map(len, parts.values()), default=0) > MOST_PARTS:
            return self.write(**{n: self.table(n) for n in TABLES})
        return snap

    def write(self, **tables: DataFrame) -> str:
        """A snapshot with the given tables in place of the old ones; the others stay as they are."""
        return self._swap({n: tables[n] for n in TABLES if n in tables}, {})

    def add(self, **tables: DataFrame) -> str:
        """A snapshot with more rows, or with ids that are `gone`."""
        return self._swap({}, {n: tables[n] for n in SHAPES if n in tables})

    def replace_paths(self, paths: DataFrame, symbols: DataFrame) -> str:
        """Symbols in place of all of these paths, under ids of their own; edges of those that went go with them."""
        gone = self.table("symbols").join(paths.select("path").distinct(), "path", "left_semi").select("id")
        return self.add(symbols=symbols, gone=gone)

    def top_id(self) -> int:
        """The largest id ever given in the live parts, those of rows that are gone included."""
        parts = self._pointer()[2]
        ids = self._read("gone", parts).unionByName(self._read("symbols", parts | {"gone": []}).select("id"))
        return ids.agg(F.max("id")).first()[0] or 0

    def note_version(self, version: str) -> None:
        """Record which embedding the live vectors come from; the last note counts."""
        seen = self.version()
        seq = (seen[0] if seen else 0) + 1
        self.spark.createDataFrame([(seq, version)], "seq long, version string").coalesce(1).write.mode("append").json(f"{self.path}/version")

    def version(self) -> tuple[int, str] | None:
        if not self._exists(f"{self.path}/version"):
            return None
        row = self.spark.read.schema("seq long, version string").json(f"{self.path}/version").orderBy(F.desc("seq")).first()
        return row and (row["seq"], row["version"])

    def replace_unless_empty(self, symbols: DataFrame, edges: DataFrame, aliases: DataFrame) -> bool:
        """A new snapshot, unless there is no symbol to store; whether it was made."""
        if symbols.isEmpty():
            return False
        self.write(symbols=symbols, edges=edges, alias_decls=aliases)
        return True

    def append(self, symbols: DataFrame) -> str:
        return self.add(symbols=symbols)

    def add_edges(self, edges: DataFrame) -> str:
        """Insert or ignore on (from, to, kind): what is stored stays."""
        keys = ["from_id", "to_id", "kind"]
        return self.add(edges=ranking.first_wins(edges, keys, [-F.col("confidence")]).join(self.table("edges").select(*keys), keys, "left_anti"))

    def add_aliases(self, aliases: DataFrame) -> str:
        """Insert or ignore on (file, alias)."""
        keys = ["file", "alias"]
        return self.add(alias_decls=ranking.first_wins(aliases, keys, [F.col("target_file")]).join(self.table("alias_decls").select(*keys), keys, "left_anti"))

    def clear(self, *names: str) -> str:
        """Empty tables (all by default) in a new snapshot."""
        return self.write(**{n: self.spark.createDataFrame([], TABLES[n]) for n in names or TABLES})


def by_id(symbols: DataFrame, id_: int) -> DataFrame:
    return symbols.where(F.col("id") == id_)


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def files(symbols: DataFrame) -> DataFrame:
    return symbols.select("path").distinct()


def in_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).orderBy("start_line", "id")


def all_embeddings(symbols: DataFrame) -> DataFrame:
    return symbols.select("id", "embedding")


def aliases_of(aliases: DataFrame, file: str) -> DataFrame:
    return aliases.where(F.col("file") == file).orderBy("alias")


def dump_edges(edges: DataFrame, symbols: DataFrame, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Edges with the kinds, names and paths of both ends, ordered; all kinds if none is given."""
    s = symbols.select("id", "name", "path")
    e = edges if kind is None else edges.where(F.col("kind") == kind)
    e = e.join(s.select(F.col("id").alias("from_id"), F.col("name").alias("from_name"), F.col("path").alias("from_path")), "from_id")
    e = e.join(s.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"), F.col("path").alias("to_path")), "to_id")
    rows = e.select("from_id", "to_id", "kind", "confidence", "from_name", "from_path", "to_name", "to_path")
    return rows if limit is None else rows.orderBy("from_id", "to_id", "kind").limit(limit)


def count_by_kind(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind")


def count_by_kind_and_confidence(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind", F.round("confidence", 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", F.desc("bucket"))


def has_imports(edges: DataFrame) -> bool:
    return not edges.where("kind = 'Imports'").limit(1).isEmpty()


def needs_reindex(edges: DataFrame, aliases: DataFrame) -> bool:
    """Import edges without any alias declaration come from an older index."""
    return has_imports(edges) and aliases.limit(1).isEmpty()
