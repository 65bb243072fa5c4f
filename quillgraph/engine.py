"""The engine's operations: index a source tree, ask in words, look up, list callers, walk the graph."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import vector as vx
from .operators import graph, ranking, resolve, retrieval, store
from .sources import scan, walk

QUERY_PREFIX = ""
#: How often an embedder that failed is asked.
INDEX_ATTEMPTS, QUERY_ATTEMPTS = 5, 2
#: Names that other callers use for the operations' arguments.
ALIASES = {"repo_path": "repo", "q": "text", "k": "top", "symbol_id": "id"}


class VersionMismatch(RuntimeError):
    """The stored vectors come from another model, dimension or query prefix; the tree must be indexed anew."""


class IndexFailed(RuntimeError):
    """Too many symbols could not be embedded; what was stored before stays."""


@dataclass
class Task:
    """An operation's envelope: what was asked, how far it came, what came out."""

    operation: str
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    state: str = "submitted"
    created: float = field(default_factory=time.time)
    updated: float = field(default_factory=time.time)
    result: object = None
    error: str | None = None

    def move(self, state: str, **more) -> None:
        self.state, self.updated = state, time.time()
        for k, v in more.items():
            setattr(self, k, v)


class Engine:
    """Operations over one store.

    `embed` turns a text column into vectors (null where it failed); the default hashes words and
    needs no model.  `embed_one`, a function of one text that may fail, is retried instead: five
    attempts for what is indexed, two for questions.  Model name, dimension and query prefix make the
    version that queries must share with the index.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] | None = None, model: str = "hashing", dim: int = 256, query_prefix: str = QUERY_PREFIX, embed_one: Callable[[str], list[float]] | None = None):
        self.spark, self.store = spark, store.Store(spark, path)
        self.embed = vx.guarded(embed_one, INDEX_ATTEMPTS) if embed_one else embed or vx.hashing_embedder(dim)
        self.embed_question = vx.guarded(embed_one, QUERY_ATTEMPTS) if embed_one else self.embed
        self.model, self.dim, self.query_prefix = model, dim, query_prefix
        self.tasks: dict[str, Task] = {}

    # tables
    @property
    def symbols(self) -> DataFrame:
        return self.store.table("symbols")

    @property
    def edges(self) -> DataFrame:
        return self.store.table("edges")

    @property
    def aliases(self) -> DataFrame:
        return self.store.table("alias_decls")

    def version(self) -> str:
        row = self.spark.range(1).select(tx.version_hash(F.lit(self.model), F.lit(self.dim), F.lit(self.query_prefix)).alias("v")).first()
        return row["v"]

    # operations
    def index_repo(self, repo: str, max_consecutive_fail: int = 5, use_aliases: bool = False) -> dict:
        """Read, extract, embed, resolve and store a tree; nothing is replaced if it holds no symbol.

        Rows are embedded in parallel, so failures have no order: the run is given up when none could
        be embedded or as many in a hundred failed as `max_consecutive_fail` says.
        """
        if not 1 <= max_consecutive_fail <= 100:
            raise ValueError("max_consecutive_fail must be from 1 to 100")
        files = walk.read_tree(self.spark, repo).withColumn("lang", walk.language_of(F.col("path"))).where("lang IS NOT NULL")
        found = graph.cut(scan.extract(files))
        rows = ranking.number_rows(scan.symbols_of(found), ["path", "byte", "name"])
        rows = rows.withColumn("search_blob", tx.search_blob(F.col("name"), F.col("snippet")))
        rows = graph.cut(rows.withColumn("embedding", self.embed(tx.embed_text(F.col("kind"), F.col("name"), F.col("snippet")))))
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedding").isNull()).alias("bad")).first()
        if n["n"] == 0:
            return {"symbols_indexed": 0, "edges_built": 0}
        if n["bad"] == n["n"] or 100 * n["bad"] > max_consecutive_fail * n["n"]:
            raise IndexFailed(f"{n['bad']} of {n['n']} symbols could not be embedded")
        rows = rows.where("embedding IS NOT NULL")
        scripts = scan.captures_of(found).join(files.where("lang = 'typescript'").select("path").distinct(), "path", "left_semi")
        edges, aliases, attempts = resolve.build_edges(rows, scripts, use_aliases)
        self.store.replace_unless_empty(rows, edges, aliases)
        self.store.note_version(self.version())
        built = resolve.edge_stats(attempts).agg(F.coalesce(F.sum("resolved"), F.lit(0)).alias("n")).first()["n"]
        return {"symbols_indexed": n["n"] - n["bad"], "edges_built": built}

    def build_graph(self, repo: str, use_aliases: bool = False) -> DataFrame:
        """Edges and alias declarations of a tree made anew for the symbols that are stored: kind, resolved, unresolved."""
        files = walk.read_tree(self.spark, repo).withColumn("lang", walk.language_of(F.col("path"))).where("lang = 'typescript'")
        captures = graph.cut(scan.captures_of(scan.extract(files)))
        edges, aliases, attempts = resolve.build_edges(self.symbols, captures, use_aliases)
        attempts = graph.cut(attempts)
        self.store.write(edges=edges, alias_decls=aliases)
        return resolve.edge_stats(attempts)

    def embed_snapshot(self, queries: DataFrame) -> DataFrame:
        """id, role, embedding of every question (id, query), embedded as a question and as a passage."""
        asked = queries.select("id", F.lit("Query").alias("role"), self.embed_question(F.concat(F.lit(self.query_prefix), F.col("query"))).alias("embedding"))
        return asked.unionByName(queries.select("id", F.lit("Passage").alias("role"), self.embed(F.col("query")).alias("embedding")))

    def query(self, text: str, top: int = 5, alpha: float = retrieval.ALPHA, rerank: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """The symbols that fit a question best."""
        return self.query_many([("q", text)], top, alpha, rerank).drop("qid")

    def query_many(self, questions: list[tuple[str, str]], top: int = 5, alpha: float = retrieval.ALPHA, rerank=None) -> DataFrame:
        """Many questions in one plan: qid, rank and the hit."""
        stored = self.store.version()
        if stored and stored[1] != self.version():
            raise VersionMismatch(f"indexed with {stored[1]}, asked with {self.version()}")
        q = self.spark.createDataFrame(questions, "qid string, query string")
        q = q.withColumn("embedding", self.embed_question(F.concat(F.lit(self.query_prefix), F.col("query"))))
        return retrieval.hit_view(retrieval.hybrid(self.symbols, q, top, alpha, rerank, index=self.store.index()))

    def get_symbol(self, id: int) -> DataFrame:  # noqa: A002  the operation's own argument name
        return store.by_id(self.symbols, id).drop("embedding", "search_blob")

    def list_callers(self, name: str, top: int = 5) -> DataFrame:
        return graph.list_callers(self.symbols, self.edges, name, top)

    def query_graph(self, text: str | None = None, subject: str | None = None, kinds: str = "Calls,Imports,Implements,Extends", top: int = 5, **options) -> DataFrame:
        """The symbols around a subject, given or taken from a question."""
        if subject is None:
            subject = self.spark.createDataFrame([(text,)], "t string").select(tx.extract_subject(F.col("t")).alias("s")).first()["s"]
        return graph.query_graph(self.symbols, self.edges, subject, parse_kinds(kinds), top=top, **options)

    def children(self, id: int) -> DataFrame:  # noqa: A002
        """Symbols inside another one's lines, in its file."""
        one = self.get_symbol(id).select(F.col("id").alias("p"), "path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
        return self.symbols.drop("embedding", "search_blob").join(one, "path").where("id <> p AND start_line >= s AND end_line <= e").drop("p", "s", "e")

    def needs_reindex(self) -> bool:
        return store.needs_reindex(self.edges, self.aliases)

    def run(self, operation: str, **arguments) -> Task:
        """An operation by name, with its arguments under any of their names, as a finished task."""
        calls = {"index_repo": self.index_repo, "query": self.query, "get_symbol": self.get_symbol, "list_callers": self.list_callers, "query_graph": self.query_graph}
        task = Task(operation)
        self.tasks[task.id] = task
        task.move("working")
        try:
            if operation not in calls:
                raise ValueError(f"unknown operation {operation!r}")
            got = calls[operation](**{ALIASES.get(k, k): v for k, v in arguments.items()})
            task.move("completed", result=[r.asDict(True) for r in got.collect()] if isinstance(got, DataFrame) else got)
        except Exception as e:  # the envelope is where the caller reads it
            task.move("failed", error=f"{type(e).__name__}: {e}"[:500])
        return task


def parse_kinds(kinds: str) -> list[str]:
    """A comma list of edge kinds; unknown ones are warned of and left out."""
    import warnings

    from .schema import EDGE_KINDS

    out = []
    for k in (x.strip() for x in kinds.split(",")):
        if k in EDGE_KINDS:
            out.append(k)
        elif k:
            warnings.warn(f"unknown edge kind {k!r}", stacklevel=2)
    return out
