"""Command line: index, query, build and dump edges, walk the graph, evaluate, compare embedders."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine, parse_kinds
from .functions import vector as vx
from .operators import evaluate, store
from .sources import reports


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillgraph")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="do", required=True)
    s = sub.add_parser("index")
    s.add_argument("repo")
    s.add_argument("--max-consecutive-fail", type=int, default=5)
    s = sub.add_parser("build-graph")
    s.add_argument("repo")
    s = sub.add_parser("embed-snapshot")
    s.add_argument("queries")
    s.add_argument("--out", required=True)
    s = sub.add_parser("embed-equivalence")
    s.add_argument("queries")
    s.add_argument("--snapshot", required=True)
    s.add_argument("--out")
    s = sub.add_parser("query")
    s.add_argument("text")
    s.add_argument("--top", type=int, default=5)
    s.add_argument("--alpha", type=float, default=0.6)
    s = sub.add_parser("eval")
    s.add_argument("queries")
    s.add_argument("--alpha", type=float, default=0.6)
    s.add_argument("--out")
    s = sub.add_parser("dump-edges")
    s.add_argument("--kind")
    s.add_argument("--limit", type=int, default=50)
    s = sub.add_parser("query-graph")
    s.add_argument("text", nargs="?")
    s.add_argument("--subject")
    s.add_argument("--kinds", default="Calls,Imports,Implements,Extends")
    s.add_argument("--conf-min", type=float, default=0.5)
    s.add_argument("--damping", type=float, default=0.85)
    s.add_argument("--rounds", type=int, default=30)
    s.add_argument("--directed", action="store_true")
    s.add_argument("--top", type=int, default=5)
    s = sub.add_parser("list-callers")
    s.add_argument("name")
    s.add_argument("--top", type=int, default=5)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quillgraph").getOrCreate()
    engine = Engine(spark, a.store)
    show = lambda df: print("\n".join(r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect()))  # noqa: E731  a report's few rows
    if a.do == "index" and engine.needs_reindex():
        print("the store has import edges but no alias declarations, as an older index leaves it; index into a fresh store", file=sys.stderr)
        return 2
    if a.do == "index":
        print(json.dumps(engine.index_repo(a.repo, a.max_consecutive_fail)))
    elif a.do == "build-graph":
        show(engine.build_graph(a.repo).orderBy("kind"))
        show(store.count_by_kind(engine.edges))
    elif a.do == "embed-snapshot":
        reports.write_json(engine.embed_snapshot(reports.read_queries(spark, a.queries)), a.out)
    elif a.do == "embed-equivalence":
        before = spark.read.schema("id string, role string, embedding array<float>").json(a.snapshot)
        gate = evaluate.equivalence_gate(before, engine.embed_snapshot(reports.read_queries(spark, a.queries)), vx.cosine)
        gate = gate.select("mean", "p10", "p50", "p90", "n", "missing", "passes").persist()
        if a.out:
            reports.write_json(gate, a.out)
        show(gate)
        return 0 if gate.first()["passes"] else 1
    elif a.do == "query":
        show(engine.query(a.text, a.top, a.alpha))
    elif a.do == "eval":
        q = reports.read_queries(spark, a.queries)
        hits = engine.query_many([(r["id"], r["query"]) for r in q.select("id", "query").collect()], 5, a.alpha)
        scored = evaluate.score_queries(q, hits)
        if a.out:
            reports.write_json(scored, a.out)
        show(evaluate.axis_means(scored).orderBy(F.col("axis").asc_nulls_last()))
    elif a.do == "dump-edges":
        show(store.dump_edges(engine.edges, engine.symbols, a.kind, a.limit))
    elif a.do == "query-graph":
        parse_kinds(a.kinds)
        show(engine.query_graph(a.text, a.subject, a.kinds, a.top, least=a.conf_min, damping=a.damping, rounds=a.rounds, undirected=not a.directed))
    else:
        show(engine.list_callers(a.name, a.top))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
