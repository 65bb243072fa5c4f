import itertools
import math
import random

import pytest

from quillgraph.operators import archmetrics as am
from quillgraph.operators import graph


def edges(spark, pairs, kind="long"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


def nodes(spark, names, kind="long"):
    return spark.createDataFrame([(n,) for n in names], f"node {kind}")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def reach(pairs):
    out = {}
    succ = {}
    for a, b in pairs:
        succ.setdefault(a, set()).add(b)
    for s in {x for p in pairs for x in p}:
        seen, todo = set(), [s]
        while todo:
            for v in succ.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        out[s] = seen
    return out


@pytest.mark.parametrize("mode", ["task", "joins"])
def test_ppr(spark, mode):
    e = edges(spark, [(1, 2), (2, 3), (3, 2), (4, 5)])
    got = as_dict(graph.ppr(e, nodes(spark, [1]), rounds=30, mode=mode))
    assert {k: round(v, 6) for k, v in got.items()} == {1: 0.15, 2: 0.455953, 3: 0.394047, 4: 0.0, 5: 0.0}
    assert as_dict(graph.ppr(e, nodes(spark, []), mode=mode, rounds=2)) == {}
    assert as_dict(graph.ppr(edges(spark, []), nodes(spark, [99]), mode=mode, rounds=3)) == {99: 1.0}
    got = as_dict(graph.ppr(edges(spark, [(1, 4)]), nodes(spark, [1]), rounds=2, mode=mode))
    assert {k: round(v, 6) for k, v in got.items()} == {1: 0.8725, 4: 0.1275}


def test_ppr_counts_repeated_edges(spark):
    twice = edges(spark, [(1, 2), (1, 2), (1, 3)])
    got = as_dict(graph.ppr(twice, nodes(spark, [1]), rounds=1, mode="task"))
    assert math.isclose(got[2], 2 * got[3])
    assert as_dict(graph.ppr(twice, nodes(spark, [1]), rounds=1, mode="joins")) == pytest.approx(got)


@pytest.mark.parametrize("mode", ["task", "joins"])
@pytest.mark.parametrize(("pairs", "want"), [([("a", "b"), ("b", "c")], {"c": 0, "b": 1, "a": 2}), ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], {"d": 0, "b": 1, "c": 1, "a": 2}), ([], {})])
def test_levels(spark, mode, pairs, want):
    assert as_dict(graph.levels(edges(spark, pairs, "string"), mode=mode)) == want


@pytest.mark.parametrize(("pairs", "want"), [([("a", "b"), ("b", "c")], {"c": 2, "b": 1, "a": 0}), ([("a", "x"), ("b", "x"), ("c", "x")], {"x": 3, "a": 0, "b": 0, "c": 0}), ([], {})])
def test_blast(spark, pairs, want):
    e = edges(spark, pairs, "string")
    assert as_dict(graph.blast_radius(e, mode="task")) == want
    assert as_dict(graph.blast_radius(e, mode="joins")) == want
    assert as_dict(graph.blast_radius_sampled(e)) == want


def test_blast_sampled_keeps_the_top_node(spark):
    e = edges(spark, [(i, 100) for i in range(20)])
    got = as_dict(graph.blast_radius_sampled(e, most=5))
    assert got[100] == 20 and len(got) == 21


def test_attack_surface(spark):
    e = edges(spark, [("main", "lib"), ("lib", "util"), ("orphan", "stub")], "string")
    assert tuple(graph.attack_surface(e, nodes(spark, ["main", "gone"], "string")).first()) == (3, 5)
    assert tuple(graph.attack_surface(e, nodes(spark, [], "string")).first()) == (0, 5)
    assert tuple(graph.attack_surface(edges(spark, [], "string"), nodes(spark, ["main"], "string")).first()) == (0, 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = sorted({(r.randrange(12), r.randrange(12)) for _ in range(18)})
    to = reach(pairs)
    every = {x for p in pairs for x in p}
    want = {a: min([a, *[b for b in to[a] if a in to[b]]]) for a in every}
    e = edges(spark, pairs)
    shuffled = edges(spark, r.sample(pairs, len(pairs)))
    for mode in ("task", "joins"):
        comp = graph.scc(shuffled, mode=mode)
        assert as_dict(comp) == want
        level = as_dict(graph.levels(e, comp, mode=mode))
        assert all(level[a] == level[b] if want[a] == want[b] else level[a] > level[b] for a, b in pairs)
        assert as_dict(graph.blast_radius(e, mode=mode)) == {x: sum(1 for y in every if y != x and x in to[y]) for x in every}
    assert {(x["src"], x["dst"]) for x in graph.closure(e).collect()} == {(a, b) for a in to for b in to[a]}
    p = as_dict(graph.ppr(e, nodes(spark, [pairs[0][0]]), rounds=10, mode="task"))
    assert math.isclose(sum(p.values()), 1, abs_tol=1e-9)


def test_upward_violations(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c")], "string")
    comp = graph.scc(e)
    got = [tuple(r) for r in graph.upward_violations(e, graph.levels(e, comp), comp).collect()]
    assert got == [("a", 1, "b", 1), ("b", 1, "a", 1)]
    chain = edges(spark, [("a", "b"), ("b", "c")], "string")
    comp = graph.scc(chain)
    assert graph.upward_violations(chain, graph.levels(chain, comp), comp).isEmpty()


def test_bfs_branching_and_terminals(spark):
    e = spark.createDataFrame([(1, d, "Calls") for d in range(2, 9)] + [(2, 20, "Calls"), (1, 30, "Extends"), (30, 31, "Calls")], "src long, dst long, kind string")
    got = as_dict(graph.bfs(e, nodes(spark, [1]), depth=2, terminal=["Extends"]))
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 30: 1, 20: 2}


def test_metrics(spark):
    e = edges(spark, [("m/a", "m/b"), ("m/a", "n/c"), ("n/c", "n/d"), ("m/b", "n/d")], "string")
    every = graph.nodes_of(e)
    assert round(am.newman_q(e).first()["q"], 6) == round(1 / 4 - 3 * 1 / 16 + 1 / 4 - 1 * 3 / 16, 6)
    d = am.degrees(e, every)
    assert as_dict(d.select("node", "out")) == {"m/a": 2, "m/b": 1, "n/c": 1, "n/d": 0}
    assert round(am.gini(d, "out").first()["gini"], 6) == round(2 * (0 + 2 + 3 + 8) / (4 * 4) - 5 / 4, 6)
    assert am.upper_median(d, "out").first()["median"] == 1
    assert am.gini(d.where("false"), "out").first()["gini"] == 0.0
    assert am.newman_q(edges(spark, [], "string")).first()["q"] == 0.0
    report = am.diagnostics(e, every, "p").first()
    assert report["file_count"] == 4 and report["aggregates"]["max_depth"] == 1 and report["aggregates"]["cycles"] == 0
    assert report["modularity_culprits"][0]["node"] == "m/a"


def test_list_callers_uses_the_direct_edge(spark):
    s = spark.createDataFrame([(1, "f", "target", "p1"), (2, "f", "one", "p2"), (3, "f", "two", "p3")], "id long, kind string, name string, path string")
    e = spark.createDataFrame([(2, 1, "Calls", 0.9), (3, 2, "Calls", 1.0)], "from_id long, to_id long, kind string, confidence double")
    got = {r["name"]: r["confidence"] for r in graph.list_callers(s, e, "target").collect()}
    assert got == {"one": 0.9, "two": 0.0}
    assert list(itertools.chain(*graph.list_callers(s, e, "nobody").collect())) == []
