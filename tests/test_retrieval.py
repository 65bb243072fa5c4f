import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import evaluate, ranking, retrieval


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    words = ["walk", "tree", "Tree_node", "parse", "énfasis", "x1", "foo", "bar", "the", "alpha", "beta"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    return [(i, r.choice(words), text(r.randrange(1, 30)), r.choice(["function_declaration", "class"]), text(5)) for i in range(1, 220)]


@pytest.mark.parametrize("question", ["walk", "Tree_node", "foo bar", "the", "enfasis alpha_beta", "the the x1 zzz"])
def test_bm25_like_sqlite(spark, corpus, question):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(name, snippet, kind, search_blob)")
    db.executemany("INSERT INTO f(rowid, name, snippet, kind, search_blob) VALUES (?, ?, ?, ?, ?)", corpus)
    match = " OR ".join(f'"{w}"' for w in question.split())
    want = {i: -s for i, s in db.execute("SELECT rowid, bm25(f, 10.0, 1.0, 1.0, 5.0) FROM f WHERE f MATCH ?", (match,))}
    s = spark.createDataFrame(corpus, "id long, name string, snippet string, kind string, search_blob string")
    q = spark.createDataFrame([("q", question)], "qid string, query string")
    got = {r["id"]: r["bm25_score"] for r in retrieval.bm25(s, q).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_fusion_and_fallback(spark):
    rows = [(i, f"n{i}", "tree walk" if i < 4 else "none", "f", "", [float(i), 1.0]) for i in range(1, 9)]
    s = spark.createDataFrame(rows, "id long, name string, snippet string, kind string, search_blob string, embedding array<float>").withColumns({"path": F.lit("p"), "start_line": F.lit(1), "end_line": F.lit(2)})
    q = spark.createDataFrame([("a", "tree", [1.0, 0.0]), ("b", "?!", [0.0, 1.0])], "qid string, query string, embedding array<float>")
    hits = retrieval.hybrid(s, q, k=3).orderBy("qid", "rank").collect()
    assert [h["qid"] for h in hits] == ["a"] * 3 + ["b"] * 3
    assert [h["id"] for h in hits if h["qid"] == "b"] == [1, 2, 3]  # no word to search: vectors alone
    assert max(h["rrf_score"] for h in hits) <= 1 / 61
    reranked = retrieval.hybrid(s, q, k=2, reranker=lambda _q, doc: F.length(doc).cast("double")).where("qid = 'a'").orderBy("rank").collect()
    assert reranked[0]["score"] >= reranked[1]["score"] and reranked[0]["rerank_score"] is not None
    blocks = retrieval.cosine_scores(s, q, block=1)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, retrieval.cosine_scores(s, q).collect()))


def test_ranking(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (2, "a", 3.0), (3, "b", 1.0)], "id long, k string, v double")
    assert [r["id"] for r in ranking.top_k(df, ["k"], [F.desc("v"), F.asc("id")], 1).orderBy("id").collect()] == [1, 3]
    assert {r["k"]: r["id"] for r in ranking.first_wins(df, ["k"], [F.col("id")]).collect()} == {"a": 1, "b": 3}
    assert [r["n"] for r in ranking.number_rows(df.drop("id"), ["k", "v"], "n").orderBy("n").collect()] == [1, 2, 3]
    assert ranking.number_rows(df.where("false"), ["k"], "n").count() == 0


def test_evaluation(spark):
    q = spark.createDataFrame([("q1", 1, "x", ["src/A.ts"], False), ("q2", 1, "y", ["zzz"], None), ("q3", 2, "n", [], True), ("q4", 2, "m", [], True)], "id string, axis int, query string, expected_paths array<string>, negative boolean")
    h = spark.createDataFrame([("q1", 1, "lib\\b.ts", "f", 0.01), ("q1", 2, "SRC\\a.ts", "g", 0.01), ("q2", 1, "p", "q", 0.01), ("q3", 1, "p", "q", 0.015)], "qid string, rank long, path string, name string, score double")
    got = {r["id"]: r["precision_at_5"] for r in evaluate.score_queries(q, h).collect()}
    assert got == {"q1": 0.5, "q2": 0.0, "q3": -0.25, "q4": 1.0}
    means = {r["axis"]: r["mean"] for r in evaluate.axis_means(evaluate.score_queries(q, h)).collect()}
    assert means == {1: 0.25, 2: 0.375, None: 0.3125}


def test_snippets(spark):
    h = spark.createDataFrame([("a\\b.ts:f",), ("zz:g",)], "hit string")
    s = spark.createDataFrame([(1, "a/b.ts", "f", "body")], "id long, path string, name string, snippet string")
    assert {r["hit"]: r["snippet"] for r in evaluate.attach_snippets(h, s).collect()} == {"a\\b.ts:f": "body", "zz:g": None}


def test_percentiles_and_latency(spark):
    v = spark.createDataFrame([(float(x),) for x in range(10)], "v double")
    assert tuple(evaluate.percentiles(v, "v").first()) == (1.0, 5.0, 9.0)
    assert tuple(evaluate.percentiles(v.where("false"), "v").first()) == (None, None, None)
    calls = spark.createDataFrame([(200, float(x)) for x in range(20)] + [(500, 99.0)], "status int, dt double")
    r = evaluate.latency_summary(calls).first()
    assert (r["n"], r["ok_count"], r["p50"], r["p95"]) == (21, 20, 10.0, 18.0)
