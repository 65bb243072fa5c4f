import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgraph.engine import Engine, IndexFailed, VersionMismatch, parse_kinds
from quillgraph.functions import text as tx
from quillgraph.streaming import incremental


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "repo"
    d.mkdir()
    (d / "a.ts").write_text('import { foo } from "./b"\nexport function caller() { foo(); }\nexport class Walker { walk() { caller(); } }\n')
    (d / "b.ts").write_text("export function foo() {}\n")
    (d / "c.py").write_text("def parse_tree(x):\n    return x\n")
    return d


def test_operations(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.index_repo(str(tree)) == {"symbols_indexed": 5, "edges_built": 3}
    assert e.query("parse tree", 1).first()["name"] == "parse_tree"
    assert [r["name"] for r in e.list_callers("foo").collect()][:2] == ["caller", "Walker"]
    assert e.run("query_graph", text="who uses caller_x or caller").state == "completed"
    walker = e.symbols.where("name = 'Walker'").first()["id"]
    assert [r["name"] for r in e.children(walker).collect()] == ["walk"]
    assert e.run("get_symbol", symbol_id=walker).result[0]["name"] == "Walker"
    assert e.run("nothing").state == "failed"
    (tmp_path / "none").mkdir()
    assert e.index_repo(str(tmp_path / "none"))["symbols_indexed"] == 0
    assert e.symbols.count() == 5  # an empty tree replaces nothing
    with pytest.raises(ValueError, match="from 1 to 100"):
        e.index_repo(str(tree), max_consecutive_fail=0)
    broken = Engine(spark, str(tmp_path / "store"), embed=lambda c: F.lit(None).cast("array<float>"))
    with pytest.raises(IndexFailed):
        broken.index_repo(str(tree))
    assert e.symbols.count() == 5
    with pytest.raises(VersionMismatch):
        Engine(spark, str(tmp_path / "store"), dim=64).query("x")
    with pytest.warns(UserWarning, match="unknown edge kind"):
        assert parse_kinds("Calls, Nope") == ["Calls"]


def test_commands(spark, tree, tmp_path, capsys):
    """build-graph, the embedders' comparison and the guard against an older index; an embedder that fails is asked again."""
    import json

    from quillgraph import __main__ as cli
    from quillgraph.functions import vector as vx

    at = str(tmp_path / "store")
    assert cli.main(["--store", at, "index", str(tree)]) == 0
    assert cli.main(["--store", at, "build-graph", str(tree)]) == 0
    said = capsys.readouterr().out
    assert '{"kind":"Imports","resolved":1,"unresolved":0}' in said and '{"kind":"Calls","n":2}' in said
    (tmp_path / "q.json").write_text(json.dumps([{"id": "a", "axis": 1, "query": "parse tree", "expected_paths": ["c.py"]}]))
    q = str(tmp_path / "q.json")
    assert cli.main(["--store", at, "embed-snapshot", q, "--out", str(tmp_path / "snap")]) == 0
    assert cli.main(["--store", at, "embed-equivalence", q, "--snapshot", str(tmp_path / "snap")]) == 0
    other = spark.read.json(str(tmp_path / "snap")).withColumn("embedding", F.transform("embedding", lambda x: -x))
    other.write.json(str(tmp_path / "other"))
    assert cli.main(["--store", at, "embed-equivalence", q, "--snapshot", str(tmp_path / "other")]) == 1
    e = Engine(spark, at)
    e.store.clear("alias_decls")
    assert cli.main(["--store", at, "index", str(tree)]) == 2 and "fresh store" in capsys.readouterr().err
    steady = lambda text: [1.0, float(len(text))]
    waits = []
    flaky = vx.guarded(vx.InjectedFault(steady, "once"), 2, sleep=waits.append)
    assert spark.createDataFrame([("abc",)], "t string").select(flaky(F.col("t"))).first()[0] == [1.0, 3.0]
    one = Engine(spark, str(tmp_path / "one"), embed_one=steady, model="steady", dim=2)
    assert one.index_repo(str(tree))["symbols_indexed"] == 5 and one.query("parse_tree", 1).first()["name"] == "parse_tree"


def test_version_changes_with_its_parts(spark):
    v = spark.range(1).select(*[tx.version_hash(F.lit(m), F.lit(d), F.lit(p)).alias(n) for n, m, d, p in (("a", "m", 64, "p"), ("b", "m", 65, "p"), ("c", "n", 64, "p"), ("d", "m", 64, "q"))]).first()
    assert len(set(v)) == 4 and len(v["a"]) == 12


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([(1, "2024-01-01 00:00:01", 1, "click", 2.0), (2, "2024-01-01 00:00:02", 1, "click", 3.0), (2, "2024-01-01 00:00:02", 1, "click", 3.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(src / "events1.parquet"))
    schema = spark.read.parquet(str(src / "events1.parquet")).schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
    q = incremental.event_counts(incremental.once(rows, ["event_id", "ts"]), late=None).writeStream.format("memory").queryName("counts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").columns == ["start", "event_type", "n", "value"]


def test_upsert_by_path(spark, tmp_path):
    from quillgraph.operators import store

    st = store.Store(spark, str(tmp_path / "st"))
    finish = lambda df: df.withColumn("search_blob", F.lit("")).withColumn("embedding", F.array().cast("array<float>"))
    sink = incremental.upsert_by_path(st, finish)
    for text in ("def a(): pass\ndef b(): pass\n", "def c(): pass\n"):
        files = spark.createDataFrame([("x.py", text)], "path string, content string")
        sink(incremental.symbol_stream(files), 0)
    assert [(r["id"], r["name"]) for r in st.table("symbols").collect()] == [(3, "c")]
    st.add_edges(spark.createDataFrame([(3, 3, "Calls", 1.0)], "from_id long, to_id long, kind string, confidence double"))
    sink(incremental.symbol_stream(spark.createDataFrame([("x.py", "def e(): pass\n"), ("y.py", "def d(): pass\n")], "path string, content string")), 1)
    assert sorted((r["id"], r["name"]) for r in st.table("symbols").collect()) == [(4, "e"), (5, "d")] and st.table("edges").count() == 0


def test_stored_index(spark, tmp_path, monkeypatch):
    """A search over the stored index equals one over the rows, reads its own terms alone, and forgets what is gone."""
    from quillgraph.operators import retrieval, store

    text = lambda k: " ".join(f"w{(k * j) % 23}" for j in range(1, 40))
    rows = [(k, "class", f"name_{k % 7}", f"p{k % 5}", 1, 2, text(k), f"name {k % 7}", [1.0, float(k)]) for k in range(1, 60)]
    shape = store.TABLES["symbols"]
    st = store.Store(spark, str(tmp_path / "st"))
    assert st.index().postings.count() == 0 and st.top_id() == 0
    st.append(spark.createDataFrame(rows[:40], shape))
    st.append(spark.createDataFrame(rows[40:], shape))
    q = spark.createDataFrame([("a", "w3 name_2"), ("b", "w1_w2 class"), ("c", "nowhere"), ("d", "")], "qid string, query string")

    def scores(source):
        return {(r["qid"], r["id"]): round(r["bm25_score"], 9) for r in retrieval.bm25(source, q).collect()}

    want = scores(st.table("symbols"))
    assert want and scores(st.index()) == want
    monkeypatch.setattr(retrieval, "MOST_TERMS", 1)  # the terms are joined instead
    assert scores(st.index()) == want and scores(st.table("symbols")) == want
    monkeypatch.undo()
    plan = retrieval.bm25(st.index(), q)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan
    st.replace_paths(spark.createDataFrame([("p1",)], "path string"), spark.createDataFrame([], shape))
    left = st.table("symbols")
    assert left.where("path = 'p1'").count() == 0 and left.count() == 47
    assert scores(st.index()) == scores(left) != want
    monkeypatch.setattr(store, "MOST_PARTS", 1)  # the store is written together
    st.append(spark.createDataFrame([(90, *rows[0][1:])], shape))
    assert st.table("symbols").count() == 48 and scores(st.index()) == scores(st.table("symbols"))
    assert len(st._pointer()[2]["symbols"]) == 1 and "gone" not in st._pointer()[2]


def test_registry(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
    assert entry.entry(spark).count() > 0
