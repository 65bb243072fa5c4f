import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph


@pytest.fixture
def walk(spark):
    e = spark.range(3000).select((F.col("id") % 500).alias("src"), (F.col("id") * 7 % 611).alias("dst"))
    return e, spark.createDataFrame([(1,), (2,), (9999,)], "node long")


def test_one_task_only_where_the_graph_is_counted_small(walk, monkeypatch):
    small = {r["node"]: r["score"] for r in graph.ppr(*walk, rounds=7, mode="task").collect()}
    monkeypatch.setattr(graph, "_is_small", lambda *a: False)
    monkeypatch.setattr(graph, "_ppr_numpy", lambda *a: pytest.fail("a large graph in one task"))
    large = {r["node"]: r["score"] for r in graph.ppr(*walk, rounds=7, mode="task").collect()}
    assert small.keys() == large.keys() and all(small[k] == pytest.approx(large[k], abs=1e-12) for k in small)


def test_rounds_send_no_table_to_the_driver_and_leave_edges_where_they_are(walk):
    plan = graph.ppr(*walk, rounds=2, mode="joins")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("Exchange hashpartitioning") <= 3  # the scores twice, and what flows
