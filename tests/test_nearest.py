import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import retrieval as rt
from quillgraph.plans import registry


@pytest.mark.parametrize("odd", [[], [(900, []), (901, None), (902, [1.0, 2.0])], [(900, [None] * 8), (901, [float("nan")] * 8)]])
def test_nearest_is_what_all_scores_give(spark, odd):
    """Random vectors, ties by copies and zeros among them, in matrices of a few rows."""
    v = np.random.default_rng(1).normal(size=(120, 8)).astype(np.float32)
    v[20:60], v[60] = v[3], 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + odd
    e = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    q = e.where("id % 5 = 3 OR id >= 900").select(F.col("id").alias("qid"), "embedding")
    take = lambda s: sorted((r["qid"], r["rank"], r["id"]) for r in rt.ranked(s, "vector_score", "rank", 10).collect())
    assert take(rt.nearest(e, q, 10, rows=16, block=3)) == take(rt.cosine_scores(e, q))


def test_batch_search_makes_no_row_for_each_pair(spark):
    plan = registry.queries()["vector_topk_batch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(zip_with" not in plan
