import pytest
from pyspark.sql import functions as F

from quillgraph.operators import retrieval as rt

Q = [("a", "the of_the"), ("b", "the_the x"), ("c", "of_the_end the the"), ("d", "nothing")]


@pytest.fixture
def symbols(spark):
    rows = [(1, "the the the", "of the end of", None, "x"), (2, "of", "the end", "the", ""), (3, "ofThe", "of the endless of_the_end", "of the", "the"), (4, None, "", "q", "r s t")]
    return spark.createDataFrame(rows, "id long, name string, snippet string, kind string, search_blob string")


def test_counted_where_they_are_and_from_postings_alike(spark, symbols):
    q = spark.createDataFrame(Q, "qid string, query string")
    index = rt.Index(rt.postings(symbols), rt.lengths(symbols))
    rows = [{(r["qid"], r["id"]): r["bm25_score"] for r in rt.bm25(x, q).collect()} for x in (symbols, index)]
    assert rows[0].keys() == rows[1].keys() and len(rows[0]) > 5
    assert all(rows[0][k] == pytest.approx(rows[1][k], abs=1e-12) for k in rows[0])


def test_a_frequent_term_is_not_sent_to_one_task(spark, symbols):
    """No exchange of a search may deal rows by term."""
    q = spark.createDataFrame(Q, "qid string, query string")
    postings = symbols.select(F.explode(F.split("snippet", " ")).alias("term"), "id", F.lit("snippet").alias("col"), F.lit(0).alias("pos"))
    seen = []
    checkpoint = type(symbols).checkpoint

    def noted(df, *a, **b):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df, *a, **b)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(symbols), "checkpoint", noted)
        for x in (symbols, rt.Index(postings, rt.lengths(symbols))):
            seen.append(rt.bm25(x, q)._jdf.queryExecution().executedPlan().toString())
    assert not [line for plan in seen for line in plan.splitlines() if "Exchange hashpartitioning(term" in line]
