import random

from pyspark.sql import functions as F

from quillgraph.operators import resolve


def test_enclosing_equals_a_search_of_all_symbols(spark):
    """Random lines, nested and crossing, many at one place, empty ones among them."""
    rnd = random.Random(1)
    symbols = [(i, "ab"[i % 2], s, s + rnd.choice([-1, 0, 0, 1, 2, 5, 30, 100])) for i, s in ((i, rnd.randrange(0, 120)) for i in range(400))]
    captures = [("abc"[i % 3], rnd.randrange(-2, 240), f"n{i % 7}") for i in range(300)] + [("a", 5, "twice")] * 2
    s = spark.createDataFrame(symbols, "id long, path string, start_line int, end_line int")
    c = spark.createDataFrame(captures, "path string, row int, name string")
    want = set()
    for path, row, name in captures:
        inside = [(e - b, b, i) for i, p, b, e in symbols if p == path and b <= row <= e]
        if inside:
            want.add((path, row, name, min(inside)[2]))
    got = resolve.enclosing(c, s)
    assert got.columns == ["path", "row", "name", "from_id"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert resolve.enclosing(c, s.where("false")).count() == 0


def test_enclosing_pairs_grow_with_the_rows(spark):
    """30,000 captures in as many symbols of one file: no join may make their pairs, 450 million before."""
    n = 30_000
    s = spark.range(n).select("id", F.lit("f").alias("path"), F.col("id").cast("int").alias("start_line"), F.lit(n).alias("end_line"))
    c = spark.range(n).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("row"))
    got = resolve.enclosing(c, s)
    assert got.where("from_id <> row").count() == 0 and got.count() == n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "start_line" not in "".join(x for x in plan.splitlines() if "Join" in x) and ">=" not in "".join(x for x in plan.splitlines() if "Join" in x)
