import pytest
from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.functions import text as tx
from quillgraph.functions import vector as vx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("name", "words"),
    [("walkSubtree", "walk subtree"), ("assertRealPathInsideVault", "assert real path inside vault"), ("XMLParser", "xml parser"), ("ObsidianAdapter", "obsidian adapter"), ("PROTECTED_DIRS", "protected dirs"), ("kb_meta", "kb meta"), ("foo.bar/baz-qux_quux", "foo bar baz qux quux"), ("", ""), ("a1B", "a1 b")],
)
def test_decompose(spark, name, words):
    assert one(spark, name, tx.decompose) == words


def test_phrases_and_tokens(spark):
    assert one(spark, "PROTECTED_DIRS  Éa! ** x", tx.fts_phrases) == [["protected", "dirs"], ["ea"], ["x"]]
    assert one(spark, None, tx.tokens) == []


@pytest.mark.parametrize(("path", "out"), [("a/b/./c/../d", "a/b/d"), ("../x", "x"), ("a\\b", "a/b"), ("", "")])
def test_normalize_path(spark, path, out):
    assert one(spark, path, tx.normalize_path) == out


@pytest.mark.parametrize(
    ("question", "subject"),
    [("who calls parseTrees and walkSubset here", "walkSubset"), ("what uses load_all", "load_all"), ("which callers exist", "callers"), ("is it", "is it"), ("", "")],
)
def test_extract_subject(spark, question, subject):
    assert one(spark, question, tx.extract_subject) == subject


def test_safe_json(spark):
    rows = ['{"verdict": "A", "grade": 2}', 'so {"grade": 3} it is', '{"verdict": "B", "reason": "x', "nothing"]
    got = [tuple(r["j"]) for r in spark.createDataFrame([(r,) for r in rows], "x string").select(tx.safe_json(F.col("x")).alias("j")).collect()]
    assert got == [("A", 2, None, False, False), (None, 3, None, False, False), ("B", None, None, True, False), (None, None, None, False, True)]


def test_small_functions(spark):
    assert one(spark, "src/a:b:Name", tx.parse_hit).asDict() == {"path": "src/a:b", "name": "Name"}
    assert one(spark, "top.ts", tx.module_of) == "<root>"
    assert one(spark, "a/b/c.ts", tx.module_of) == "a/b"
    assert one(spark, "a/b/c.ts", tx.module_of_two) == "a/b"
    assert one(spark, "x /* y */ z // t\nhttp://k", tx.strip_comments).split() == ["x", "z", "http://k"]
    assert tx.clip("é" * 300) == "é" * 250 + "..."
    assert tx.clip("abc") == "abc"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0, 0.0]


def test_embedder_retries_and_faults(spark):
    waits = []
    df = spark.createDataFrame([("a b",), ("c",)], "t string").coalesce(1)
    fail = vx.InjectedFault(lambda t: [1.0], "once")
    assert [r[0] for r in df.select(vx.guarded(fail, sleep=waits.append)(F.col("t"))).collect()] == [[1.0], [1.0]]
    assert [r[0] for r in df.select(vx.guarded(vx.InjectedFault(lambda t: [1.0]), attempts=2, first_wait=0.0)(F.col("t"))).collect()] == [None, None]
    assert [r[0] for r in df.select(vx.guarded(vx.InjectedFault(lambda t: [1.0], "after", 1), attempts=1)(F.col("t"))).collect()] == [[1.0], None]
    got = df.select(vx.hashing_embedder(16)(F.col("t")).alias("v")).collect()
    assert all(len(r["v"]) == 16 and abs(sum(x * x for x in r["v"]) - 1) < 1e-5 for r in got)


def test_assert_schema(spark):
    df = spark.createDataFrame([], schema.EDGES)
    assert schema.assert_schema(df, schema.EDGES, exact=True) is df
    with pytest.raises(ValueError, match="missing"):
        schema.assert_schema(df.drop("kind"), schema.EDGES)
    with pytest.raises(ValueError, match="not bigint"):
        schema.assert_schema(df.withColumn("to_id", F.lit("x")), schema.EDGES)
    with pytest.raises(ValueError, match="unexpected"):
        schema.assert_schema(df.withColumn("z", F.lit(1)), schema.EDGES, exact=True)
