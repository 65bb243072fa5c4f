import math

from quillgraph.operators import agreement as ag
from quillgraph.operators import drift, evaluate


def test_kappa(spark):
    rows = lambda *p: spark.createDataFrame(list(p), "a int, b int")
    assert round(ag.kappa(rows((1, 1), (0, 0), (1, 0), (0, 0))).first()["kappa"], 6) == 0.5
    assert ag.kappa(rows((1, 1), (1, 1))).first()["kappa"] == 1.0
    assert math.isnan(ag.kappa(rows((None, 1))).first()["kappa"])


def test_spearman(spark):
    rows = lambda *p: spark.createDataFrame(list(p), "a double, b double")
    assert round(ag.spearman(rows((1.0, 2.0), (2.0, 4.0), (3.0, 9.0))).first()["rho"], 9) == 1.0
    assert round(ag.spearman(rows((1.0, 1.0), (1.0, 2.0), (2.0, 3.0))).first()["rho"], 6) == 0.866025
    assert math.isnan(ag.spearman(rows((1.0, 1.0))).first()["rho"])
    assert math.isnan(ag.spearman(rows((1.0, 1.0), (1.0, 2.0))).first()["rho"])


def test_pairwise(spark):
    rows = spark.createDataFrame([(1, "A", False), (1, "A", True), (2, "tie", True), (2, None, False), (2, "zz", False)], "axis int, raw_verdict string, flipped boolean")
    got = {r["axis"]: (r["a"], r["b"], r["tie"], r["error"], r["first_shown"]) for r in ag.pairwise_counts(rows).collect()}
    assert got == {1: (1, 1, 0, 0, 2), 2: (0, 0, 1, 2, 0), None: (1, 1, 1, 2, 2)}


def test_two_orderings(spark):
    rows = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "A"), ("tie", "A"), (None, "A")], "v_ab string, v_ba string")
    r = ag.two_orderings(rows).first()
    assert (r["consistent_a"], r["consistent_b"], r["inconsistent"], r["tie_or_mixed"], r["error"], r["inconsistency_rate"]) == (1, 1, 1, 1, 1, 0.25)


def test_drift(spark):
    shape = "id long, path string, name string, kind string"
    a = spark.createDataFrame([(1, "p", "x", "f"), (2, "p", "y", "f")], shape)
    b = spark.createDataFrame([(1, "p", "x", "f"), (3, "q", "y", "f")], shape)
    none = spark.createDataFrame([], "from_id long, to_id long, kind string, confidence double")
    got = drift.decide(drift.summary(drift.pair_metrics(a, none, b, none))).first()
    assert (got["m1"], got["m2"], got["m3"], got["rowid_only"], got["fnk"], got["fnk_with_path_fallback"], got["m6"], got["decision"]) == (0.3333, 1.0, 1.0, 0.5, 0.5, 1.0, 0, "drifting")
    same = drift.decide(drift.summary(drift.pair_metrics(a, none, a, none))).first()
    assert same["decision"] == "stable"
    assert drift.jaccard(a.where("false"), b.where("false"), ["id"]).first()["jaccard"] == 1.0


def test_sweep_and_overlap(spark):
    rows = spark.createDataFrame([("s", 0.4, 1.0), ("s", 0.5, 1.0), ("s", 0.6, 0.0)], "slice string, alpha double, score double")
    assert {r["alpha"]: r["is_best"] for r in evaluate.sweep(rows, ["slice"]).collect()} == {0.4: True, 0.5: False, 0.6: False}
    tops = lambda *p: spark.createDataFrame(list(p), "qid string, top array<string>")
    assert evaluate.overlap_rate(tops(("a", ["1", "2", "3"]), ("b", ["1"])), tops(("a", ["3", "2", "1"]), ("b", ["1"]))).first()["rate"] == 0.5
