"""Retrieval evaluation: matching hits, banded scores, per-axis means, sweeps, gates and latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import ranking

#: Scores under which a query that should find nothing counts as right.
NEGATIVE_FUSED, NEGATIVE_RERANKED = 0.012, 0.30


def matches(path: Column, name: Column, expected: Column) -> Column:
    """Whether a hit's path or name holds any expected fragment, case and slashes aside."""
    p, n = F.lower(tx.norm_slashes(path)), F.lower(name)
    return F.exists(expected, lambda e: p.contains(F.lower(tx.norm_slashes(e))) | n.contains(F.lower(tx.norm_slashes(e))))


def banded(hits: Column, inner: int = 1, outer: int = 3) -> Column:
    """1 if any of the first `inner` hits matches, 0.5 if any of the first `outer`, else 0 (hits: booleans by rank)."""
    some = lambda k: F.exists(F.slice(hits, 1, k), lambda x: x)
    return F.when(some(inner), 1.0).when(some(outer), 0.5).otherwise(0.0)


def banded_p3(hits: Column) -> Column:
    return banded(hits, 1, 3)


def banded_p5(hits: Column) -> Column:
    return banded(hits, 1, 5)


def hit_at_5(hits: Column) -> Column:
    return F.when(F.exists(F.slice(hits, 1, 5), lambda x: x), 1.0).otherwise(0.0)


def precision_at_k(hits: Column, k: int = 5) -> Column:
    return F.size(F.filter(F.slice(hits, 1, k), lambda x: x)) / F.lit(float(k))


def negative_score(top: Column, threshold: float = NEGATIVE_FUSED) -> Column:
    """A query that should find nothing: 1 if there is no hit or a weak one, else -0.25."""
    return F.when(top.isNull() | (top < threshold), 1.0).otherwise(-0.25)


def score_queries(queries: DataFrame, hits: DataFrame, threshold: float = NEGATIVE_FUSED) -> DataFrame:
    """Every query with its top five and score; queries (id, axis, query, expected_paths, negative), hits (qid, rank, path, name, score)."""
    q = queries.withColumn("negative", F.coalesce("negative", F.lit(False)))
    h = hits.join(q.select(F.col("id").alias("qid"), "expected_paths"), "qid").withColumn("ok", matches(F.col("path"), F.col("name"), F.col("expected_paths")))
    per = h.where("rank <= 5").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "ok", F.concat_ws(":", "path", "name").alias("hit"), "score"))).alias("h"))
    joined = q.join(per, q["id"] == per["qid"], "left")
    flags = F.coalesce(F.transform("h", lambda x: x["ok"]), F.array().cast("array<boolean>"))
    score = F.when(F.col("negative"), negative_score(F.try_element_at("h", F.lit(1))["score"], threshold)).otherwise(banded_p3(flags))
    return joined.select("id", "axis", "query", "negative", F.coalesce(F.transform("h", lambda x: x["hit"]), F.array().cast("array<string>")).alias("top5"), score.alias("precision_at_5"))


def axis_means(scored: DataFrame, axis: str = "axis", score: str = "precision_at_5") -> DataFrame:
    """axis, mean, n per axis, and overall where axis is null."""
    return scored.rollup(axis).agg(F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"))


def scored_means(rows: DataFrame) -> DataFrame:
    """all_mean and scored_mean: rows flagged subject_unindexed leave the second's denominator."""
    return rows.agg(F.avg("precision").alias("all_mean"), F.avg(F.when(~F.col("subject_unindexed"), F.col("precision"))).alias("scored_mean"), F.count_if(~F.col("subject_unindexed")).alias("n_scored"))


def sweep(scored: DataFrame, slices: list[str]) -> DataFrame:
    """Means by alpha and slice columns, and whether an alpha is its slice's best (of equals the smallest)."""
    m = scored.groupBy(*slices, "alpha").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*slices).orderBy(F.desc("mean"), "alpha")
    return m.withColumn("is_best", F.row_number().over(w) == 1)


def attach_snippets(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits (`path:name` in column hit) with the snippet of the symbol they name, slashes aside; null if there is none."""
    h = hits.withColumn("_h", tx.parse_hit(F.col("hit"))).withColumn("_path", tx.norm_slashes(F.col("_h.path"))).withColumn("_name", F.col("_h.name"))
    s = symbols.groupBy(tx.norm_slashes(F.col("path")).alias("_path"), F.col("name").alias("_name")).agg(F.min_by("snippet", "id").alias("snippet"))
    return h.join(s, ["_path", "_name"], "left").drop("_h", "_path", "_name")


def overlap_rate(base: DataFrame, other: DataFrame, least: int = 3) -> DataFrame:
    """rate, n: the share of queries (qid, top array) whose lists have `least` hits in common; negatives are left out beforehand."""
    both = base.join(other.withColumnRenamed("top", "other"), "qid")
    hit = F.size(F.array_intersect("top", "other")) >= least
    return both.agg(F.avg(hit.cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def at_index(values: DataFrame, column: str, index: dict[str, Column]) -> DataFrame:
    """The ascending values at given 0-based places, each a function of the column n; null beyond the ends.

    Places are found on counts of distinct values, so nothing is gathered in one array.
    """
    v = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = ranking.running_total(v, ["v"], "c", "upto")
    total = v.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    return upto.crossJoin(F.broadcast(total)).agg(*[F.min(F.when(F.col("upto") > i, F.col("v"))).alias(name) for name, i in index.items()])


def percentiles(values: DataFrame, column: str, points: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """p10, p50, ...: the element at floor(p / 100 * n), the last at most."""
    return at_index(values, column, {f"p{p}": F.least(F.floor(F.lit(p / 100) * F.col("n")), F.col("n") - 1) for p in points})


def equivalence_gate(snapshot: DataFrame, live: DataFrame, cosine, least_mean: float = 0.97, least_p10: float = 0.95) -> DataFrame:
    """Old against new embeddings (id, role, embedding): mean, p10, p50, p90, n, missing, and whether the gate passes."""
    j = snapshot.join(live.withColumnRenamed("embedding", "live"), ["id", "role"], "left").withColumn("cos", F.when(F.col("live").isNotNull(), cosine(F.col("embedding"), F.col("live"))))
    p = percentiles(j, "cos")
    m = j.agg(F.avg("cos").alias("mean"), F.count("cos").alias("n"), F.count_if(F.col("live").isNull()).alias("missing"))
    return p.crossJoin(F.broadcast(m)).withColumn("passes", F.coalesce((F.col("mean") >= least_mean) & (F.col("p10") >= least_p10) & (F.col("missing") == 0), F.lit(False)))


def latency_summary(calls: DataFrame) -> DataFrame:
    """n, ok_count, ok_rate, p50, p95 of calls (status, dt); percentiles over status 200, p95 at max(0, floor(0.95 n) - 1)."""
    p = at_index(calls.where("status = 200"), "dt", {"p50": F.floor(F.col("n") / 2), "p95": F.greatest(F.lit(0), F.floor(0.95 * F.col("n")) - 1)})
    m = calls.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == 200).alias("ok_count"))
    return m.crossJoin(F.broadcast(p)).select("n", "ok_count", F.when(F.col("n") > 0, F.col("ok_count") / F.col("n")).otherwise(0.0).alias("ok_rate"), "p50", "p95")


def status_histogram(calls: DataFrame) -> DataFrame:
    return calls.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
