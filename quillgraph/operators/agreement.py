"""Agreement between judges: kappa, rank correlation, pairwise verdicts, grade rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import ranking


def kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Cohen's kappa of two binary columns; if chance agreement is 1, 1 for perfect agreement and NaN otherwise; NaN without rows."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"), F.count(F.lit(1)).alias("n"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    value = F.when(F.col("n") == 0, F.lit(float("nan"))).when(pe >= 1, F.when(F.col("po") == 1, 1.0).otherwise(F.lit(float("nan")))).otherwise((F.col("po") - pe) / (1 - pe))
    return s.select(value.alias("kappa"), "po", "n")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the rank of each value, ties sharing the mean of theirs; ranks are made over distinct values and joined back."""
    c = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    upto = ranking.running_total(c, [column], "_c", "_upto")
    return df.join(upto.select(column, (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias(name)), column, "left")


def spearman(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """rho over rows that have both; NaN under two rows or without variance."""
    p = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    r = average_ranks(average_ranks(p, a, "_ra"), b, "_rb")
    got = r.agg(F.covar_pop("_ra", "_rb").alias("cov"), F.count(F.lit(1)).alias("n"), F.stddev_pop("_ra").alias("sa"), F.stddev_pop("_rb").alias("sb"))
    return got.select(F.when((F.col("n") < 2) | (F.col("sa") == 0) | (F.col("sb") == 0), F.lit(float("nan"))).otherwise(F.col("cov") / (F.col("sa") * F.col("sb"))).alias("rho"), "n")


def pairwise_counts(rows: DataFrame) -> DataFrame:
    """Verdicts (axis, raw_verdict, flipped) by axis and overall (axis null): a, b, tie, error as attributed; first and second as shown."""
    real = tx.real_verdict(F.col("raw_verdict"), F.col("flipped"))
    r = rows.withColumn("real", F.coalesce(real, F.lit("error")))
    shown = F.coalesce(F.col("raw_verdict"), F.lit(""))
    return r.rollup("axis").agg(
        F.count_if(F.col("real") == "A").alias("a"), F.count_if(F.col("real") == "B").alias("b"), F.count_if(F.col("real") == "tie").alias("tie"), F.count_if(F.col("real") == "error").alias("error"),
        F.count_if(shown == "A").alias("first_shown"), F.count_if(shown == "B").alias("second_shown"), F.count_if(~F.col("flipped")).alias("shown_first_a"), F.count_if(F.col("flipped")).alias("shown_first_b"),
    )


def two_orderings(rows: DataFrame) -> DataFrame:
    """Both orders judged (v_ab, v_ba): consistent_a, consistent_b, inconsistent, tie_or_mixed, error and the inconsistency rate."""
    known = lambda c: F.coalesce(F.col(c).isin("A", "B", "tie"), F.lit(False))
    back = F.when(F.col("v_ba") == "A", "B").when(F.col("v_ba") == "B", "A").otherwise(F.col("v_ba"))
    r = rows.withColumn("ba", back)
    kind = (
        F.when(~known("v_ab") | ~known("v_ba"), "error")
        .when((F.col("v_ab") == "A") & (F.col("ba") == "A"), "consistent_a")
        .when((F.col("v_ab") == "B") & (F.col("ba") == "B"), "consistent_b")
        .when((F.col("v_ab") != "tie") & (F.col("ba") != "tie"), "inconsistent")
        .otherwise("tie_or_mixed")
    )
    names = ("consistent_a", "consistent_b", "inconsistent", "tie_or_mixed", "error")
    got = r.withColumn("kind", kind).agg(*[F.count_if(F.col("kind") == n).alias(n) for n in names])
    judged = F.col("consistent_a") + F.col("consistent_b") + F.col("inconsistent") + F.col("tie_or_mixed")
    return got.withColumn("inconsistency_rate", F.when(judged > 0, F.col("inconsistent") / judged).otherwise(F.lit(float("nan"))))


def grade_rollup(judged: DataFrame, expected: int = 5, relevant: int = 2) -> DataFrame:
    """Per query (qid, verdict 0/1, grade, error): mean verdict, mean and max grade, share of grades that are relevant, judged, missing, errors."""
    good = F.col("error").isNull()
    return judged.groupBy("qid").agg(
        F.avg(F.when(good, F.col("verdict").cast("double"))).alias("arm_a_p_at_5"), F.avg(F.when(good, F.col("grade").cast("double"))).alias("arm_b_mean_grade"), F.max(F.when(good, F.col("grade"))).alias("arm_b_max_grade"),
        F.avg(F.when(good, (F.col("grade") >= relevant).cast("double"))).alias("arm_b_p_at_5_at_t2"), F.count_if(good).alias("n_judged"), F.greatest(F.lit(0), F.lit(expected) - F.count(F.lit(1))).cast("long").alias("missing"), F.count_if(~good).alias("errors"),
    )


def match_count(pairs: DataFrame, a: str, b: str, threshold: float = 0.5) -> DataFrame:
    """matches, n: rows on whose side of the threshold both columns agree."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count_if((F.col(a) >= threshold) == (F.col(b) >= threshold)).alias("matches"), F.count(F.lit(1)).alias("n"))


def seeds_precision(grades: DataFrame, relevant: float = 2.0) -> DataFrame:
    """Per query: the share of hits (qid, hit, seed, grade) whose mean grade over seeds is relevant, and the mean of means."""
    per = grades.groupBy("qid", "hit").agg(F.avg(F.col("grade").cast("double")).alias("g"))
    return per.groupBy("qid").agg(F.avg((F.col("g") >= relevant).cast("double")).alias("p_at_5"), F.avg("g").alias("mean_grade"), F.count(F.lit(1)).alias("hits"))


def rounds_joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two evaluation rounds by query id, only those in both."""
    return a.alias("x").join(b.alias("y"), "qid").select("qid", F.col("x.top5").alias("top5_a"), F.col("y.top5").alias("top5_b"))
