"""Deterministic ids, ranks and first-wins rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import cut


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row within its keys; ties must be broken by `order`."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; a filter on row_number, so Spark cuts groups before it shuffles them."""
    return rank_within(df, keys, order, name).where(F.col(name) <= k)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by `order`: what insert-or-ignore leaves."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("row")).select("row.*")


def number_rows(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Consecutive ids from 1 in the given order, the same on every run.

    Rows are ranged by the order and numbered within ranges; only the ranges' sizes, one number each, meet on the driver.
    """
    return running_total(df.withColumn("_one", F.lit(1)), order, "_one", name).select(name, *df.columns)


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` up to and including each row, in an order without ties, without one task seeing all rows.

    The ranged rows are written once, as ranges are drawn from a sample and may differ from run to run.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    tagged = cut(ranged.withColumn("_part", F.spark_partition_id()))
    total, rows = 0, []
    for r in sorted(tagged.groupBy("_part").agg(F.sum(value).alias("s")).collect()):
        rows.append((r["_part"], total))
        total += r["s"]
    start = F.broadcast(df.sparkSession.createDataFrame(rows, "_part int, _start long"))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return tagged.withColumn("_n", within).join(start, "_part").select(*df.columns, (F.col("_start") + F.col("_n")).cast("long").alias(name))


def dedupe_ranked(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """A ranked list without repeats of (path, name): the first of each stays, then the first k."""
    once = top_k(df, [*keys, "path", "name"], order, 1, "_first").drop("_first")
    return top_k(once, keys, order, k) if keys else once.orderBy(*order).limit(k)
