"""How much two index snapshots differ: symbols (id, path, name, kind), edges (from_id, to_id, kind, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["path", "name", "kind"]
SAMPLE = 30


def jaccard(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """jaccard of the two sets of keys, 1 if both are empty; one pass over tagged rows."""
    tagged = a.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, F.lit(0).alias("x"), F.lit(1).alias("y")))
    per = tagged.groupBy(*keys).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    got = per.agg(F.sum(F.col("x") * F.col("y")).alias("both"), F.count(F.lit(1)).alias("any"))
    return got.select(F.when(F.col("any") == 0, 1.0).otherwise(F.col("both") / F.col("any")).alias("jaccard"), F.coalesce("both", F.lit(0)).cast("long").alias("n_both"), F.col("any").alias("n_any"))


def rowid_stability(a: DataFrame, b: DataFrame) -> DataFrame:
    """stable, matched: of keys in both (the last id of each), the share that kept its id; 1 if none matches."""
    last = lambda d, n: d.groupBy(*KEY).agg(F.max("id").alias(n))
    m = last(a, "ia").join(last(b, "ib"), KEY)
    return m.agg(F.coalesce(F.avg((F.col("ia") == F.col("ib")).cast("double")), F.lit(1.0)).alias("stable"), F.count(F.lit(1)).alias("matched"))


def edge_keys(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges as (source path and name, target path and name, kind)."""
    s = symbols.select("id", "path", "name")
    e = edges.join(s.select(F.col("id").alias("from_id"), F.col("path").alias("src_path"), F.col("name").alias("src_name")), "from_id")
    return e.join(s.select(F.col("id").alias("to_id"), F.col("path").alias("dst_path"), F.col("name").alias("dst_name")), "to_id").select("src_path", "src_name", "dst_path", "dst_name", "kind").distinct()


def edge_stability(sa: DataFrame, ea: DataFrame, sb: DataFrame, eb: DataFrame) -> DataFrame:
    return jaccard(edge_keys(sa, ea), edge_keys(sb, eb), ["src_path", "src_name", "dst_path", "dst_name", "kind"])


def attachment(a: DataFrame, b: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Of `sample` symbols of a (by hash of id), the share found again in b by id, by key, and by key or name and kind."""
    s = a.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample)
    flag = lambda d, cols, n: d.select(*cols).distinct().withColumn(n, F.lit(True))
    j = s.join(flag(b, ["id"], "by_id"), "id", "left").join(flag(b, KEY, "by_key"), KEY, "left").join(flag(b, ["name", "kind"], "by_name"), ["name", "kind"], "left")
    share = lambda c: F.coalesce(F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 4), F.lit(1.0))
    return j.agg(share(F.col("by_id")).alias("rowid_only"), share(F.col("by_key")).alias("fnk"), share(F.coalesce(F.col("by_key"), F.col("by_name"))).alias("fnk_with_path_fallback"))


def pair_metrics(sa: DataFrame, ea: DataFrame, sb: DataFrame, eb: DataFrame) -> DataFrame:
    """One row: m1 key overlap, m2 stable ids, m3 edge overlap, m5 attachment shares, m6 change of count."""
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    out = jaccard(sa, sb, KEY).select(F.round("jaccard", 4).alias("m1"))
    for part in (rowid_stability(sa, sb).select(F.round("stable", 4).alias("m2")), edge_stability(sa, ea, sb, eb).select(F.round("jaccard", 4).alias("m3")), attachment(sa, sb), count(sa, "na"), count(sb, "nb")):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out.withColumn("m6", F.col("nb") - F.col("na")).drop("na", "nb")


def summary(pairs: DataFrame) -> DataFrame:
    """Least m1, m2, m3 and attachment shares over all pairs, and the change of count that is largest in size, with its sign."""
    return pairs.agg(*[F.min(c).alias(c) for c in ("m1", "m2", "m3", "rowid_only", "fnk", "fnk_with_path_fallback")], F.max_by("m6", F.struct(F.abs(F.col("m6")), "m6")).alias("m6"))


def decide(summary: DataFrame, least: float = 0.99) -> DataFrame:
    """`stable` if keyed attachments and edges survive and no symbol came or went, `drifting` if either is below the threshold, else `inconclusive`."""
    holds = (F.col("fnk") >= least) & (F.col("m3") >= least)
    return summary.withColumn("decision", F.when(~holds, "drifting").when(F.col("m6") == 0, "stable").otherwise("inconclusive"))
