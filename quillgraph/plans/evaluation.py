"""Evaluation, agreement and drift analytics over judgements and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..operators import drift, evaluate
from . import views
from .registry import query

J, S, E = views.JUDGED, views.SYMBOLS, views.EDGES


def _hits(spark, d):
    """Per source a ranked list of its five longest documents; a hit is right if its quality is 1."""
    from ..operators import ranking

    return ranking.top_k(views.judged(spark, d), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 5)


_HITS = f"{J}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM judged) WHERE rank <= 5)"
_FLAGS = "f AS (SELECT source, list(quality = 1 ORDER BY rank) AS ok FROM h GROUP BY source)"


def _flags(spark, d):
    return _hits(spark, d).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", (F.col("quality") == 1).alias("ok")))), lambda x: x["ok"]).alias("ok"))


@query(f"""WITH {_HITS}, {_FLAGS} SELECT source, CASE WHEN ok[1] THEN 1.0 WHEN list_contains(ok[1:3], true) THEN 0.5 ELSE 0.0 END::DOUBLE AS banded_p3, CASE WHEN ok[1] THEN 1.0 WHEN list_contains(ok[1:5], true) THEN 0.5 ELSE 0.0 END::DOUBLE AS banded_p5,
CASE WHEN list_contains(ok[1:5], true) THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_at_5, len(list_filter(ok, lambda x: x)) / 5.0::DOUBLE AS precision_at_5 FROM f""")
def banded_scores(spark, d):
    ok = F.col("ok")
    return _flags(spark, d).select("source", evaluate.banded_p3(ok).alias("banded_p3"), evaluate.banded_p5(ok).alias("banded_p5"), evaluate.hit_at_5(ok).alias("hit_at_5"), evaluate.precision_at_k(ok).alias("precision_at_5"))


@query(f"WITH {J}, s AS (SELECT lang, quality::DOUBLE AS p FROM judged) SELECT lang AS axis, round(avg(p), 9) AS mean, count(*) AS n FROM s GROUP BY ROLLUP (lang)")
def axis_precision(spark, d):
    """Mean score per axis and overall."""
    s = views.judged(spark, d).select(F.col("lang").alias("axis"), F.col("quality").cast("double").alias("precision_at_5"))
    return evaluate.axis_means(s).select("axis", F.round("mean", 9).alias("mean"), "n")


_ALPHA = "a AS (SELECT lang, al AS alpha, CASE WHEN quality * (1 - al) + toxic * al >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM judged, (VALUES (0.4::DOUBLE), (0.5), (0.6), (0.7), (0.8)) v(al))"


@query(f"WITH {J}, {_ALPHA}, m AS (SELECT lang, alpha, avg(score) AS mean, count(*) AS n FROM a GROUP BY ALL) SELECT lang, alpha, round(mean, 9) AS mean, n, row_number() OVER (PARTITION BY lang ORDER BY mean DESC, alpha) = 1 AS is_best FROM m")
def alpha_sweep(spark, d):
    alphas = spark.createDataFrame([(a,) for a in (0.4, 0.5, 0.6, 0.7, 0.8)], "alpha double")
    mixed = F.col("quality") * (1 - F.col("alpha")) + F.col("toxic") * F.col("alpha")
    rows = views.judged(spark, d).crossJoin(F.broadcast(alphas)).select("lang", "alpha", F.when(mixed >= 0.5, 1.0).otherwise(0.0).alias("score"))
    return evaluate.sweep(rows, ["lang"]).withColumn("mean", F.round("mean", 9))


@query("SELECT page_id, contains(lower(replace(url, chr(92), '/')), '/en/') OR contains(lower(replace(url, chr(92), '/')), 'example.org') OR contains(lower(html[1:200]), 'example.org') OR contains(lower(html[1:200]), '/en/') AS ok FROM pages WHERE url IS NOT NULL AND html IS NOT NULL")
def hit_matcher(spark, d):
    """Whether a page's address (as path) or its head (as name) holds an expected fragment."""
    p = views.table(spark, d, "pages").where("url IS NOT NULL AND html IS NOT NULL")
    return p.select("page_id", evaluate.matches(F.col("url"), F.substring("html", 1, 200), F.array(F.lit("/EN/"), F.lit("example.org"))).alias("ok"))


@query(f"WITH {_HITS}, g AS (SELECT source, max(CASE WHEN rank = 1 THEN n_chars END) AS top FROM h GROUP BY source) SELECT source, CASE WHEN top IS NULL OR top < 10000 THEN 1.0 ELSE -0.25 END::DOUBLE AS score FROM g")
def negative_scores(spark, d):
    top = _hits(spark, d).groupBy("source").agg(F.max(F.when(F.col("rank") == 1, F.col("n_chars"))).alias("top"))
    return top.select("source", evaluate.negative_score(F.col("top"), 10000).alias("score"))


@query(f"WITH {J} SELECT round(avg(quality::DOUBLE), 9) AS all_mean, round(avg(CASE WHEN toxic = 0 THEN quality::DOUBLE END), 9) AS scored_mean, count(*) FILTER (toxic = 0) AS n_scored FROM judged")
def subject_exclusion(spark, d):
    """Means with and without rows that cannot be scored."""
    rows = views.judged(spark, d).select(F.col("quality").cast("double").alias("precision"), (F.col("toxic") == 1).alias("subject_unindexed"))
    return evaluate.scored_means(rows).withColumns({c: F.round(c, 9) for c in ("all_mean", "scored_mean")})


@query(f"WITH {_HITS}, a AS (SELECT source AS qid, list(lang ORDER BY rank) AS top FROM h GROUP BY source), b AS (SELECT source AS qid, list(lang ORDER BY rank) AS other FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM judged) WHERE rank <= 5 GROUP BY source) SELECT round(avg(CASE WHEN len(list_intersect(top, other)) >= 3 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS rate, count(*) AS n FROM a JOIN b USING (qid)")
def topk_overlap(spark, d):
    """How often two rankings share three of five."""
    from ..operators import ranking

    tops = lambda df: df.groupBy(F.col("source").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "lang"))), lambda x: x["lang"]).alias("top"))
    short = ranking.top_k(views.judged(spark, d), ["source"], [F.asc("n_chars"), F.asc("doc_id")], 5)
    return evaluate.overlap_rate(tops(_hits(spark, d)), tops(short)).withColumn("rate", F.round("rate", 9))


_CALLS = "calls AS (SELECT CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS dt FROM events)"


def _calls(spark, d):
    return views.table(spark, d, "events").select(F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("dt"))


@query(f"WITH {_CALLS}, ok AS (SELECT list_sort(list(dt)) AS l, count(*) AS n FROM calls WHERE status = 200 AND dt IS NOT NULL) SELECT (SELECT count(*) FROM calls) AS n, (SELECT count(*) FROM calls WHERE status = 200) AS ok_count, round((SELECT count(*) FROM calls WHERE status = 200) / (SELECT count(*) FROM calls)::DOUBLE, 9) AS ok_rate, l[n // 2 + 1] AS p50, l[greatest(0, CAST(floor(0.95 * n) AS BIGINT) - 1) + 1] AS p95 FROM ok")
def latency_summary(spark, d):
    return evaluate.latency_summary(_calls(spark, d)).withColumn("ok_rate", F.round("ok_rate", 9))


@query(f"WITH {_CALLS} SELECT status, count(*) AS n FROM calls GROUP BY status")
def status_histogram(spark, d):
    return evaluate.status_histogram(_calls(spark, d))


@query(f"WITH {J}, s AS (SELECT avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END) AS po, avg(quality) AS pa, avg(1 - toxic) AS pb, count(*) AS n FROM judged WHERE quality IS NOT NULL AND toxic IS NOT NULL), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM s) SELECT round((po - pe) / (1 - pe), 9)::DOUBLE AS kappa, round(po, 9)::DOUBLE AS po, n FROM e")
def kappa(spark, d):
    rows = views.judged(spark, d).select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return ag.kappa(rows).withColumns({c: F.round(c, 9) for c in ("kappa", "po")})


@query(f"WITH {J}, r AS (SELECT rank() OVER (ORDER BY grade) + (count(*) OVER (PARTITION BY grade) - 1) / 2.0 AS a, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS b FROM judged) SELECT round(corr(a, b), 9) AS rho, count(*) AS n FROM r")
def spearman(spark, d):
    rows = views.judged(spark, d).select(F.col("grade").alias("a"), F.col("n_chars").alias("b"))
    return ag.spearman(rows).withColumn("rho", F.round("rho", 9))


_PAIR = "pw AS (SELECT lang AS axis, CASE WHEN toxic = 1 THEN NULL WHEN grade = 0 THEN 'tie' WHEN quality = 1 THEN 'A' ELSE 'B' END AS raw, doc_id % 2 = 1 AS fl FROM judged), pr AS (SELECT *, CASE WHEN raw = 'tie' THEN 'tie' WHEN raw = 'A' THEN CASE WHEN fl THEN 'B' ELSE 'A' END WHEN raw = 'B' THEN CASE WHEN fl THEN 'A' ELSE 'B' END ELSE 'error' END AS r FROM pw)"


@query(f"WITH {J}, {_PAIR} SELECT axis, count(*) FILTER (r = 'A') AS a, count(*) FILTER (r = 'B') AS b, count(*) FILTER (r = 'tie') AS tie, count(*) FILTER (r = 'error') AS error, count(*) FILTER (raw = 'A') AS first_shown, count(*) FILTER (raw = 'B') AS second_shown, count(*) FILTER (NOT fl) AS shown_first_a, count(*) FILTER (fl) AS shown_first_b FROM pr GROUP BY ROLLUP (axis)")
def pairwise_counts(spark, d):
    raw = F.when(F.col("toxic") == 1, None).when(F.col("grade") == 0, "tie").when(F.col("quality") == 1, "A").otherwise("B")
    return ag.pairwise_counts(views.judged(spark, d).select(F.col("lang").alias("axis"), raw.alias("raw_verdict"), (F.col("doc_id") % 2 == 1).alias("flipped")))


_TWO = "tw AS (SELECT CASE WHEN grade = 0 THEN 'tie' WHEN quality = 1 THEN 'A' ELSE 'B' END AS ab, CASE WHEN toxic = 1 THEN NULL WHEN n_chars % 3 = 0 THEN 'A' WHEN n_chars % 3 = 1 THEN 'B' ELSE 'tie' END AS ba FROM judged), tr AS (SELECT ab, CASE ba WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE ba END AS ba FROM tw)"


@query(f"""WITH {J}, {_TWO}, c AS (SELECT count(*) FILTER (ab = 'A' AND ba = 'A') AS consistent_a, count(*) FILTER (ab = 'B' AND ba = 'B') AS consistent_b, count(*) FILTER (ab IN ('A', 'B') AND ba IN ('A', 'B') AND ab <> ba) AS inconsistent, count(*) FILTER (ba IS NOT NULL AND (ab = 'tie' OR ba = 'tie')) AS tie_or_mixed, count(*) FILTER (ba IS NULL) AS error FROM tr)
SELECT *, round(inconsistent / (consistent_a + consistent_b + inconsistent + tie_or_mixed)::DOUBLE, 9) AS inconsistency_rate FROM c""")
def two_orderings(spark, d):
    ab = F.when(F.col("grade") == 0, "tie").when(F.col("quality") == 1, "A").otherwise("B")
    ba = F.when(F.col("toxic") == 1, None).when(F.col("n_chars") % 3 == 0, "A").when(F.col("n_chars") % 3 == 1, "B").otherwise("tie")
    return ag.two_orderings(views.judged(spark, d).select(ab.alias("v_ab"), ba.alias("v_ba"))).withColumn("inconsistency_rate", F.round("inconsistency_rate", 9))


@query(f"""WITH {J} SELECT source AS qid, round(avg(CASE WHEN toxic = 0 THEN quality::DOUBLE END), 9) AS arm_a_p_at_5, round(avg(CASE WHEN toxic = 0 THEN grade::DOUBLE END), 9) AS arm_b_mean_grade, max(CASE WHEN toxic = 0 THEN grade END) AS arm_b_max_grade,
round(avg(CASE WHEN toxic = 0 THEN CASE WHEN grade >= 2 THEN 1.0 ELSE 0.0 END END), 9)::DOUBLE AS arm_b_p_at_5_at_t2, count(*) FILTER (toxic = 0) AS n_judged, greatest(0, 25 - count(*)) AS missing, count(*) FILTER (toxic <> 0) AS errors FROM judged GROUP BY source""")
def grade_rollup(spark, d):
    rows = views.judged(spark, d).select(F.col("source").alias("qid"), F.col("quality").alias("verdict"), "grade", F.when(F.col("toxic") == 1, "timeout").alias("error"))
    got = ag.grade_rollup(rows, expected=25)
    return got.withColumns({c: F.round(c, 9) for c in ("arm_a_p_at_5", "arm_b_mean_grade", "arm_b_p_at_5_at_t2")})


@query(f"WITH {J} SELECT count(*) FILTER ((quality >= 0.5) = (grade >= 2)) AS matches, count(*) AS n FROM judged WHERE quality IS NOT NULL")
def agreement_matches(spark, d):
    rows = views.judged(spark, d).select(F.col("quality").cast("double").alias("a"), F.when(F.col("grade") >= 2, 1.0).otherwise(0.0).alias("b"))
    return ag.match_count(rows, "a", "b")


@query(f"WITH {J}, g AS (SELECT source AS qid, lang AS hit, avg(grade) AS g FROM judged GROUP BY ALL) SELECT qid, round(avg(CASE WHEN g >= 2 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS p_at_5, round(avg(g), 9) AS mean_grade, count(*) AS hits FROM g GROUP BY qid")
def seeds_precision(spark, d):
    """Grades averaged over repeats, then over hits."""
    rows = views.judged(spark, d).select(F.col("source").alias("qid"), F.col("lang").alias("hit"), F.col("doc_id").alias("seed"), "grade")
    return ag.seeds_precision(rows).withColumns({c: F.round(c, 9) for c in ("p_at_5", "mean_grade")})


# Two snapshots of an index: the orders as symbols, before and after the status F ones of 1997 on were renumbered and the priorities of others changed.
def _snapshots(spark, d):
    o = views.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    a = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("kind"))
    b = o.where(F.col("o_orderkey") % 97 != 0).select(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 31 == 0, "moved").otherwise(F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("kind"))
    return a, b


_SNAP = """sa AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS path, CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS kind FROM orders),
sb AS (SELECT CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 1 ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 31 = 0 THEN 'moved' ELSE CAST(o_custkey AS VARCHAR) END AS path, CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS kind FROM orders WHERE o_orderkey % 97 <> 0)"""
_JAC = "ka AS (SELECT DISTINCT path, name, kind FROM sa), kb AS (SELECT DISTINCT path, name, kind FROM sb), ji AS (SELECT count(*) AS n FROM (SELECT * FROM ka INTERSECT SELECT * FROM kb)), ju AS (SELECT count(*) AS n FROM (SELECT * FROM ka UNION SELECT * FROM kb))"
_STAB = "st AS (SELECT avg(CASE WHEN a.id = b.id THEN 1.0 ELSE 0.0 END)::DOUBLE AS stable, count(*) AS matched FROM (SELECT path, name, kind, max(id) AS id FROM sa GROUP BY ALL) a JOIN (SELECT path, name, kind, max(id) AS id FROM sb GROUP BY ALL) b USING (path, name, kind))"
_ATT = """sm AS (SELECT * FROM sa ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 30), att AS (SELECT round(avg(CASE WHEN id IN (SELECT id FROM sb) THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS rowid_only, round(avg(CASE WHEN (path, name, kind) IN (SELECT (path, name, kind) FROM sb) THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS fnk,
round(avg(CASE WHEN (path, name, kind) IN (SELECT (path, name, kind) FROM sb) OR (name, kind) IN (SELECT (name, kind) FROM sb) THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS fnk_with_path_fallback FROM sm)"""


@query(f"WITH {_SNAP}, {_JAC} SELECT round(ji.n / ju.n::DOUBLE, 9) AS jaccard, ji.n AS n_both, ju.n AS n_any FROM ji, ju")
def jaccard_sets(spark, d):
    a, b = _snapshots(spark, d)
    return drift.jaccard(a, b, drift.KEY).withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH {_SNAP}, {_STAB} SELECT round(stable, 9) AS stable, matched FROM st")
def rowid_stability(spark, d):
    return drift.rowid_stability(*_snapshots(spark, d)).withColumn("stable", F.round("stable", 9))


@query(f"WITH {_SNAP}, {_ATT} SELECT * FROM att")
def attachment_loss(spark, d):
    """Thirty symbols by hash of id (the operator's own sample), found again three ways."""
    return drift.attachment(*_snapshots(spark, d))


_ED = "ek AS (SELECT DISTINCT a.path AS sp, a.name AS sn, b.path AS dp, b.name AS dn, e.kind FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.id = e.to_id), el AS (SELECT DISTINCT a.path AS sp, a.name AS sn, b.path AS dp, b.name AS dn, e.kind FROM edges e JOIN symbols a ON a.id = e.from_id JOIN symbols b ON b.id = e.to_id WHERE e.confidence >= 0.9)"


@query(f"WITH {E}, {S}, {_ED}, i AS (SELECT count(*) AS n FROM (SELECT * FROM ek INTERSECT SELECT * FROM el)), u AS (SELECT count(*) AS n FROM (SELECT * FROM ek UNION SELECT * FROM el)) SELECT round(i.n / u.n::DOUBLE, 9) AS jaccard, i.n AS n_both, u.n AS n_any FROM i, u")
def edge_stability(spark, d):
    """All edges against those of high confidence, keyed by names and paths."""
    s, e = views.symbols(spark, d), views.edges(spark, d)
    return drift.edge_stability(s, e, s, e.where("confidence >= 0.9")).withColumn("jaccard", F.round("jaccard", 9))


@query(f"""WITH {E}, {S}, {_SNAP}, {_JAC}, {_STAB}, {_ATT}, m AS (SELECT round(ji.n / ju.n::DOUBLE, 4) AS m1, round(stable, 4) AS m2, 1.0::DOUBLE AS m3, rowid_only, fnk, fnk_with_path_fallback, (SELECT count(*) FROM sb) - (SELECT count(*) FROM sa) AS m6 FROM ji, ju, st, att)
SELECT *, CASE WHEN NOT (fnk >= 0.99 AND m3 >= 0.99) THEN 'drifting' WHEN m6 = 0 THEN 'stable' ELSE 'inconclusive' END AS decision FROM m""")
def drift_decision(spark, d):
    a, b = _snapshots(spark, d)
    none = spark.createDataFrame([], "from_id long, to_id long, kind string, confidence double")
    return drift.decide(drift.summary(drift.pair_metrics(a, none, b, none)))
