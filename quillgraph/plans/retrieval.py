"""Retrieval queries: BM25, cosine, fusion, hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as vx
from ..operators import evaluate
from ..operators import retrieval as rt
from . import views
from .registry import query

#: The questions that the retrieval queries ask: id, text, and the vector they stand for.
QUESTIONS = [("q1", "tion the", 0), ("q2", "of_the src0", 7), ("q3", "der und ver", 42), ("q4", "the", 100), ("q5", "Apache License", 250)]


def questions(spark):
    return spark.createDataFrame([(q, t) for q, t, _ in QUESTIONS], "qid string, query string")


def embedded(spark, d):
    """The vectors, as symbols."""
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def question_vectors(spark, d):
    q = spark.createDataFrame([(q, t, v) for q, t, v in QUESTIONS], "qid string, query string, id long")
    return q.join(embedded(spark, d).select("id", "embedding"), "id").select("qid", "query", "embedding")


def _phrases(text: str) -> list[list[str]]:
    return [w.lower().split("_") for w in text.split()]


_W = "CASE col WHEN 'name' THEN 10.0 WHEN 'search_blob' THEN 5.0 ELSE 1.0 END"


def bm25_sql(questions: list[tuple[str, str]]) -> str:
    """CTEs that end in bm(qid, id, bm25_score)."""
    cols = ("name", "snippet", "kind", "search_blob")
    toks = " UNION ALL ".join(f"SELECT id, '{c}' AS col, regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+') AS t FROM symbols" for c in cols)
    parts = []
    for qid, text in questions:
        for i, p in enumerate(_phrases(text)):
            joins = "".join(f" JOIN tok t{k} ON t{k}.id = t0.id AND t{k}.col = t0.col AND t{k}.pos = t0.pos + {k} AND t{k}.term = '{w}'" for k, w in enumerate(p) if k)
            parts.append(f"SELECT '{qid}' AS qid, {i} AS phrase, t0.id, t0.col FROM tok t0{joins} WHERE t0.term = '{p[0]}'")
    return f"""{views.DOCUMENTS}, arr AS ({toks}),
tok AS (SELECT id, col, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM arr),
dl AS (SELECT id, CAST(sum(len(t)) AS DOUBLE) AS dl FROM arr GROUP BY id),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
occ AS ({' UNION ALL '.join(parts)}),
tf AS (SELECT qid, phrase, id, CAST(sum({_W}) AS DOUBLE) AS f FROM occ GROUP BY qid, phrase, id),
df AS (SELECT qid, phrase, count(*) AS n_p FROM tf GROUP BY qid, phrase),
bm AS (SELECT tf.qid, tf.id, sum((CASE WHEN ln((n - n_p + 0.5) / (n_p + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n_p + 0.5) / (n_p + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))) AS bm25_score
  FROM tf JOIN df USING (qid, phrase) JOIN dl USING (id), st GROUP BY tf.qid, tf.id)"""


def vec_sql(questions: list[tuple[str, int]]) -> str:
    """CTEs that end in vec(qid, id, vector_score)."""
    q = ", ".join(f"('{a}', {b})" for a, b in questions)
    return f"""qv AS (SELECT qid, embedding AS qe FROM (VALUES {q}) t(qid, vec_id) JOIN embeddings USING (vec_id)),
vec AS (SELECT qid, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS vector_score FROM embeddings, qv)"""


def _ranked(name: str, score: str, rank: str) -> str:
    return f"{name}_r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round({score}, 9) DESC, id) AS {rank} FROM {name}) WHERE {rank} <= 50)"


_ALL = [(q, t) for q, t, _ in QUESTIONS]
_FUSED = f"""{bm25_sql(_ALL)}, {vec_sql([(q, v) for q, _, v in QUESTIONS])}, {_ranked('bm', 'bm25_score', 'bm25_rank')}, {_ranked('vec', 'vector_score', 'vector_rank')},
fused AS (SELECT qid, id, bm25_rank, vector_rank, bm25_score, vector_score, coalesce(0.4 / (60 + bm25_rank), 0) + coalesce(0.6 / (60 + vector_rank), 0) AS rrf_score FROM bm_r FULL JOIN vec_r USING (qid, id))"""


@query("SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    """The ten nearest to vector 0."""
    e = embedded(spark, d)
    q = e.where("id = 0").select(F.lit("q").alias("qid"), "embedding")
    return rt.cosine_scores(e, q).orderBy(F.desc("vector_score"), "id").limit(10).select("id", F.round("vector_score", 6).alias("score"))


@query("""WITH s AS (SELECT q.vec_id AS qid, e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS x FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(x, 9) DESC, id) AS rank FROM s) SELECT qid, id, rank, round(x, 6) AS score FROM r WHERE rank <= 10""")
def vector_topk_batch(spark, d):
    """The ten nearest to each query vector; the queries are the ids divisible by 50, searched against all."""
    e = embedded(spark, d)
    q = e.where(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), "embedding")
    return rt.ranked(rt.nearest(e, q, 10), "vector_score", "rank", 10).select("qid", "id", "rank", F.round("vector_score", 6).alias("score"))


@query(f"WITH {bm25_sql([('q', 'retion')])} SELECT id, round(bm25_score, 6) AS score FROM bm")
def bm25_single(spark, d):
    """Every document that holds one word, scored."""
    q = spark.createDataFrame([("q", "retion")], "qid string, query string")
    return rt.bm25(views.documents(spark, d), q).select("id", F.round("bm25_score", 6).alias("score"))


@query(f"WITH {bm25_sql([('q', 'of_the')])} SELECT id, round(bm25_score, 6) AS score FROM bm")
def bm25_phrase(spark, d):
    """Two words next to each other."""
    q = spark.createDataFrame([("q", "of_the")], "qid string, query string")
    return rt.bm25(views.documents(spark, d), q).select("id", F.round("bm25_score", 6).alias("score"))


@query(f"WITH {bm25_sql(_ALL)} SELECT qid, id, round(bm25_score, 6) AS score FROM bm")
def bm25_weighted(spark, d):
    """All questions at once over weighted columns."""
    return rt.bm25(views.documents(spark, d), questions(spark)).select("qid", "id", F.round("bm25_score", 6).alias("score"))


def _lists(spark, d):
    bm = rt.ranked(rt.bm25(views.documents(spark, d), questions(spark)), "bm25_score", "bm25_rank")
    vec = rt.ranked(rt.cosine_scores(embedded(spark, d), question_vectors(spark, d)), "vector_score", "vector_rank")
    return bm, vec


@query(f"WITH {_FUSED} SELECT qid, id, bm25_rank, vector_rank, round(rrf_score, 9) AS rrf_score FROM fused")
def rrf_fusion(spark, d):
    """Both ranked lists of every question, fused."""
    return rt.rrf(*_lists(spark, d)).select("qid", "id", "bm25_rank", "vector_rank", F.round("rrf_score", 9).alias("rrf_score"))


@query(f"""WITH {_FUSED}, top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf_score, 9) DESC, id) AS rank FROM fused)
SELECT t.qid, t.rank, t.id, s.name, s.kind, s.path, round(t.rrf_score, 9) AS score FROM top t JOIN symbols s USING (id) WHERE t.rank <= 5""")
def hybrid_search(spark, d):
    """The five best documents for every question: text and vectors, fused."""
    best = rt.hybrid(views.documents(spark, d), question_vectors(spark, d), vectors=embedded(spark, d))
    return best.select("qid", "rank", "id", "name", "kind", "path", F.round("rrf_score", 9).alias("score"))


@query(f"WITH {_FUSED} SELECT qid, CASE WHEN max(rrf_score) IS NULL OR max(rrf_score) < 0.012 THEN 1.0 ELSE -0.25 END::DOUBLE AS score FROM fused GROUP BY qid")
def negative_gate(spark, d):
    """What every question would score if nothing should be found."""
    return rt.rrf(*_lists(spark, d)).groupBy("qid").agg(evaluate.negative_score(F.max("rrf_score")).alias("score"))


@query("""WITH p AS (SELECT a.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
s AS (SELECT list_sort(list(x)) AS l, avg(x) AS mean, count(*) AS n FROM p)
SELECT round(l[CAST(least(floor(0.1 * n), n - 1) AS BIGINT) + 1], 6) AS p10, round(l[CAST(least(floor(0.5 * n), n - 1) AS BIGINT) + 1], 6) AS p50, round(l[CAST(least(floor(0.9 * n), n - 1) AS BIGINT) + 1], 6) AS p90, round(mean, 6) AS mean, n, mean >= 0.97 AND l[CAST(least(floor(0.1 * n), n - 1) AS BIGINT) + 1] >= 0.95 AS passes FROM s""")
def embed_gate_percentiles(spark, d):
    """Each vector against the next as if it were its re-embedding: the equivalence gate's figures."""
    e = embedded(spark, d).select("id", F.lit("symbol").alias("role"), "embedding")
    nxt = e.select((F.col("id") - 1).alias("id"), "role", "embedding")
    got = evaluate.equivalence_gate(e.join(nxt.select("id"), "id", "left_semi"), nxt, vx.cosine)
    return got.select(*[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90", "mean")], "n", "passes")
