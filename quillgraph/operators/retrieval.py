"""Weighted BM25 with phrases, cosine top-k, reciprocal-rank fusion and hybrid search, for many queries in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx
from . import ranking
from .state import cut

#: Columns in the order that fixes their weights, and the scores' constants.
WEIGHTS = {"name": 10.0, "snippet": 1.0, "kind": 1.0, "search_blob": 5.0}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
POOL, RRF_C, ALPHA = 50, 60, 0.6
QUERY_BLOCK = 4096
MOST_TERMS, MOST_PHRASES = 1000, 64


@dataclass(frozen=True)
class Index:
    """What a full-text search reads: postings (term, id, col, pos) and lengths (id, dl)."""

    postings: DataFrame
    lengths: DataFrame


def lengths(symbols: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """id and its token count over all searched columns."""
    total = sum((F.size(tx.tokens(F.col(c))) for c in weights), F.lit(0))
    return symbols.select("id", total.cast("long").alias("dl"))


def postings(symbols: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """term, id, col, pos for every token; a store keeps them sorted by term, so that a search reads its own terms alone."""
    each = F.array(*[F.struct(F.lit(c).alias("col"), tx.tokens(F.col(c)).alias("terms")) for c in weights])
    rows = symbols.select("id", F.explode(each).alias("x")).select("id", "x.col", F.posexplode("x.terms").alias("pos", "term"))
    return rows.select("term", "id", "col", "pos")


def _counted(symbols: DataFrame, phrases: list[list[str]], weights: dict[str, float]) -> DataFrame:
    """id, dl and for each phrase its weighted count in the row, from one pass over the rows that sends nothing around: each text is cut into tokens once."""
    split = symbols.select("id", *[tx.tokens(F.col(c)).alias(c) for c in weights])
    terms = sorted({t for p in phrases for t in p})

    def spots(c: str, w: float) -> Column:
        every = F.transform(F.col(c), lambda t, i: F.struct(t.alias("term"), F.lit(c).alias("col"), i.alias("pos"), F.lit(float(w)).alias("w")))
        return F.filter(every, lambda x: x["term"].isin(terms))

    def count(kept: Column, phrase: list[str]) -> Column:
        def here(x: Column, i: Column) -> Column:
            out = x["term"] == phrase[0]
            for k, term in enumerate(phrase[1:], 1):
                y = F.get(kept, i + k)
                out &= F.coalesce((y["term"] == term) & (y["col"] == x["col"]) & (y["pos"] == x["pos"] + k), F.lit(False))
            return out

        return F.aggregate(F.filter(kept, here), F.lit(0.0), lambda f, x: f + x["w"])

    kept = F.array(F.concat(*[spots(c, w) for c, w in weights.items()]))  # bound once for all phrases
    f = F.transform(kept, lambda x: F.array(*[count(x, p) for p in phrases]))[0]
    return split.select("id", sum((F.size(c) for c in weights), F.lit(0)).cast("long").alias("dl"), f.alias("f"))


def _part(idf: Column, f: Column, dl: Column, avgdl: Column) -> Column:
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def _idf(n_rows: Column, n_p: Column) -> Column:
    idf = F.log((n_rows - n_p + 0.5) / (n_p + 0.5))
    return F.when(idf <= 0, IDF_FLOOR).otherwise(idf)


def _scored(symbols: DataFrame, asked: list, weights: dict[str, float], kind) -> DataFrame:
    """BM25 of rows that are not indexed, for phrases (qid, phrase, terms) that are few: what is sent around is a count for each phrase."""
    phrases = [list(p) for p in sorted({tuple(r["terms"]) for r in asked})]
    rows = cut(_counted(symbols, phrases, weights))
    f = [F.col("f")[i] for i in range(len(phrases))]
    stats = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("dl").alias("avgdl"), F.array(*[F.count_if(x > 0) for x in f]).alias("n_p"))
    each = [F.when(x > 0, _part(_idf(F.col("n_rows"), F.col("n_p")[i]), x, F.col("dl"), F.col("avgdl"))).otherwise(0.0) for i, x in enumerate(f)]
    scores = rows.crossJoin(F.broadcast(stats)).select("id", F.array(*each).alias("each"))
    queries: dict = {}
    for r in asked:
        queries.setdefault(r["qid"], []).append(phrases.index(list(r["terms"])))
    hits = F.array(*[F.struct(F.lit(q).cast(kind).alias("qid"), sum((F.col("each")[i] for i in ps), F.lit(0.0)).alias("bm25_score")) for q, ps in queries.items()])
    return scores.where("id IS NOT NULL").select("id", F.inline(F.filter(hits, lambda x: x["bm25_score"] > 0))).select("qid", "id", "bm25_score")


def bm25(symbols: DataFrame | Index, queries: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """qid, id, bm25_score for rows that hold any phrase of a query (qid, query).

    A phrase's tokens stand next to each other in one column.  Only postings of the queries' terms are
    read, from a stored index by a filter that reaches its files, from symbols in one pass; statistics
    come from the live rows, so nothing deleted is ever counted.  The queries are a stated set: up to
    ``MOST_TERMS`` of their terms are named in the plan, and up to ``MOST_PHRASES`` of their phrases are
    counted where the rows are; more are joined.
    """
    phrases = queries.select("qid", F.posexplode(tx.fts_phrases(F.col("query"))).alias("phrase", "terms"))
    asked = phrases.limit(MOST_PHRASES + 1).collect()
    if not isinstance(symbols, Index) and 0 < len(asked) <= MOST_PHRASES:
        return _scored(symbols, asked, weights, queries.schema["qid"].dataType)
    wanted = phrases.select("qid", "phrase", F.size("terms").alias("k"), F.posexplode("terms").alias("i", "term"))
    terms = [r["term"] for r in wanted.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    few = len(terms) <= MOST_TERMS
    index = symbols if isinstance(symbols, Index) else Index(postings(symbols, weights), lengths(symbols, weights))
    hits = index.postings.where(F.col("term").isin(terms)) if few else index.postings
    weight = F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(float(w)))])
    # a frequent term has many postings: they stay where they are and meet the few terms there, and what is counted by id is dealt by id
    spots = hits.join(F.broadcast(wanted) if few else wanted, "term")
    one = spots.where("k = 1").groupBy("qid", "phrase", "id").agg(F.sum(weight[F.col("col")]).alias("f"))
    more = spots.where("k > 1").withColumn("base", F.col("pos") - F.col("i")).select("qid", "phrase", "k", "id", "col", "base").repartition("id")
    found = more.groupBy("qid", "phrase", "k", "id", "col", "base").agg(F.count(F.lit(1)).alias("n")).where("n = k")
    tf = cut(one.unionByName(found.groupBy("qid", "phrase", "id").agg(F.sum(weight[F.col("col")]).alias("f"))))
    df = tf.groupBy("qid", "phrase").agg(F.count(F.lit(1)).alias("n_p"))
    dl = index.lengths
    stats = dl.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("dl").alias("avgdl"))
    scored = tf.join(F.broadcast(df) if few else df, ["qid", "phrase"]).join(dl, "id").crossJoin(F.broadcast(stats))  # stats is one row
    part = _part(_idf(F.col("n_rows"), F.col("n_p")), F.col("f"), F.col("dl"), F.col("avgdl"))
    return scored.groupBy("qid", "id").agg(F.sum(part).alias("bm25_score"))


def cosine_scores(symbols: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """qid, id, vector_score of every row for every query vector.

    The queries are a stated set: they are counted and sent to the rows in blocks of at most `block`, so no broadcast grows with them.
    """
    q = queries.select("qid", F.col("embedding").alias("q_embedding"), vx.norm(F.col("embedding")).alias("q_norm"))
    rows = symbols.select("id", "embedding", vx.norm(F.col("embedding")).alias("norm"))
    blocks = max(1, -(-q.count() // block))
    cosine = vx.cosine(F.col("embedding"), F.col("q_embedding"), F.col("norm"), F.col("q_norm"))
    score = lambda part: rows.crossJoin(F.broadcast(part)).select("qid", "id", cosine.alias("vector_score"))
    out = None
    for i in range(blocks):
        part = score(q if blocks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i))
        out = part if out is None else out.unionByName(part)
    return out


def _packed(df: DataFrame, id_: str, most: int) -> DataFrame:
    """n, dim, ids, data: vectors of one length (id, embedding) as matrices of at most `most` rows."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            ids, rows = held.pop(dim)
            return pa.RecordBatch.from_pydict({"n": [len(ids)], "dim": [dim], "ids": [np.array(ids, np.int64).tobytes()], "data": [np.concatenate(rows).tobytes()]}, schema=pa.schema([("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            keys, vectors = batch.column(0).to_pylist(), batch.column(1)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(sizes)))
            for i, dim in enumerate(sizes.tolist()):
                ids, rows = held.setdefault(dim, ([], []))
                ids.append(keys[i])
                rows.append(flat[at[i] : at[i + 1]])
                if len(ids) == most:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return df.select(F.col(id_).cast("long"), "embedding").mapInArrow(run, "n int, dim int, ids binary, data binary")


def nearest(symbols: DataFrame, queries: DataFrame, k: int, rows: int = 1 << 15, block: int = 512) -> DataFrame:
    """qid, id, vector_score of candidates that hold the k nearest of each query by `ranked`: all pairs, multiplied as matrices.

    Each matrix of rows meets each matrix of queries and gives for each query its k best by (score to nine digits, id).
    Vectors without a length in common, empty or null ones, and those with numbers that are null or not finite go the
    way of `cosine_scores`.  Ids are whole numbers.
    """
    plain = F.coalesce(F.size("embedding") > 0, F.lit(False)) & ~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    sized = symbols.select("id", "embedding", F.when(plain, F.size("embedding")).alias("dim"))
    asked = queries.select("qid", "embedding", F.when(plain, F.size("embedding")).alias("dim"))
    dims = [r["dim"] for r in sized.select("dim").unionByName(asked.select("dim")).distinct().limit(2).collect()]
    if len(dims) != 1 or dims[0] is None:
        return cosine_scores(symbols, queries)
    spread = asked.withColumnRenamed("qid", "id").repartition(asked.sparkSession.sparkContext.defaultParallelism)
    q = _packed(spread, "id", block).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    pairs = _packed(sized, "id", rows).join(q.hint("shuffle_replicate_nl"), "dim")

    def run(batches):
        def unit(data, dim):
            m = np.frombuffer(data, np.float64).reshape(-1, dim)
            return m, np.sqrt((m * m).sum(axis=1))

        for batch in batches:
            for i in range(len(batch)):
                dim, ids, data, q_ids, q_data = (batch.column(c)[i].as_py() for c in range(5))
                (a, na), (b, nb) = unit(data, dim), unit(q_data, dim)
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                found = []
                for j in range(len(q_ids)):
                    if j % 16 == 0:
                        tile = b[j : j + 16] @ a.T / np.maximum(nb[j : j + 16, None] * na, 1e-12)
                    x = tile[j % 16]
                    least = np.partition(x, len(x) - k)[len(x) - k] - 2e-9 if len(x) > k else -np.inf
                    near = np.flatnonzero(x >= least)
                    near = near[np.lexsort((ids[near], -np.round(x[near], 9)))[:k]]
                    found.append((np.full(len(near), q_ids[j]), ids[near], x[near]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["qid", "id", "vector_score"])

    return pairs.select("dim", "ids", "data", "q_ids", "q_data").mapInArrow(run, "qid long, id long, vector_score double")


def ranked(scores: DataFrame, score: str, rank: str, k: int = POOL) -> DataFrame:
    """The k best of each query.  Scores rank by nine digits: sums of doubles differ in the last ones with their order, and such ties go by id."""
    return ranking.top_k(scores, ["qid"], [F.desc(F.round(score, 9)), F.asc("id")], k, rank)


def rrf(bm: DataFrame, vec: DataFrame, alpha: float = ALPHA, c: int = RRF_C) -> DataFrame:
    """Union of two ranked lists (qid, id, bm25_rank / vector_rank) by alpha-weighted reciprocal ranks; a list that lacks an id adds nothing."""
    term = lambda rank, w: F.coalesce(F.lit(w) / (F.lit(c) + F.col(rank)), F.lit(0.0))
    both = bm.join(vec, ["qid", "id"], "full_outer")
    return both.withColumn("rrf_score", term("bm25_rank", 1.0 - alpha) + term("vector_rank", float(alpha)))


def hybrid(symbols: DataFrame, queries: DataFrame, k: int = 5, alpha: float = ALPHA, reranker: Callable[[Column, Column], Column] | None = None, pool: int = POOL, index: Index | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Ranked hits of every query (qid, query, embedding): qid, rank, id, scores, and the symbol's columns.

    The text side reads `index` if there is one, the vector side `vectors` (id, embedding) if they are
    kept apart from the symbols.  `reranker` scores (query, document) pairs of the candidate pool; without one the fused order stands.
    """
    bm = ranked(bm25(index or symbols, queries), "bm25_score", "bm25_rank", pool)
    vec = ranked(cosine_scores(symbols if vectors is None else vectors, queries), "vector_score", "vector_rank", pool)
    fused = rrf(bm, vec, alpha)
    keep = max(pool, k) if reranker else k
    best = ranked(fused, "rrf_score", "rank", keep)
    hits = best.join(symbols.drop("embedding"), "id")
    hits = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    if reranker:
        hits = hits.join(queries.select("qid", "query"), "qid")
        hits = hits.withColumn("rerank_score", reranker(F.col("query"), tx.embed_text(F.col("kind"), F.col("name"), F.col("snippet"))).cast("double")).drop("query")
        hits = ranking.top_k(hits.drop("rank"), ["qid"], [F.desc("rerank_score"), F.asc("id")], k, "rank")
    return hits.withColumn("score", F.coalesce("rerank_score", "rrf_score"))


def hit_view(hits: DataFrame) -> DataFrame:
    """What a caller of `query` sees."""
    return hits.select("qid", "rank", "id", "kind", "name", "path", "start_line", "end_line", "snippet", "score")
