"""Benchmark passages in training documents (operator 8): seeds that no alignment does without, then local alignment.

Texts are normalised byte by byte: A-Z lower-cased, every other ASCII sign that is no letter or
digit a blank; words are what stands between blanks.

1. Seeds are the neighbouring words of items; a text holds one where the two stand together or one
   word apart.  An alignment of score t or more with an item of n words holds ``least_seeds`` of
   them, on diagonals no further apart than ``drift``: every word of an item that is left out and
   every word put in costs score.  Where that is none at all, single words are the seeds.
   One pass counts the documents of each seed; of the seeds found in more than ``rare_df``
   documents an item leaves out the commonest, at most half of ``least_seeds``, and is then looked
   for by as many fewer.  No alignment is lost by this, whatever the number of copies.
2. A second pass finds the seeds in every document.  Enough hits of an item on near diagonals make
   one passage, with a margin on either side; a long one is looked at in overlapping parts.
3. Passage and item are aligned by Smith-Waterman over words (match 2, mismatch and gap -1), many
   at a time; the score is divided by that of a perfect copy, so edits, insertions and omissions
   lower it gradually.  Pairs that reach ``least_score`` are reported.

Items are the stated query set: they go to the executors in blocks of at most ``BLOCK_WORDS``
words, counted beforehand; more items mean more blocks, not a larger broadcast.  Documents never
move: either pass is a scan, and only counts of seeds are shuffled.

Edge cases: null and wordless texts give nothing, as do items of fewer than ``SHORTEST`` words; rows
with a null id are left out; repeated item rows count once; rows that share a doc_id are looked at
each and the best score per pair is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import state
from . import textcore as tc

SHORTEST, MATCH, MISS, GAP = 3, 2, -1, -1
BLOCK_WORDS = 500_000
#: Hits of seeds in texts looked at together, or those of one text.
MOST_HITS = 2_000_000
NORMAL = tc.LOWER.copy()
NORMAL[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("begin_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("n_seeds", T.IntegerType())])


def least_seeds(n: np.ndarray, least_score: float) -> np.ndarray:
    """How many seeds an alignment of that score holds at least, with an item of n words.

    Of m matched words m - 1 are followed by another.  The score 2m less the costs is 2tn or more
    (t = least_score).  If x steps pass over words of the item (x <= n - m, each costs 1 or more) and
    y steps pass over two or more words of the text only (each costs 2 or more), then
    x + 2y <= 2m - 2tn, and all other steps are seeds: m - 1 - x - y >= (4t - 1)n / 3 - 1.
    """
    return np.ceil((4 * least_score - 1) * n / 3 - 1 - 1e-9).astype(np.int64)


def drift(n: np.ndarray, least_score: float) -> np.ndarray:
    """How far apart the diagonals of an alignment of that score are at most: each step aside costs 1 of the 2n(1 - t) there are."""
    return np.floor(2 * n * (1 - least_score) + 1e-9).astype(np.int64)


def grams(h: np.ndarray, woff: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a word and the one `gap` places on inside documents; of single words if gap is 0."""
    at = np.flatnonzero(tc.window_starts(woff, gap + 1))
    return at, tc.mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + gap]) if gap else tc.mix(h[at] + np.uint64(1))


class Seeds:
    """A sorted list of hashes that most other hashes are told apart from by one table look-up."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(16, int(len(hashes)).bit_length() + 7)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that hold a seed, and which."""
        near = np.flatnonzero(self.maybe[(h & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        hit = self.hashes[where] == h[near]
        return near[hit], where[hit]

    def places(self, h: np.ndarray, woff: np.ndarray, gaps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, positions and numbers of the seeds in texts, by position."""
        got = [(at[near], s) for at, g in (grams(h, woff, gap) for gap in gaps) for near, s in (self.find(g),)]
        pos, seed = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(pos, kind="stable")
        pos = pos[order]
        return np.searchsorted(woff, pos, "right") - 1, pos, seed[order]


def portions(doc: np.ndarray, many: np.ndarray):
    """Runs [a, b) of entries, of whole documents, with at most MOST_HITS hits, or one document with more."""
    total, a = np.cumsum(many), 0
    while a < len(doc):
        b = int(np.searchsorted(total, total[a] - many[a] + MOST_HITS, "right"))
        b = len(doc) if b >= len(doc) else int(np.searchsorted(doc, doc[b]))
        b = b if b > a else int(np.searchsorted(doc, doc[a], "right"))
        yield a, b
        a = b


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score of each pair, and the ends (exclusive) of that alignment in item and passage."""
    n, rows, cols = len(items), max(map(len, items)), max(map(len, passages))
    a = np.zeros((n, rows), np.uint64)
    b = np.zeros((n, cols), np.uint64)
    real = np.zeros((n, cols), bool)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], b[i, : len(y)], real[i, : len(y)] = x, y, True
    size = np.array([len(x) for x in items])
    h = np.zeros((n, cols + 1), np.int32)
    j = np.arange(cols + 1, dtype=np.int32) * -GAP
    best, end_a, end_b = (np.zeros(n, np.int64) for _ in range(3))
    for r in range(rows):
        new = np.zeros_like(h)
        step = np.where((b == a[:, r][:, None]) & real, MATCH, MISS)
        np.maximum(h[:, :-1] + step, h[:, 1:] + GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + j, axis=1) - j
        h[:, 1:][~real] = 0
        top = h.argmax(axis=1)
        value = h[np.arange(n), top]
        up = (value > best) & (r < size)
        best[up], end_a[up], end_b[up] = value[up], r + 1, top[up]
    return best, end_a, end_b


def align(items: list[np.ndarray], passages: list[np.ndarray], batch: int = 128):
    """Score, and begin and end of the aligned part of the passage, for each pair."""
    score, begin, end = (np.zeros(len(items), np.int64) for _ in range(3))
    order = np.argsort([len(x) * 10_000 + len(y) for x, y in zip(items, passages, strict=True)], kind="stable")
    for k in range(0, len(order), batch):
        part = order[k : k + batch]
        s, ea, eb = smith_waterman([items[i] for i in part], [passages[i] for i in part])
        back = [(items[i][: max(x, 1)][::-1], passages[i][: max(y, 1)][::-1]) for i, x, y in zip(part, ea, eb, strict=True)]
        _, _, rb = smith_waterman([x for x, _ in back], [y for _, y in back])
        score[part], end[part], begin[part] = s, eb, np.maximum(eb - rb, 0)
    return score, begin, end


def _block(spark, docs: DataFrame, items: list[tuple[int, str]], key: str, text: str, rare_df: int, least_score: float) -> DataFrame | None:
    buf, off = tc.flat(pa.array([t for _, t in items], pa.string()))
    h, woff = tc.word_hashes(NORMAL[buf], off)
    size = np.diff(woff)
    need = least_seeds(size, least_score)
    single = (need < 1) & (size >= SHORTEST)
    parts = [grams(h, woff, 1), grams(h, woff, 0)]
    of = [np.searchsorted(woff, at, "right") - 1 for at, _ in parts]
    use = [(size[of[0]] >= SHORTEST) & ~single[of[0]], single[of[1]]]
    at, g, item = (np.concatenate([x[u] for x, u in zip(v, use, strict=True)]) for v in ((parts[0][0], parts[1][0]), (parts[0][1], parts[1][1]), of))
    if not len(g):
        return None
    need = np.maximum(need, 1)
    gaps = (1, 2) + ((0,) if single.any() else ())
    offset = at - woff[item]
    seeds = np.unique(g)
    which = np.searchsorted(seeds, g)
    shipped = spark.sparkContext.broadcast(seeds)

    def count(batches):
        index = Seeds(shipped.value)
        for batch in tc.each(batches):
            b, o = tc.flat(batch.column(0))
            total = np.zeros(len(index.hashes), np.int64)
            for x, y in tc.slabs(o):
                doc, _, s = index.places(*tc.word_hashes(NORMAL[b[o[x] : o[y]]], o[x : y + 1] - o[x]), gaps)
                total += np.bincount(np.unique(doc * len(total) + s) % len(total), minlength=len(total))
            s = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(total[s])], ["seed", "n"])

    df = np.zeros(len(seeds), np.int64)
    for r in docs.select(text).mapInArrow(count, "seed int, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect():
        df[r["seed"]] = r["n"]
    order = np.lexsort((offset, -df[which], item))
    rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    out = (rank < need[item[order]] // 2) & (df[which[order]] > rare_df)
    need -= np.bincount(item[order[out]], minlength=len(need))
    use = order[~out]
    use = use[np.argsort(which[use], kind="stable")]
    kept, begins = np.unique(which[use], return_index=True)
    words = [h[a:b] for a, b in zip(woff[:-1], woff[1:], strict=True)]
    told = spark.sparkContext.broadcast((seeds[kept], np.append(begins, len(use)), item[use], offset[use], words, need))

    def scan(batches):
        hashes, begins, of, offsets, words, need = told.value
        index = Seeds(hashes)
        size = np.array([len(v) for v in words], np.int64)
        far = drift(size, least_score)
        for batch in tc.each(batches):
            ids = batch.column(0).to_pylist()
            b, o = tc.flat(batch.column(1))
            rows, mine, theirs = [], [], []
            for x, y in tc.slabs(o):
                hs, w = tc.word_hashes(NORMAL[b[o[x] : o[y]]], o[x : y + 1] - o[x])
                at_doc, at, seed = index.places(hs, w, gaps)
                each = begins[seed + 1] - begins[seed]
                for lo, hi in portions(at_doc, each):
                    many, first = each[lo:hi], begins[seed[lo:hi]]
                    entry = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    doc, it = np.repeat(at_doc[lo:hi], many), of[entry]
                    pos = np.repeat(at[lo:hi], many)
                    diagonal = pos - offsets[entry]
                    order = np.lexsort((diagonal, it, doc))
                    doc, it, diagonal, pos = doc[order], it[order], diagonal[order], pos[order]
                    # a hit counts where enough others of its item are as near as one alignment's can be
                    last = np.arange(len(doc)) + need[it] - 1
                    there = np.minimum(last, len(doc) - 1)
                    full = np.flatnonzero((last < len(doc)) & (doc[there] == doc) & (it[there] == it) & (diagonal[there] - diagonal <= far[it]))
                    live = np.zeros(len(doc) + 1, np.int64)
                    np.add.at(live, full, 1)
                    np.add.at(live, last[full] + 1, -1)
                    live = np.cumsum(live[:-1]) > 0
                    doc, it, diagonal, pos = doc[live], it[live], diagonal[live], pos[live]
                    if not len(doc):
                        continue
                    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (it[1:] != it[:-1]) | (np.diff(diagonal) > far[it[1:]]))))
                    for a, e in zip(cut, [*cut[1:], len(doc)], strict=True):
                        d, k = int(doc[a]), int(it[a])
                        start = max(int(w[d]), int(diagonal[a]) - int(far[k]))
                        end = min(int(w[d + 1]), int(diagonal[e - 1]) + int(size[k] + far[k]))
                        span = int(size[k] + far[k])
                        for begin in range(start, max(end - span, start + 1), 3 * span):
                            passage = hs[begin : min(begin + 4 * span, end)]
                            if np.isin(words[k], passage).sum() >= least_score * size[k] - 1e-9:
                                inside = int(((pos[a:e] >= begin) & (pos[a:e] < begin + len(passage))).sum())
                                rows.append((ids[x + d], k, begin - int(w[d]), inside))
                                mine.append(words[k])
                                theirs.append(passage)
            out = {f.name: [] for f in FOUND.fields}
            if rows:
                score, begin, end = align(mine, theirs)
                for (who, k, lo, n), s, x, y, v in zip(rows, score, begin, end, mine, strict=True):
                    if s >= least_score * MATCH * len(v):
                        for name, value in zip(out, (who, k, float(s) / (MATCH * len(v)), lo + int(x), lo + int(y), int(n)), strict=True):
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("item", pa.int32()), ("score", pa.float64()), ("begin_word", pa.int64()), ("end_word", pa.int64()), ("n_seeds", pa.int32())]))

    return docs.select(F.col(key).cast("long"), text).mapInArrow(scan, FOUND)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rare_df: int = 100, least_score: float = 0.5) -> DataFrame:
    """One row per document and item whose best alignment reaches `least_score`: key, item_key, score, where, seeds."""
    spark = docs.sparkSession
    state.tune(spark)
    docs = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    clean = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(item_key, item_text).distinct()
    total = clean.agg(F.sum(F.size(F.split(item_text, r"\s+"))).alias("n")).first()["n"] or 0
    blocks = int(total) // BLOCK_WORDS + 1
    kind = items.schema[item_key].dataType
    found = None
    for k in range(blocks):
        part = [(r[0], r[1]) for r in clean.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == k).orderBy(item_key, item_text).collect()]
        got = _block(spark, docs, part, key, text, rare_df, least_score) if part else None
        if got is not None:
            names = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(part)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField(item_key, kind)]))
            got = got.join(F.broadcast(names), "item").drop("item")
            found = got if found is None else found.unionByName(got)
    shape = T.StructType([T.StructField(key, T.LongType()), T.StructField(item_key, kind), *FOUND.fields[2:]])
    if found is None:
        return spark.createDataFrame([], shape)
    best = found.withColumnRenamed("doc_id", key).groupBy(key, item_key).agg(F.max(F.struct("score", (-F.col("begin_word")).alias("b"), "end_word", "n_seeds")).alias("m"))
    return best.select(key, item_key, "m.score", (-F.col("m.b")).alias("begin_word"), "m.end_word", "m.n_seeds")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("score", F.round("score", 6))
