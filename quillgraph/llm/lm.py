"""Language-model scores (operator 6): log10 probability of every text, against a unigram baseline.

Learning covers the documents whose crc32(id as text) mod 7 is not 2.  Word counts (the baseline)
and counts of neighbouring subwords (the model's classes, prior and token probabilities) are taken
over all of them: groups count their distinct words and pairs, these meet by hash in buckets, and
each group is told the totals of its own words alone.  Texts are shuffled and cut into words and
subwords once; the groups' numbers for them are written to the shared folder.  All weights,
embeddings and attention included, are learned from every token of every learning document, long
ones included, in a few rounds: each group goes over the documents whose turn it is, and the
groups' mean by blocks is where the next round begins.  Nothing is drawn as a sample.

Scoring is one pass over groups: every text whole, in overlapping windows, each token once.  What
goes to the executors is the model (classes, weights, one number per vocabulary entry).

Edge cases: null and empty texts are one end token; without learning documents every count is 0
and the model is the untrained one; rows with a null id are left out; rows that share an id are
documents of their own; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention, corpus, packing, state
from . import textcore as tc

FOLDS, HELD_OUT = 7, 2
#: Nothing reads it: no text is too long to be learned from.  A test sets a bound here and sees that it has no effect.
SAMPLE_TEXT = None
GROUP_BYTES = 8 << 20
#: Of sixteen learning documents, the first is learned from in the first round, the second in the second, two in the third, and so on.
TURNS = (0, 1, 2, 4, 8, 16)
#: Weights of groups are added up in so many places before they reach the driver.
PLACES = 32
#: Chunks whose tokens a worker remembers: every text is tokenised twice here.
CACHE = 1_000_000
WORDS, TOTAL, PAIRS, SCORES = 1, 2, 3, 4
#: Subwords whose windows are made at once, of whole texts.
RUN = 1 << 17
OPEN = "bucket int, g int, data binary"


def held_out(ids) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids.tolist()], bool)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each entry's place among them, by a hash table."""
    code, u = pd.factorize(x)
    order = np.argsort(u)
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return u[order], place[code]


def _words(doc: corpus.Group):
    """Distinct word hashes, each word's place among them, and document starts."""
    h, woff = tc.word_hashes(doc.buf, doc.off, lower=True)
    u, inverse = _distinct(h)
    return u, inverse, woff


def _before(ids: np.ndarray, at: np.ndarray, start: int) -> np.ndarray:
    """What stands before each token; `start` before a text's first."""
    out = np.empty(len(ids), np.int64)
    out[1:] = ids[:-1]
    out[at[:-1]] = start
    return out


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of (keys, counts) pairs, and their totals."""
    u, inverse = _distinct(np.concatenate([p[0] for p in parts]))
    return u, np.rint(np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(u))).astype(np.int64)


def subwords(data: bytes):
    """(ids, text offsets, whether each text is learned from) of runs of a group's texts, about RUN ids each or one longer text."""
    ids, at, learn = corpus.unsqueeze(data, 3)
    for a, b in tc.slabs(at, RUN):
        yield ids[at[a] : at[b]].astype(np.int64), at[a : b + 1] - at[a], learn[a:b]


def counts(packed: DataFrame, plan: corpus.Plan, key: str, vocabulary: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """NOTE rows, and rows (g, data) with each group's subwords and with its documents' words.

    WORDS tells a group the counts of its words in a bucket, TOTAL a bucket's words and distinct words,
    PAIRS the counts of subwords by the one before.
    """

    def count(table: pa.Table) -> pa.Table:
        out = {"bucket": [], "g": [], "data": []}
        if doc := corpus.unpack(table, key):
            u, inverse, woff = _words(doc)
            learn = ~held_out(doc.ids)
            seen = np.bincount(inverse[np.repeat(learn, np.diff(woff))], minlength=len(u))
            for k, a, b in corpus.runs(corpus.bucket_of(u, plan.buckets)):
                out["bucket"].append(k)
                out["g"].append(doc.g)
                out["data"].append(corpus.squeeze(np.diff(u[a:b], prepend=np.uint64(0)), seen[a:b].astype(np.uint32)))
            out["bucket"].append(-2)
            out["g"].append(doc.g)
            out["data"].append(corpus.squeeze(doc.ids, woff, u, inverse.astype(np.uint32)))
            made = packing.chunks(vocabulary, CACHE)
            size = len(made.ends_word) + 1
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            every, ends = [], [np.zeros(1, np.int64)]
            for a, b in tc.slabs(doc.off):
                ids, at = made.encode(doc.buf[doc.off[a] : doc.off[b]], doc.off[a : b + 1] - doc.off[a], size - 1)
                every.append(ids.astype(np.uint16 if size <= 1 << 16 else np.uint32))
                ends.append(at[1:] + ends[-1][-1])
                narrow = np.uint32 if (size + 1) * size < 1 << 32 else np.uint64  # sorts twice as fast
                pair = _before(ids, at, size).astype(narrow) * narrow(size) + ids.astype(narrow)
                pair, n = np.unique(pair[np.repeat(learn[a:b], np.diff(at))], return_counts=True)
                parts.append((pair.astype(np.uint64), n))
            out["bucket"].append(-1)
            out["g"].append(doc.g)
            out["data"].append(corpus.squeeze(np.concatenate(every), np.concatenate(ends), learn))
            pair, n = _summed(parts)
            kind = (tc.mix(pair // np.uint64(size)) % np.uint64(plan.buckets)).astype(np.int32)
            order = np.argsort(kind, kind="stable")
            for k, a, b in corpus.runs(kind[order]):
                out["bucket"].append(plan.buckets + k)
                out["g"].append(doc.g)
                out["data"].append(corpus.squeeze(pair[order[a:b]], n[order[a:b]]))
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("data", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        bucket, groups, data = table["bucket"][0].as_py(), table["g"].to_pylist(), table["data"].to_pylist()
        if bucket >= plan.buckets:
            return corpus.notes([(-1, PAIRS, corpus.squeeze(*_summed([corpus.unsqueeze(x, 2) for x in data])))])
        parts = [corpus.unsqueeze(x, 2) for x in data]
        words = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        u, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.rint(np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(u))).astype(np.int64)
        rows = [(-1, TOTAL, np.array([total.sum(), (total > 0).sum()], np.int64).tobytes())]
        at = 0
        for g, w in zip(groups, words, strict=True):
            mine = total[inverse[at : at + len(w)]]
            at += len(w)
            rows.append((g, WORDS, np.int32(bucket).tobytes() + corpus.squeeze(mine.astype(np.uint32 if mine.max() < 2**32 else np.int64))))
        return corpus.notes(rows)

    counted = state.cut(packed.groupBy("g").applyInArrow(count, OPEN))
    rows = lambda kind: counted.where(F.col("bucket") == kind).select("g", "data")
    return counted.where("bucket >= 0").groupBy("bucket").applyInArrow(add, corpus.NOTE), rows(-1), rows(-2)


def totals(answers: DataFrame) -> tuple[int, int]:
    """Words and distinct words over all buckets."""

    def read(batches):
        for batch in tc.each(batches):
            both = np.array([np.frombuffer(x.as_py(), np.int64) for x in batch.column(0)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["n", "v"])

    got = answers.where(F.col("kind") == TOTAL).select("data").mapInArrow(read, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return int(got["n"] or 0), int(got["v"] or 0)


def _pair_sums(answers: DataFrame, size: int, keys) -> tuple[np.ndarray, np.ndarray]:
    """Pair counts added up by what `keys` makes of (before, token): a bounded number of cells."""

    def read(batches):
        for batch in tc.each(batches):
            for x in batch.column(0):
                pair, n = corpus.unsqueeze(x.as_py(), 2)
                pair = pair.astype(np.int64)
                for k in keys(pair // size, pair % size):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summed([(k, n)])], ["k", "n"])

    got = answers.where(F.col("kind") == PAIRS).select("data").mapInArrow(read, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    return got["k"].to_numpy(), got["n"].to_numpy()


def subword_counts(answers: DataFrame, size: int) -> np.ndarray:
    """Count of every vocabulary entry, and of ends last."""
    out = np.zeros(size, np.int64)
    k, n = _pair_sums(answers, size, lambda before, token: [token])
    out[k] = n
    return out


def class_counts(answers: DataFrame, size: int, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (class before or START, class) and of (group before or start, token)."""
    told = answers.sparkSession.sparkContext.broadcast(np.append(cls, attention.START))
    cells = (attention.CLASSES + 1) * attention.CLASSES

    def keys(before, token):
        c = told.value
        return [c[before] * attention.CLASSES + c[token], cells + c[before] // attention.PER * size + token]

    flat = np.zeros(cells + (attention.GROUPS + 1) * size, np.int64)
    k, n = _pair_sums(answers, size, keys)
    flat[k] = n
    return flat[:cells].reshape(-1, attention.CLASSES), flat[cells:].reshape(-1, size)


def turns(parts: list[bytes], turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Subwords and offsets of the learning documents of these groups whose turn it is: of sixteen, as many as TURNS says."""
    found, lengths, passed = [np.zeros(0, np.uint16)], [np.zeros(1, np.int64)], 0
    for data in parts:
        ids, at, now = corpus.unsqueeze(data, 3)
        place = np.arange(passed, passed := passed + int(now.sum())) % TURNS[-1]
        now[now] = (place >= TURNS[turn]) & (place < TURNS[turn + 1])
        found.append(ids[np.repeat(now, np.diff(at))])
        lengths.append(np.diff(at)[now])
    return np.concatenate(found), np.cumsum(np.concatenate(lengths))


def fit(docs: DataFrame, tokens: DataFrame, answers: DataFrame, plan: corpus.Plan, key: str, text: str, vocabulary: str, seen: np.ndarray) -> tuple[attention.Model, np.ndarray, np.ndarray]:
    """The model, each token's class and log P(token | class, group before), all from the groups' numbers for all learning documents.

    Learners hold about GROUP_BYTES of texts.  A round takes every learner over the documents whose turn it is,
    from the weights that the round before left, and leaves the learners' mean by blocks; after the last, every
    block of every learning document has been a target once.  A corpus of one learner is gone over in one task.
    """
    ends_word = np.append(packing.chunks(vocabulary, CACHE).ends_word, True)
    cls = attention.classes(seen, ends_word)
    pairs, after = class_counts(answers, len(seen), cls)
    within = attention.within(seen, cls, after)
    by = attention.prior(pairs)
    sc = docs.sparkSession.sparkContext
    told = sc.broadcast((cls, by))
    learners = plan.total_bytes // GROUP_BYTES + 1
    model = attention.Model.start(*by)
    names = list(model.p)
    shape = "place int, learner int, n long, weights binary"

    def table(rows: list) -> pa.Table:
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["place", "learner", "n", "weights"])

    def over_all(found: pa.Table) -> pa.Table:
        cls, by = told.value
        parts = [turns(found.sort_by("g")["data"].to_pylist(), k) for k in range(len(TURNS) - 1)]
        at = np.cumsum(np.concatenate([[0], *(np.diff(at) for _, at in parts)]))
        if not at[-1]:
            return table([])
        model = attention.train(*attention.blocks(cls[np.concatenate([ids for ids, _ in parts])], at), *by)
        return table([(0, 0, 1, corpus.squeeze(*(model.p[k].astype(np.float64) for k in names)))])

    def a_round(turn: int, begun):
        def learn(learner: int, parts: list[bytes]) -> pa.Table:
            cls, by = told.value
            ids, at = turns(parts, turn)
            model, n = attention.Model({k: w.copy() for k, w in begun.value.items()}, *by), 0
            adam = attention.Adam(model.p)
            for k, (a, b) in enumerate(tc.slabs(at, RUN)):
                span = (TURNS[turn] + (TURNS[turn + 1] - TURNS[turn]) * at[[a, b]] / max(at[-1], 1)) / TURNS[-1]
                n += attention.go_over(model, adam, *attention.blocks(cls[ids[at[a] : at[b]]], at[a : b + 1] - at[a]), span, seed=k)
            return table([(learner % PLACES, learner, n, corpus.squeeze(*(model.p[k].astype(np.float64) * n for k in names)))] if n else [])

        def by_group(batches):
            for batch in tc.each(batches):
                for g, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield from learn(g, [data.as_py()]).to_batches()

        def by_learner(found: pa.Table) -> pa.Table:
            tc.give_back()
            return learn(found["g"][0].as_py() % learners, found.sort_by("g")["data"].to_pylist())

        return by_group, by_learner

    def add(found: pa.Table) -> pa.Table:
        found = found.sort_by("learner")
        total = [sum(w) for w in zip(*(corpus.unsqueeze(w, len(names)) for w in found["weights"].to_pylist()), strict=True)]
        return table([(found["place"][0].as_py(), 0, sum(found["n"].to_pylist()), corpus.squeeze(*total))])

    def take(rows: DataFrame) -> None:
        got = sorted(rows.collect(), key=lambda r: r["place"])
        if n := sum(r["n"] for r in got):
            for name, *w in zip(names, *(corpus.unsqueeze(bytes(r["weights"]), len(names)) for r in got), strict=True):
                model.p[name] = (sum(w) / n).astype(np.float32)

    if learners == 1:
        take(tokens.groupBy(F.col("g") % learners).applyInArrow(over_all, shape))
        return model, cls, within
    for turn in range(len(TURNS) - 1):
        by_group, by_learner = a_round(turn, sc.broadcast(dict(model.p)))
        parts = tokens.mapInArrow(by_group, shape) if learners == plan.groups else tokens.groupBy(F.col("g") % learners).applyInArrow(by_learner, shape)
        take(parts.groupBy("place").applyInArrow(add, shape))
    return model, cls, within


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score and n_subwords."""
    path = vocabulary or packing.default_vocabulary()
    docs = corpus.usable(docs.select(key, text), key)
    plan = corpus.measure(docs, text, GROUP_BYTES)
    packed = corpus.pack(docs, key, text, plan.groups)
    answers, tokens, words = counts(packed, plan, key, path)
    answers = state.cut(answers)
    n_words, distinct = totals(answers)
    size = len(packing.chunks(path, CACHE).ends_word) + 1
    seen = subword_counts(answers, size)
    ends = int(seen[-1])
    n, v = n_words + ends, distinct + (ends > 0)
    model, cls, within = fit(docs, tokens, answers, plan, key, text, path, seen)
    told = docs.sparkSession.sparkContext.broadcast((model, cls, within))

    def by_model(batches):
        model, cls, within = told.value
        for batch in tc.each(batches):
            for g, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                scores, lengths = [], []
                for ids, at, _ in subwords(data.as_py()):
                    c = cls[ids]
                    lp = model.log_probs(*attention.blocks(c, at)).astype(np.float64) + within[_before(c, at, attention.START) // attention.PER, ids]
                    scores.append(np.add.reduceat(lp, at[:-1]) / np.log(10))
                    lengths.append(np.diff(at))
                yield from corpus.notes([(g, SCORES, corpus.squeeze(np.concatenate(scores), np.concatenate(lengths)))]).to_batches()

    def score(_key, left: pa.Table, right: pa.Table):
        names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_subwords"]
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)})
        notes = corpus.read_notes(right)
        ids, woff, u, inverse = corpus.unsqueeze(left["data"][0].as_py(), 4)
        kind = corpus.bucket_of(u, plan.buckets)
        c = np.zeros(len(u), np.int64)
        for note in notes.get(WORDS, []):
            a, b = np.searchsorted(kind, [(k := int(np.frombuffer(note, np.int32, 1)[0])), k + 1])
            c[a:b] = corpus.unsqueeze(note[4:], 1)[0]
        per = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[inverse])))[woff])
        tokens = np.diff(woff) + 1
        known = per((c > 0).astype(np.int64)) + (ends > 0)
        base = per(np.log10(c + 1.0)) + np.log10(ends + 1.0) - tokens * np.log10(float(n + 1 * (v + 1)))
        scores, subwords_ = corpus.unsqueeze(notes[SCORES][0], 2)
        return pa.table(dict(zip(names, map(pa.array, (ids, held_out(ids), tokens, known, base, scores, subwords_)), strict=True)))

    shape = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_subwords long"
    told_groups = answers.where(F.col("kind") == WORDS).unionByName(tokens.mapInArrow(by_model, corpus.NOTE))
    out = words.groupBy("g").cogroup(told_groups.groupBy("g")).applyInArrow(score, shape)
    return out.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "n_subwords")


def op6_lm_scores(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
