"""Repeated passages of words (operator 3): fixed-block anchors.

``remove_repeats`` removes every word covered by a window of ``window`` words whose word
sequence also starts earlier (in a document with a smaller id, or earlier in the same one).

1. Reference blocks: each document's non-overlapping blocks of ``window // 2`` words are
   the index.  A repeated window of 20 words holds a whole block of 10 of *either* side.
2. Probes: every rolling window of 10 words asks the index.  Groups send each distinct
   probe once, as a 32-bit fingerprint within a hash bucket, flagged when it is a block.
3. Hits are extended: every window of 20 around a hit is hashed in full, to 128 bits, and the
   earliest document of each hash is found; overlapping repeated windows join to maximal repeats.

Steps 2 and 3 only pass (group, distinct hash) entries, never pairs; a passage in a third of
all documents costs one entry for each group.  Documents that repeat a smaller id's whole
text are settled beforehand and send nothing.

Edge cases: a null text has no words; documents shorter than a window are kept whole; rows
with a null id are left out; rows that share an id are documents of their own, the one with
the smaller text coming first; input columns named like the operator's own are replaced.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import corpus
from . import textcore as tc

PROBES = "bucket int, g int, prints binary, flags binary"
OPEN = "bucket int, g int, data binary"
OWN = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())]
HITS, GONE = 1, 2
#: Base of the second half of a window's hash.
SECOND = 0xA0761D6478BD642F


def _blocks(doc: corpus.Group, skip: np.ndarray, block: int, window: int):
    """Word hashes, document starts, and hash and alignment of each rolling block; short and skipped documents have none."""
    h, woff = tc.word_hashes(doc.buf, doc.off)
    ok = tc.window_starts(woff, block)
    off_duty = skip | (np.diff(woff) < window)
    for a, b in zip(woff[:-1][off_duty], woff[1:][off_duty], strict=True):
        ok[a:b] = False
    at = np.flatnonzero(ok)
    return h, woff, at, tc.rolling(h, block)[at] if len(at) else np.zeros(0, np.uint64)


def _first(full: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Where a run of equal 128-bit hashes begins in sorted vectors."""
    new = np.ones(len(full), bool)
    new[1:] = (full[1:] != full[:-1]) | (wide[1:] != wide[:-1])
    return new


def _aligned(at: np.ndarray, woff: np.ndarray, block: int) -> np.ndarray:
    first = woff[np.searchsorted(woff, at, "right") - 1]
    return (at - first) % block == 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """Input columns, `text` being the kept words joined by one blank, with n_words and n_removed."""
    if window < 2:
        raise ValueError("window must be 2 at least")
    block = (window + 1) // 2
    docs = corpus.usable(docs, key)
    plan = corpus.measure(docs, text)
    schema, keep = corpus.schema_with(docs, {text}, OWN)
    packed = corpus.pack(docs, key, text, plan.groups)
    copied = corpus.copies(docs, key, text, plan.groups)

    def probe(_key, left: pa.Table, right: pa.Table):
        out = {"bucket": [], "g": [], "prints": [], "flags": []}
        if doc := corpus.unpack(left, key):
            _, woff, at, h = _blocks(doc, corpus.is_copy(doc, corpus.read_notes(right)), block, window)
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, np.bool_)
            cut = np.flatnonzero(new)
            if len(cut):
                fixed = np.maximum.reduceat(_aligned(at, woff, block), cut)
                many = np.diff(np.append(cut, len(h))) > 1
                u = h[cut]
                for k, a, b in corpus.runs(corpus.bucket_of(u, plan.buckets)):
                    out["bucket"].append(k)
                    out["g"].append(doc.g)
                    out["prints"].append(u[a:b].astype(np.uint32).tobytes())
                    out["flags"].append(np.packbits(np.stack([fixed[a:b], many[a:b]])).tobytes())
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("prints", pa.binary()), ("flags", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        prints = [np.frombuffer(x, np.uint32) for x in table.column("prints").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8))[: 2 * len(p)].reshape(2, -1).astype(bool) for x, p in zip(table.column("flags").to_pylist(), prints, strict=True)]
        every = np.concatenate(prints)
        fixed, many = np.concatenate(flags, axis=1)
        index = np.unique(every[fixed])  # the reference blocks
        where = np.searchsorted(index, every)
        known = index[np.minimum(where, len(index) - 1)] == every if len(index) else np.zeros(len(every), bool)
        seen = np.bincount(where[known], minlength=len(index))
        hit = known.copy()
        hit[known] = (seen[where[known]] > 1) | many[known]
        rows, at = [], 0
        for g, p in zip(table.column("g").to_pylist(), prints, strict=True):
            mine = hit[at : at + len(p)]
            at += len(p)
            if mine.any():
                rows.append((g, HITS, np.int32(bucket).tobytes() + np.packbits(mine).tobytes()))
        return corpus.notes(rows)

    def extend(_key, left: pa.Table, right: pa.Table):
        out = {"bucket": [], "g": [], "data": []}
        told = corpus.read_notes(right)
        if (doc := corpus.unpack(left, key)) and told.get(HITS):
            h, woff, at, b10 = _blocks(doc, corpus.is_copy(doc, told), block, window)
            u = np.unique(b10)
            kind = corpus.bucket_of(u, plan.buckets)
            hit = np.zeros(len(u), bool)
            for note in told[HITS]:
                a, b = np.searchsorted(kind, [(k := int(np.frombuffer(note, np.int32, 1)[0])), k + 1])
                hit[a:b] = np.unpackbits(np.frombuffer(note, np.uint8, offset=4))[: b - a].astype(bool)
            found = np.zeros(len(h) + 1, np.int32)
            found[at[np.isin(b10, u[hit])] + 1] = 1
            np.cumsum(found, out=found)
            start = np.flatnonzero(tc.window_starts(woff, window))
            start = start[found[np.minimum(start + window - block + 1, len(h))] > found[start]]
            full, wide = tc.rolling(h, window)[start], tc.rolling(tc.mix(h), window, SECOND)[start]
            order = np.lexsort((wide, full))
            full, wide, start = full[order], wide[order], start[order]
            new = _first(full, wide)
            gone = np.sort(start[~new])  # an earlier start is in this very group
            out["bucket"].append(plan.buckets + doc.g)
            out["g"].append(doc.g)
            out["data"].append(corpus.squeeze(np.diff(gone, prepend=0).astype(np.uint32)))
            full, wide, start = full[new], wide[new], start[new]
            owner = doc.ids[np.searchsorted(woff, start, "right") - 1]
            for k, a, b in corpus.runs(corpus.bucket_of(full, plan.buckets)):
                out["bucket"].append(k)
                out["g"].append(doc.g)
                out["data"].append(corpus.squeeze(full[a:b], wide[a:b], owner[a:b], start[a:b].astype(np.uint32)))
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("data", pa.binary())]))

    def settle(table: pa.Table) -> pa.Table:
        groups, data = table.column("g").to_pylist(), table.column("data").to_pylist()
        if table.column("bucket")[0].as_py() >= plan.buckets:
            return corpus.notes([(g, GONE, x) for g, x in zip(groups, data, strict=True)])
        parts = [corpus.unsqueeze(x, 4) for x in data]
        full, wide, owner = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((owner, wide, full))
        new = _first(full[order], wide[order])
        least = owner[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = np.zeros(len(full), bool)
        late[order] = owner[order] > least
        rows, at = [], 0
        for g, p in zip(groups, parts, strict=True):
            mine = np.sort(p[3][late[at : at + len(p[0])]])
            at += len(p[0])
            if len(mine):
                rows.append((g, GONE, corpus.squeeze(np.diff(mine.astype(np.int64), prepend=0).astype(np.uint32))))
        return corpus.notes(rows)

    def finish(_key, left: pa.Table, right: pa.Table):
        arrow = pa.schema([*[pa.field(n, left_types[n]) for n in keep], pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("text", pa.string())])
        if not (doc := corpus.unpack(left, key)):
            return arrow.empty_table()
        told = corpus.read_notes(right)
        skip = corpus.is_copy(doc, told)
        texts = [doc.text(i) for i in range(len(doc.ids))]
        words = [t.split() for t in texts]
        woff = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        begins = np.zeros(int(woff[-1]), bool)
        for note in told.get(GONE, []):
            begins[np.cumsum(corpus.unsqueeze(note, 1)[0].astype(np.int64))] = True
        kept = ~corpus.covered(begins, window)
        for i in np.flatnonzero(skip & (np.diff(woff) >= window)):
            kept[woff[i] : woff[i + 1]] = False
        n_kept = np.concatenate(([0], np.cumsum(kept)))[woff]
        n_kept = np.diff(n_kept)
        out = [b" ".join(w) if n == len(w) else b" ".join(compress(w, kept[a : a + len(w)].tolist())) for w, n, a in zip(words, n_kept, woff[:-1], strict=True)]
        cols = {n: doc.table.column(n) for n in keep}
        cols |= {"n_words": pa.array(np.diff(woff)), "n_removed": pa.array(np.diff(woff) - n_kept), "text": pa.array(out, pa.binary()).cast(pa.string())}
        return pa.table(cols).cast(arrow)

    from pyspark.sql.pandas.types import to_arrow_type

    left_types = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
    by_group = packed.groupBy("g")
    probes = by_group.cogroup(copied.groupBy("g")).applyInArrow(probe, PROBES)
    hits = probes.groupBy("bucket").applyInArrow(answer, corpus.NOTE)
    open_ = by_group.cogroup(copied.unionByName(hits).groupBy("g")).applyInArrow(extend, OPEN)
    gone = open_.groupBy("bucket").applyInArrow(settle, corpus.NOTE)
    return by_group.cogroup(copied.unionByName(gone).groupBy("g")).applyInArrow(finish, schema)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
