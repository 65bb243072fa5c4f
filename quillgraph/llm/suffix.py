"""Repeated byte strings across documents (operator 5): a range-partitioned sparse suffix array.

``remove_shared_bytes`` removes every byte covered by a string of ``length`` bytes (50) that
also starts in a document with a smaller id.

1. Suffixes are sampled by content: of the k-mers (26 bytes) inside each string of 50, the one
   that hashes lowest is its anchor.  Equal strings have equal anchors, so looking at suffixes
   that start at anchors (one in 13) and at the bytes left of them loses no string.
2. Anchors that occur in one document only are dropped by a fingerprint exchange.
3. The rest are dealt by range of their leading 8-byte tokens; the splitters are quantiles of a
   bounded sample of anchors.  A splitter is compared on two whole tokens, so suffixes that agree
   on them never part, and no equal strings lie on both sides of a boundary.  A range that holds
   several quantiles, since its leading tokens are that common, or that is to hold more than one
   bucket's bytes, since the corpus is that large, is split further by the whole k-mer, on which
   equal strings agree too: buckets follow the bytes, the sample does not.
4. Each bucket sorts its suffixes, and the reversed bytes left of them, by multikey quicksort over
   tokens (ties alone go on to the next token) and reads common prefix lengths off neighbours: two
   strings are equal iff they share a run at depth 50 - j on the right and j on the left.
   These are comparisons of bytes, not of hashes; each run names its smallest id.

Groups combine equal contexts before sending (only the smallest id's is sent), and documents that
repeat a smaller id's whole text are settled beforehand, so a hot passage costs a few rows a group.

Edge cases: a null text is empty; shorter documents are kept whole; rows with a null id are left
out; rows that share an id are one document to the rule, each with a row of its own; input columns
named like the operator's own are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import corpus
from . import textcore as tc
from .substring import GONE, HITS, OPEN, PROBES

SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
OWN = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", SPAN), T.StructField("kept", T.BinaryType())]
#: Splitters, at most, and the sampled anchors behind each.
RANGES, SAMPLED = 4096, 16


def _slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over each `width` neighbours, by doubling."""
    done = 1
    out = a
    while done < width:
        step = min(done, width - done)
        out = f(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-mer hashes of the sampled suffixes of all documents."""
    k = length // 2 + 1
    w = length - k + 1
    at, hs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in tc.slabs(off):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        n = len(part)
        if n < length:
            continue
        h = tc.rolling(tc._TABLE[part], k, tc._BASE)
        rank = (h >> np.uint64(32)).astype(np.uint32)
        low = _slide(rank, w, np.minimum)
        live = np.zeros(n + 1, np.int32)
        np.add.at(live, o[:-1], 1)
        np.add.at(live, np.maximum(o[1:] - length + 1, o[:-1]), -1)
        low[np.cumsum(live)[: len(low)] <= 0] = 0
        edge = np.zeros(w - 1, np.uint32)
        high = _slide(np.concatenate([edge, low, edge]), w, np.maximum)[: len(rank)]
        got = np.flatnonzero(high == rank)
        at.append(got + off[a])
        hs.append(h[got])
    return np.concatenate(at), np.concatenate(hs)


def contexts(doc: corpus.Group, at: np.ndarray, length: int) -> np.ndarray:
    """A row of bytes for each anchor: w - 1 to its left, `length` to its right, and how many of either are the document's."""
    left = length - length // 2 - 1
    d = np.searchsorted(doc.off, at, "right") - 1
    ll = np.minimum(left, at - doc.off[d])
    rl = np.minimum(length, doc.off[d + 1] - at)
    padded = np.concatenate([np.zeros(left, np.uint8), doc.buf, np.zeros(length, np.uint8)])
    out = np.empty((len(at), left + length + 2), np.uint8)
    out[:, :-2] = np.lib.stride_tricks.sliding_window_view(padded, left + length)[at]
    col = np.arange(left + length)
    out[:, :-2][(col < (left - ll)[:, None]) | (col >= (left + rl)[:, None])] = 0
    out[:, -2], out[:, -1] = ll, rl
    return out


def tokens(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 8-byte tokens."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    return padded.view(">u8").astype(np.uint64)


def multikey(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the bytes that each has in common with the one before it."""
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = tokens(rows)
    order = np.argsort(t[:, 0], kind="stable")
    new = np.ones(n, bool)
    new[1:] = t[order[1:], 0] != t[order[:-1], 0]
    for c in range(1, t.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        run = np.cumsum(new)[at]
        sub = order[at]
        sub = sub[np.lexsort((t[sub, c], run))]
        order[at] = sub
        new[at[1:]] |= (t[sub[1:], c] != t[sub[:-1], c]) & (run[1:] == run[:-1])
    lcp = np.zeros(n, np.int64)
    differ = rows[order[1:]] != rows[order[:-1]]
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, lcp


def shared_windows(ctx: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each context a bit mask: bit j if the string that starts j bytes left of the anchor is in a smaller id too."""
    left = length - length // 2 - 1
    mask = np.zeros(len(ctx), np.uint32)
    by_id = np.argsort(ids, kind="stable")
    order, lcp = multikey(ctx[by_id, left : left + length])
    run = np.cumsum(lcp < length - left)  # shares the anchor's k-mer
    own = ids[by_id][order]
    cut = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, np.int64)
    mixed = np.minimum.reduceat(own, cut) != np.maximum.reduceat(own, cut) if len(cut) else np.zeros(0, bool)
    rows = np.sort(by_id[order[np.repeat(mixed, np.diff(np.append(cut, len(run))))]])
    if not len(rows):
        return mask
    rows = rows[np.argsort(ids[rows], kind="stable")]  # smallest id first in every run below
    c, own, n = ctx[rows], ids[rows], len(rows)
    r_order, r_lcp = multikey(c[:, left : left + length])
    l_order, l_lcp = multikey(c[:, :left][:, ::-1])
    r, l = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(left + 1):
        r[r_order] = np.cumsum(r_lcp < length - j)
        l[l_order] = np.cumsum(l_lcp < j) if j else 0
        live = np.flatnonzero((c[:, -2] >= j) & (c[:, -1] >= length - j))
        key = r[live] * (n + 1) + l[live]
        o = np.argsort(key, kind="stable")
        new = np.ones(len(o), bool)
        new[1:] = key[o[1:]] != key[o[:-1]]
        least = own[live[o]][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(o) else own[:0]
        mask[rows[live[o[own[live[o]] > least]]]] |= np.uint32(1 << j)
    return mask


def lead_bytes(length: int) -> int:
    """Two tokens, or the whole k-mer if it is shorter: equal strings agree on no more than that right of their anchor."""
    return min(16, length // 2 + 1)


def splitters(docs: DataFrame, key: str, text: str, length: int, plan: corpus.Plan) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the leading two tokens of a bounded sample of anchors, and the first bucket of each range and of what would follow the last."""
    ranges = min(plan.buckets, RANGES)
    every = max(1, plan.rows // 2000)
    left, lead = length - length // 2 - 1, lead_bytes(length)

    def run(batches):
        for batch in tc.each(batches):
            buf, off = tc.flat(batch.column(0))
            at, _ = anchors(buf, off, length)
            at = at[:: max(1, len(at) // 4096)]
            doc = corpus.Group(0, None, np.zeros(0, np.int64), buf, off)
            rows = contexts(doc, at, length)[:, left : left + lead]
            yield pa.RecordBatch.from_pydict({"k": pa.array([x.tobytes() for x in rows], pa.binary())})

    keys = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(every)) == 0).select(text).mapInArrow(run, "k binary")
    got = sorted(bytes(r["k"]) for r in keys.orderBy(F.xxhash64("k")).limit(ranges * SAMPLED).collect())
    cuts = [got[len(got) * i // ranges] for i in range(1, ranges)] if got else []
    cuts, times = np.unique(np.array(cuts, f"S{lead}"), return_counts=True)
    return cuts, np.concatenate(([0], np.cumsum(np.concatenate(([1], times)) * -(-plan.buckets // ranges))))


def remove_shared_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """Input columns without `text`, and n_bytes, n_removed, n_spans, the removed spans, and the kept bytes."""
    if not 4 <= length <= 64:
        raise ValueError("length must be from 4 to 64")
    docs = corpus.usable(docs, key)
    plan = corpus.measure(docs, text)
    schema, keep = corpus.schema_with(docs, {text}, OWN)
    packed = corpus.pack(docs, key, text, plan.groups)
    copied = corpus.copies(docs, key, text, plan.groups)
    cuts, begin_at = splitters(docs, key, text, length, plan)
    buckets = int(begin_at[-1])
    left, width = length - length // 2 - 1, lead_bytes(length)

    def _anchors(doc: corpus.Group, told) -> tuple[np.ndarray, np.ndarray]:
        at, h = anchors(doc.buf, doc.off, length)
        skip = corpus.is_copy(doc, told)
        if skip.any():
            live = ~skip[np.searchsorted(doc.off, at, "right") - 1]
            at, h = at[live], h[live]
        return at, h

    def probe(_key, packs: pa.Table, right: pa.Table):
        out = {"bucket": [], "g": [], "prints": [], "flags": []}
        if doc := corpus.unpack(packs, key):
            at, h = _anchors(doc, corpus.read_notes(right))
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            if len(h):
                cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                owner = doc.ids[np.searchsorted(doc.off, at, "right") - 1]
                many = np.minimum.reduceat(owner, cut) != np.maximum.reduceat(owner, cut)
                u = h[cut]
                for k, a, b in corpus.runs(corpus.bucket_of(u, plan.buckets)):
                    out["bucket"].append(k)
                    out["g"].append(doc.g)
                    out["prints"].append(u[a:b].astype(np.uint32).tobytes())
                    out["flags"].append(np.packbits(many[a:b]).tobytes())
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("prints", pa.binary()), ("flags", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        prints = [np.frombuffer(x, np.uint32) for x in table.column("prints").to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(p)].astype(bool) for x, p in zip(table.column("flags").to_pylist(), prints, strict=True)]
        every = np.concatenate(prints)
        order = np.argsort(every, kind="stable")
        s = every[order]
        again = np.zeros(len(s), bool)
        again[1:] = s[1:] == s[:-1]
        again[:-1] |= s[1:] == s[:-1]
        hit = np.concatenate(many)
        hit[order] |= again
        rows, at = [], 0
        for g, p in zip(table.column("g").to_pylist(), prints, strict=True):
            mine = hit[at : at + len(p)]
            at += len(p)
            if mine.any():
                rows.append((g, HITS, np.int32(bucket).tobytes() + np.packbits(mine).tobytes()))
        return corpus.notes(rows)

    def deal(_key, packs: pa.Table, right: pa.Table):
        out = {"bucket": [], "g": [], "data": []}
        told = corpus.read_notes(right)
        if (doc := corpus.unpack(packs, key)) and told.get(HITS):
            at, h = _anchors(doc, told)
            u = np.unique(h)
            kind = corpus.bucket_of(u, plan.buckets)
            hit = np.zeros(len(u), bool)
            for note in told[HITS]:
                a, b = np.searchsorted(kind, [(k := int(np.frombuffer(note, np.int32, 1)[0])), k + 1])
                hit[a:b] = np.unpackbits(np.frombuffer(note, np.uint8, offset=4))[: b - a].astype(bool)
            among = np.isin(h, u[hit])
            at, h = at[among], h[among]
            ctx = contexts(doc, at, length)
            owner = doc.ids[np.searchsorted(doc.off, at, "right") - 1]
            t = tokens(ctx)
            p, _ = tc.powers(tc._WBASE, t.shape[1])
            _, first, inv = np.unique(tc.mix((tc.mix(t) * p).sum(axis=1, dtype=np.uint64)), return_index=True, return_inverse=True)
            lead = first[inv] if len(at) else np.zeros(0, np.int64)
            settled = (owner > owner[lead]) & (ctx == ctx[lead]).all(axis=1)
            j = np.arange(left + 1)
            full = (((ctx[:, -2][:, None] >= j) & (ctx[:, -1][:, None] >= length - j)) << j).sum(axis=1).astype(np.uint32)
            out["bucket"].append(buckets + doc.g)
            out["g"].append(doc.g)
            out["data"].append(corpus.squeeze(at[settled].astype(np.uint32), full[settled]))
            at, h, ctx, owner = at[~settled], h[~settled], ctx[~settled], owner[~settled]
            lead_tokens = np.ascontiguousarray(ctx[:, left : left + width]).view(f"S{width}").ravel()
            r = np.searchsorted(cuts, lead_tokens, "right")
            k = (begin_at[r] + (tc.mix(h) % np.diff(begin_at)[r].astype(np.uint64)).astype(np.int64)).astype(np.int32)
            order = np.argsort(k, kind="stable")
            for b, x, y in corpus.runs(k[order]):
                mine = order[x:y]
                out["bucket"].append(b)
                out["g"].append(doc.g)
                out["data"].append(corpus.squeeze(ctx[mine], owner[mine], at[mine].astype(np.uint32)))
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("data", pa.binary())]))

    def settle(table: pa.Table) -> pa.Table:
        groups, data = table.column("g").to_pylist(), table.column("data").to_pylist()
        if table.column("bucket")[0].as_py() >= buckets:
            return corpus.notes([(g, GONE, x) for g, x in zip(groups, data, strict=True)])
        parts = [corpus.unsqueeze(x, 3) for x in data]
        mask = shared_windows(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), length)
        rows, at = [], 0
        for g, p in zip(groups, parts, strict=True):
            mine = mask[at : at + len(p[2])]
            at += len(p[2])
            if mine.any():
                rows.append((g, GONE, corpus.squeeze(p[2][mine > 0], mine[mine > 0])))
        return corpus.notes(rows)

    types = {f.name: to_arrow_type(f.dataType) for f in schema.fields}

    def finish(_key, packs: pa.Table, right: pa.Table):
        arrow = pa.schema([pa.field(n, t) for n, t in types.items()])
        if not (doc := corpus.unpack(packs, key)):
            return arrow.empty_table()
        told = corpus.read_notes(right)
        size = len(doc.buf)
        begins = np.zeros(size, bool)
        for note in told.get(GONE, []):
            at, mask = corpus.unsqueeze(note, 2)
            at = at.astype(np.int64)
            for j in range(left + 1):
                begins[at[(mask >> np.uint32(j)) & np.uint32(1) > 0] - j] = True
        gone = corpus.covered(begins, length)
        n_bytes = np.diff(doc.off)
        for i in np.flatnonzero(corpus.is_copy(doc, told) & (n_bytes >= length)):
            gone[doc.off[i] : doc.off[i + 1]] = True
        before = np.concatenate(([0], np.cumsum(gone)))
        edge = np.zeros(size + 1, bool)
        edge[doc.off] = True
        begin = np.flatnonzero(gone & ~(np.concatenate(([False], gone[:-1])) & ~edge[:size]))
        end = np.flatnonzero(gone & ~(np.concatenate((gone[1:], [False])) & ~edge[1:])) + 1
        n_at = np.searchsorted(begin, doc.off)
        base = np.repeat(doc.off[:-1], np.diff(n_at))
        spans = pa.ListArray.from_arrays(pa.array(n_at, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["begin", "end"]))
        kept = doc.buf[~gone]
        koff = doc.off - before[doc.off]
        body = pa.Array.from_buffers(pa.large_binary(), len(doc.ids), [None, pa.py_buffer(koff.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())])
        cols = {n: doc.table.column(n) for n in keep}
        cols |= {"n_bytes": pa.array(n_bytes), "n_removed": pa.array(n_bytes - np.diff(koff)), "n_spans": pa.array(np.diff(n_at)), "spans": spans.cast(types["spans"]), "kept": body.cast(pa.binary())}
        return pa.table(cols).cast(arrow)

    by_group = packed.groupBy("g")
    probes = by_group.cogroup(copied.groupBy("g")).applyInArrow(probe, PROBES)
    hits = probes.groupBy("bucket").applyInArrow(answer, corpus.NOTE)
    dealt = by_group.cogroup(copied.unionByName(hits).groupBy("g")).applyInArrow(deal, OPEN)
    gone = dealt.groupBy("bucket").applyInArrow(settle, corpus.NOTE)
    return by_group.cogroup(copied.unionByName(gone).groupBy("g")).applyInArrow(finish, schema)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_shared_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
