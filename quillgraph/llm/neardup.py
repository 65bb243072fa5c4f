"""Near-duplicate groups (operator 2): HyperMinHash sketches, banding, exact confirmation.

A document's set is its distinct shingles of five words (a shorter one's whole sequence).  The
sketch has 256 registers; each keeps, of the smallest hash dealt to it, the count of leading
zeros and 20 mantissa bits.  An empty register is a value like any other, so each register of two
documents agrees with at least their Jaccard similarity as probability.

1. Documents with equal sets are one class; only its smallest id goes on.
2. Bands of 4 registers are keys (bands with no shingle at all are not): the first 32 of sketches
   with ``LARGE`` registers in use or more, all 64 of smaller ones, whose bands are mostly empty.  Two sets
   at 0.75 share none of 32 bands with probability 5e-6 at most.
3. Round one: each class is paired with one hub, the smallest id of the key it shares most often.
   Pairs whose collision-corrected estimate is out of reach are dropped; the rest are confirmed
   on the full sets, dealt by hub and salt so that no hub gathers more than a bounded group.
4. Keys whose classes are in several components so far are *open*.  The shingles of open classes are
   counted, and a class whose shingles are so often its own alone that no intersection can be large
   enough for a link leaves.  So members of a large group that are edited beyond the threshold are
   settled without meeting each other.
5. Round two: every class is paired with the hub of each of its open keys, which now is the class
   with the fewest shingles of its own, the text that the others were made from.
6. Round three: each class left learns how many of them hold each of its shingles.  A link has an
   intersection so large that both share one of either's rarest few (the prefix of an exact set
   join), so classes of different components that share a shingle there are compared by sketch:
   those outside the largest component that holds the shingle with all, in blocks.  A class's best
   pair is confirmed before the rest, which may be needless by then.
   So links in one component are never enumerated, and links between components are not lost.
7. Components: links are contracted in tasks of a bounded number; if that took several, alternating
   large-star and small-star steps follow, written to the shared folder.

Edge cases: null or wordless texts have an empty set and are linked with nothing; rows with a null
id are left out; rows that share an id are documents of their own, placed by their own texts and
named by the same id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import corpus, state
from . import textcore as tc
from .substring import OPEN

REGISTERS, MANTISSA, ROWS, SHINGLE = 256, 20, 4, 5
BANDS = REGISTERS // ROWS
LARGE = 100
_HASH_BITS = 52
#: An estimate further below the threshold than this many standard errors rules a pair out.
SIGMAS = 4.0
#: Pairs confirmed with one hub in one task; classes of one key and side compared in one task.
SPOKES, BLOCK = 256, 4096
#: Pairs whose sketches are compared at once: 2 KB each.
PAIRS = 4096
#: Rows of classes that one task compares key by key, about.
SLOT = 20_000
#: Rows of pairs and ids that stay in one partition.
GATHERED = 100_000
#: Bytes of a side that is broadcast, at most.
BROADCAST_BYTES = 16 << 20
#: Logarithm of the 64-bit words of a table of bits, at most: 32 MB.
SIEVE_WORDS = 22
#: Shingles of one group of sets, and of one bucket of a count, about; ids whose counts one task adds up; links that one task contracts.
COUNTED, COUNTERS, CONTRACTED = 500_000, 100_000, 1_000_000


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document, A-Z lower-cased."""
    h, woff = tc.word_hashes(buf, off, lower=True)
    every = tc.rolling(h, size)
    out = []
    for a, b in zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True):
        n = b - a
        out.append(np.unique(every[a : b - size + 1] if n >= size else tc.rolling(h[a:b], n) if n else h[:0]))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 32-bit registers for each set: 0 if empty, else 1 + (leading zeros, mantissa)."""
    sizes = [len(s) for s in sets]
    least = np.full(len(sets) * REGISTERS, np.uint64(2**64 - 1))
    if sum(sizes):
        h = np.concatenate(sets)
        at = np.repeat(np.arange(len(sets)) * REGISTERS, sizes) + (h & np.uint64(REGISTERS - 1)).astype(np.int64)
        np.minimum.at(least, at, h >> np.uint64(64 - _HASH_BITS))
    used = least != np.uint64(2**64 - 1)
    v = least[used]
    bits = np.frexp(v.astype(np.float64))[1]  # exact: 52 bits fit a double
    zeros = (_HASH_BITS - bits).astype(np.uint64)
    mantissa = ((v << zeros) >> np.uint64(_HASH_BITS - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros(len(least), np.uint32)
    out[used] = (1 + (zeros << np.uint64(MANTISSA)) + mantissa).astype(np.uint32)
    return out.reshape(len(sets), REGISTERS)


def chance(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Probability that registers of two disjoint sets of these sizes hold the same value."""
    a, b = np.maximum(n1, 1) / REGISTERS, np.maximum(n2, 1) / REGISTERS
    s = a + b
    i = np.arange(40)[:, None]
    cell = 2.0 ** -(i + 1 + MANTISSA)
    both = (a * b / s * cell * (np.exp(-s * 2.0 ** -(i + 1)) - np.exp(-s * 2.0**-i))).sum(axis=0)
    return both / (1 - np.exp(-s))


def estimate(x: np.ndarray, y: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of sketched sets, corrected for chance collisions, and the registers it rests on."""
    live = ((x > 0) | (y > 0)).sum(axis=1)
    same = ((x == y) & (x > 0)).sum(axis=1)
    c = chance(n1, n2)
    return (same / np.maximum(live, 1) - c) / (1 - c), live


def possible(x, y, n1, n2, threshold: float) -> np.ndarray:
    """False where sizes or sketches rule a link out.

    A sketch is a sample without replacement of the union, which the threshold's own has (n1 + n2) /
    (1 + threshold) shingles; the more of it the registers hold, the less the estimate can be off.
    """
    ok = np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - 1e-9
    at = np.flatnonzero(ok)
    n1, n2 = n1[at], n2[at]
    est, live = estimate(x[at], y[at], n1, n2)
    union = np.maximum((n1 + n2) / (1 + threshold), live + 1)
    slack = SIGMAS * np.sqrt(threshold * (1 - threshold) / np.maximum(live, 1) * (1 - live / union)) + 1 / np.maximum(live, 1)
    ok[at] = est >= threshold - slack
    return ok


def sketches(docs: DataFrame, key: str, text: str, digests: bool = False) -> DataFrame:
    """id, n_shingles, mark (128-bit digest of the set), sketch, digest (SHA-256 of the text, if asked for)."""

    def run(batches):
        for batch in tc.each(batches):
            buf, off = tc.flat(batch.column(1))
            n, mark, body = [], [], []
            for a, b in tc.slabs(off):
                sets = shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                n += [len(s) for s in sets]
                mark += [_set_mark(s) for s in sets]
                body += [r.tobytes() for r in sketch(sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.array(body, pa.binary())], ["id", "n_shingles", "mark", "sketch"]).append_column("digest", batch.column(2))

    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)) if digests else F.lit(None).cast("binary")
    return docs.select(key, text, digest.alias("_digest")).mapInArrow(run, "id long, n_shingles long, mark binary, sketch binary, digest binary")


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, REGISTERS)


def _gathered(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows, written, in as many partitions as their number calls for, and that number."""
    rows = state.cut(rows)
    n = rows.count()
    return rows.coalesce(n // GATHERED + 1), n


def _sieve(rows: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """The rows whose `column` may be among the n ids, by a bounded table of bits that is broadcast; an exact join is to follow."""
    words = 1 << min(SIEVE_WORDS, max(10, (n // 4).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(words)).cast("int")
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({c}), 40), 64) as int))")

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(words, np.int64)
        bits[table["place"].to_numpy()] = table["bits"].to_numpy()
        return pa.table({"bits": pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(bits))})

    set_ = ids.groupBy(place("id").alias("place")).agg(F.bit_or(bit("id")).alias("bits")).select(F.lit(0).alias("one"), "place", "bits")
    table = F.broadcast(set_.groupBy("one").applyInArrow(fill, "bits array<long>"))  # one row
    return rows.crossJoin(table).where(F.get("bits", place(column)).bitwiseAND(bit(column)) != 0).select(*rows.columns)


def _among(nodes: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The nodes of these ids, of which there are `most` at most; where these are too many to be broadcast, a few others as well."""
    if 16 * most <= BROADCAST_BYTES:
        return nodes.join(F.broadcast(ids.distinct()), "id", "left_semi")
    return _sieve(nodes, "id", ids, most)


def plausible(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out."""

    def side(s: str) -> DataFrame:
        return nodes.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))

    def run(batches):
        for batch in tc.each(batches):
            t = pa.Table.from_batches([batch])
            if t.num_rows:
                ok = possible(_rows(t["s_a"]), _rows(t["s_b"]), t["n_a"].to_numpy(), t["n_b"].to_numpy(), threshold)
                yield from t.select(["a", "b"]).filter(pa.array(ok)).to_batches()

    pairs, n = _gathered(pairs)
    nodes = _among(nodes, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), 2 * n)
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _set_mark(s: np.ndarray) -> bytes:
    """128-bit digest of a set."""
    return np.array([s.sum(dtype=np.uint64), tc.mix(s ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64)]).tobytes()


def _texts(docs: DataFrame, asked: DataFrame, most: int, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """`asked`, whose column `id` names nodes, with the `mark` and the `text` of their documents, or of others that share the id; it has `most` bytes at most.

    Beyond what is broadcast, texts are shuffled, but only of documents that a table of bits lets through.
    """
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    if most <= BROADCAST_BYTES:
        return texts.join(F.broadcast(nodes.select("id", "doc", "mark").join(F.broadcast(asked), "id")), "doc")
    asked = state.cut(nodes.select("id", "doc", "mark").join(asked, "id"))
    return _sieve(texts, "doc", asked.select(F.col("doc").alias("id")), most // 64).join(asked, "doc")


def confirm(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, key: str, text: str, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough.  Sets travel to (b, salt); b's own set to every salt."""
    pairs, n = _gathered(pairs)
    if not n:
        return pairs
    spread = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")).withColumn("salts", F.floor((F.col("c") - 1) / SPOKES).cast("int") + 1)
    spokes = pairs.join(spread, "b").select(F.col("a").alias("id"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("own"))
    hubs = spread.select(F.col("b").alias("id"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("own"))
    calls = spokes.unionByName(hubs).groupBy("id").agg(F.collect_list(F.struct("hub", "salt", "own")).alias("calls")).coalesce(n // GATHERED + 1)
    asked = _texts(docs, calls, 2 * n * (64 + 16), nodes, key, text)  # no more ids, and entries, than twice the pairs

    shape = pa.schema([("hub", pa.int64()), ("salt", pa.int32()), ("own", pa.bool_()), ("id", pa.int64()), ("body", pa.binary())])

    def sets(batches):
        for batch in tc.each(batches):
            buf, off = tc.flat(batch.column(1))
            out, size = {n: [] for n in shape.names}, 0
            for i, (who, calls, mark) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                mine = shingle_sets(buf[off[i] : off[i + 1]], off[i : i + 2] - off[i])[0]
                if _set_mark(mine) != mark:  # another text under that id
                    continue
                body = mine.tobytes()
                for c in calls:
                    for k in ("hub", "salt", "own"):
                        out[k].append(c[k])
                    out["id"].append(who)
                    out["body"].append(body)
                    size += len(body)
                    if size > state.BATCH_BYTES:  # a document may be asked for by many hubs
                        yield pa.RecordBatch.from_pydict(out, schema=shape)
                        out, size = {n: [] for n in shape.names}, 0
            yield pa.RecordBatch.from_pydict(out, schema=shape)

    def check(table: pa.Table) -> pa.Table:
        rows = [(i, own, np.frombuffer(b, np.uint64)) for i, own, b in zip(table["id"].to_pylist(), table["own"].to_pylist(), table["body"].to_pylist(), strict=True)]
        hub = table["hub"][0].as_py()
        good = set()
        for mine in (s for _, own, s in rows if own):
            for i, own, s in rows:
                if not own and len(s) and len(mine):
                    at = np.searchsorted(mine, s)
                    both = int((mine[np.minimum(at, len(mine) - 1)] == s).sum())
                    if 100 * both >= per_cent * (len(s) + len(mine) - both):
                        good.add(i)
        return pa.table({"a": pa.array(sorted(good), pa.int64()), "b": pa.array([hub] * len(good), pa.int64())})

    dealt = asked.select("id", "text", "calls", "mark").mapInArrow(sets, "hub long, salt int, own boolean, id long, body binary")
    return state.cut(dealt.groupBy("hub", "salt").applyInArrow(check, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(id, root): every linked id that is not the smallest of its component, and that smallest id."""
    links = state.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    tasks = links.count() // CONTRACTED + 1

    def contract(batches):
        """Each node of a task's links to the smallest that it reaches over them."""
        got = pa.Table.from_batches(batches, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        names, at = np.unique(np.concatenate([got["u"].to_numpy(), got["v"].to_numpy()]), return_inverse=True)
        u, v = at[: len(got)], at[len(got) :]
        root = np.arange(len(names))
        while True:  # roots only fall; each round halves the length of chains of them
            low = root.copy()
            np.minimum.at(low, root[u], root[v])
            np.minimum.at(low, root[v], root[u])
            low = low[low[low]]
            if (low == root).all():
                break
            root = low
        moved = root != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], ["u", "v"])

    e = state.cut(links.coalesce(tasks).mapInArrow(contract, "u long, v long"))
    if tasks == 1:
        return e.coalesce(1).select(F.col("u").alias("id"), F.col("v").alias("root"))
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(e)
    while seen[0]:
        d = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = d.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = d.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = state.cut(e)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def own_shingles(docs: DataFrame, open_: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """id, n, small and own for the classes of `open_`: their size, the least size that their keys hold, and how many of their shingles no other class there holds.

    Shingles meet in buckets as 32-bit prints, which may make an own one look shared, never the other
    way.  Those that several classes of a batch hold are sent once a batch, so a hot one costs little.
    """
    wanted, ids = _gathered(open_.groupBy("id").agg(F.first("n").alias("n"), F.min("small").alias("small")))
    buckets = int(wanted.agg(F.sum("n")).first()[0] or 0) // COUNTED + 1
    counters = ids // COUNTERS + 1
    asked = _texts(docs, wanted.select("id"), 64 * ids, nodes, key, text)

    def send(batches):
        for batch in tc.each(batches):
            buf, off = tc.flat(batch.column(1))
            who, marks = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for a, b in tc.slabs(off):
                sets = [s if _set_mark(s) == m else s[:0] for s, m in zip(shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a]), marks[a:b], strict=True)]
                sizes = [len(s) for s in sets]
                h = np.concatenate(sets)
                _, at, c = np.unique(h, return_inverse=True, return_counts=True)
                once = c[at] == 1
                kind, place = corpus.bucket_of(h, buckets), np.repeat(np.arange(b - a), sizes)
                order = np.argsort(kind, kind="stable")
                rows = {"bucket": [], "data": []}
                for k, x, y in corpus.runs(kind[order]):
                    mine = order[x:y]
                    single, several = mine[once[mine]], np.unique(h[mine[~once[mine]]])
                    n = np.bincount(place[single], minlength=b - a)
                    rows["bucket"].append(k)
                    rows["data"].append(corpus.squeeze(who[a:b][n > 0], n[n > 0].astype(np.uint32), h[single].astype(np.uint32), several.astype(np.uint32)))
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), ("data", pa.binary())]))

    def settle(table: pa.Table) -> pa.Table:
        parts = [corpus.unsqueeze(x, 4) for x in table["data"].to_pylist()]
        ids, n, single = (np.concatenate([p[i] for p in parts]) for i in range(3))
        _, at, c = np.unique(np.concatenate([single, *[p[3] for p in parts]]), return_inverse=True, return_counts=True)
        own = np.bincount(np.repeat(np.arange(len(ids)), n), c[at[: len(single)]] == 1, len(ids)).astype(np.int64)
        to = corpus.group_of(ids, counters)
        order = np.argsort(to, kind="stable")
        return corpus.notes([(k, 0, corpus.squeeze(ids[order[x:y]], own[order[x:y]])) for k, x, y in corpus.runs(to[order])])

    def add(table: pa.Table) -> pa.Table:
        parts = [corpus.unsqueeze(x, 2) for x in table["data"].to_pylist()]
        ids, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return pa.table({"id": pa.array(ids), "own": pa.array(np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64))})

    dealt = asked.select("id", "text", "mark").mapInArrow(send, "bucket int, data binary")
    own = dealt.groupBy("bucket").applyInArrow(settle, corpus.NOTE).groupBy("g").applyInArrow(add, "id long, own long")
    return wanted.join(own, "id", "left").fillna(0, "own")


def prefixes(docs: DataFrame, left: DataFrame, nodes: DataFrame, key: str, text: str, per_cent: int) -> DataFrame:
    """key, place, id, n for the shingles in the prefixes of the classes `left` (id, n, small) that some other of them holds.

    A link with a class of m shingles takes an intersection of t / (1 + t) (n + m); if it leaves out
    k shingles, one of the k + 1 rarest is in it.  m is no less than `small` and t n.
    """
    wanted, ids = _gathered(left.select("id", "n", "small"))
    total = int(wanted.agg(F.sum("n")).first()[0] or 0)
    groups = buckets = total // COUNTED + 1
    asked = _texts(docs, wanted, 64 * ids, nodes, key, text)

    def sets(batches):
        for batch in tc.each(batches):
            buf, off = tc.flat(batch.column(2))
            ids, small, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            for a, b in tc.slabs(off):
                made = shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                mine = [(i, s) for i, s, m in zip(range(a, b), made, marks[a:b], strict=True) if _set_mark(s) == m]
                at = np.array([i for i, _ in mine], np.int64)
                to = corpus.group_of(ids[at], groups)
                order = np.argsort(to, kind="stable")
                rows = []
                for g, x, y in corpus.runs(to[order]):
                    part = order[x:y]
                    rows.append((g, 0, corpus.squeeze(ids[at[part]], small[at[part]], np.array([len(mine[k][1]) for k in part]), np.concatenate([mine[k][1] for k in part]))))
                yield from corpus.notes(rows).to_batches()

    def unpacked(table: pa.Table):
        parts = [corpus.unsqueeze(x, 4) for x in table["data"].to_pylist()]
        ids, small, n, h = (np.concatenate([p[i] for p in parts]) for i in range(4))
        return ids, small, n, h, *np.unique(h, return_inverse=True, return_counts=True)

    def count(table: pa.Table) -> pa.Table:
        g = table["g"][0].as_py()
        *_, u, _, c = unpacked(table)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*[(k, g, corpus.squeeze(u[x:y], c[x:y].astype(np.uint32))) for k, x, y in corpus.runs(corpus.bucket_of(u, buckets))], strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "g", "data"])

    def answer(table: pa.Table) -> pa.Table:
        parts = [corpus.unsqueeze(x, 2) for x in table["data"].to_pylist()]
        _, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        held = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.uint32)[at]
        ends = np.cumsum([len(p[0]) for p in parts])
        bucket = table["bucket"][0].as_py()
        return corpus.notes([(g, bucket, corpus.squeeze(held[e - len(p[0]) : e])) for g, p, e in zip(table["g"].to_pylist(), parts, ends, strict=True)])

    def rarest(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, small, n, h, u, at, _ = unpacked(left)
        told = sorted(zip(right["kind"].to_pylist(), right["data"].to_pylist(), strict=True))
        df = np.concatenate([corpus.unsqueeze(d, 1)[0] for _, d in told])[at]
        who = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, df, who))
        fewest = np.maximum(small, -(-n * per_cent // 100))
        must = -(-per_cent * (n + fewest) // (100 + per_cent))
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        pick = (place < np.repeat(n - must + 1, n)) & (df[order] > 1)
        return pa.table({"key": pa.array(h[order][pick].view(np.int64)), "place": pa.array(place[pick]), "id": pa.array(ids[who[pick]]), "n": pa.array(n[who[pick]].astype(np.int64))})

    dealt = asked.select("id", "small", "text", "mark").mapInArrow(sets, corpus.NOTE).groupBy("g")
    held = dealt.applyInArrow(count, OPEN).groupBy("bucket").applyInArrow(answer, corpus.NOTE)
    return dealt.cogroup(held.groupBy("g")).applyInArrow(rarest, "key long, place long, id long, n long")


def _open(keyed: DataFrame, roots: DataFrame, *more: str) -> DataFrame:
    """Rows (key, id, n, root, small) of the keys whose classes are in several components; `small` is the least size there."""
    few = roots.count() * 32 <= BROADCAST_BYTES
    placed = keyed.select("key", "id", "n", *more).join(F.broadcast(roots) if few else roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("small")).where("lo < hi").select("key", "small")
    return state.cut(placed.join(split, "key").select("key", "id", "n", "root", "small", *more))


def _across(open_: DataFrame, nodes: DataFrame, per_cent: int, most: int) -> DataFrame:
    """(a, b, estimate): pairs of different components that share a key in the part of their prefixes that counts for them, and are not ruled out; once for each key.

    In each key the classes outside its largest component ask; all classes are asked.  `most` bounds the number of classes.
    """
    per = open_.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    split = per.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    split = state.cut(split.select("key", "major", blocks(F.col("c") - F.col("most")).alias("ask_blocks"), blocks(F.col("c")).alias("blocks"), (F.col("c") - F.col("most")).alias("asking"), "c"))
    slots = int(split.agg(F.sum(F.col("c") * F.col("ask_blocks") + F.col("asking") * F.col("blocks"))).first()[0] or 0) // SLOT + 1
    placed = open_.join(split, "key").withColumn("minor", F.col("root") != F.col("major"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = placed.withColumn("j", block("blocks")).withColumn("i", all_("ask_blocks")).withColumn("asks", F.lit(False))
    asking = placed.where("minor").withColumn("i", block("ask_blocks")).withColumn("j", all_("blocks")).withColumn("asks", F.lit(True))
    rows = (
        asked.unionByName(asking).select("key", "i", "j", "asks", "minor", "id", "root", "n", "place")
        .join(_among(nodes.select("id", "sketch"), open_.select("id"), most), "id")
        .withColumn("slot", F.pmod(F.xxhash64("key", "i", "j"), F.lit(slots)))
    )

    def compare(table: pa.Table) -> pa.Table:
        ids, root, n, place, asks, minor, i, j, key = (table[c].to_numpy() for c in ("id", "root", "n", "place", "asks", "minor", "i", "j", "key"))
        s = _rows(table["sketch"])
        order = np.lexsort((ids, asks, j, i, key))
        name = np.stack([key[order], i[order], j[order]])
        cut = np.flatnonzero(np.concatenate(([True], (name[:, 1:] != name[:, :-1]).any(axis=0))))
        made = {"a": [np.zeros(0, np.int64)], "b": [np.zeros(0, np.int64)], "estimate": [np.zeros(0)]}
        wait_x, wait_y, waiting = [], [], 0

        def weigh() -> None:
            x, y = np.concatenate(wait_x), np.concatenate(wait_y)
            for lo in range(0, len(x), PAIRS):
                p, q = x[lo : lo + PAIRS], y[lo : lo + PAIRS]
                ok = possible(s[p], s[q], n[p], n[q], per_cent / 100)
                p, q = p[ok], q[ok]
                made["a"].append(np.maximum(ids[p], ids[q]))
                made["b"].append(np.minimum(ids[p], ids[q]))
                made["estimate"].append(estimate(s[p], s[q], n[p], n[q])[0])

        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            half = int(np.count_nonzero(~asks[order[a:b]]))
            asked, asking = order[a : a + half], order[a + half : b]
            for x in asking.tolist():
                y = asked[(root[asked] != root[x]) & (~minor[asked] | (ids[asked] < ids[x]))]
                must = -(-per_cent * (n[x] + n[y]) // (100 + per_cent))
                y = y[(place[x] <= n[x] - must) & (place[y] <= n[y] - must)]
                wait_x.append(np.full(len(y), x))
                wait_y.append(y)
                waiting += len(y)
                if waiting > 1 << 16:
                    weigh()
                    wait_x, wait_y, waiting = [], [], 0
        if waiting:
            weigh()
        return pa.table({k: pa.array(np.concatenate(v)) for k, v in made.items()})

    return rows.groupBy("slot").applyInArrow(compare, "a long, b long, estimate double")


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each row and band; 0 where the band has no shingle or the set is too large for the band."""
    raw = np.ascontiguousarray(s).view(np.uint64).reshape(len(s), BANDS, 2)
    used = (raw != 0).any(axis=2)
    used[(s > 0).sum(axis=1) >= LARGE, BANDS // 2 :] = False
    name = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(used, tc.mix(raw[:, :, 0] ^ tc.mix(raw[:, :, 1] + name)) | np.uint64(1), np.uint64(0)).view(np.int64)


def _named(first: DataFrame) -> tuple[DataFrame, bool]:
    """`first` with the id of each class's node, and whether some node's id is not a document's.

    That is the smallest document id; where different texts share it, one class has it and the others
    have hashes that are no other node's id.
    """
    lead = first.groupBy("rep").agg(F.min("mark").alias("lead"), F.count(F.lit(1)).alias("marks")).where("marks > 1").select("rep", "lead")
    if lead.isEmpty():
        return first.withColumn("node", F.col("rep")), False
    placed = first.join(lead, "rep", "left")
    salt = 0
    while True:
        named = placed.withColumn("node", F.when(F.col("lead").isNull() | (F.col("lead") == F.col("mark")), F.col("rep")).otherwise(F.xxhash64("rep", "mark", F.lit(salt)))).drop("lead")
        if named.groupBy("node").count().where("count > 1").isEmpty():
            return named, True
        salt += 1


def _linked(docs: DataFrame, nodes: DataFrame, key: str, text: str, per_cent: int) -> DataFrame:
    """(id, root) of the linked nodes that are not the smallest of their component."""
    threshold = per_cent / 100
    sure = lambda pairs: confirm(docs, pairs.select("a", "b"), nodes, key, text, per_cent)

    def bands(batches):
        for batch in tc.each(batches):
            k = band_keys(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, REGISTERS))
            row, col = np.nonzero(k)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(k[row.to_numpy(), col]), batch.column(0).take(row), batch.column(1).take(row)], ["key", "id", "n"])

    keyed = nodes.select("id", "n_shingles", "sketch").mapInArrow(bands, "key long, id long, n long")
    shared = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("key", "hub")
    keyed = state.cut(keyed.join(shared, "key"))
    vote = keyed.where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("c"))
    best = state.cut(vote.groupBy("id").agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("hub")))
    links = sure(plausible(best.select(F.col("id").alias("a"), F.col("hub").alias("b")), nodes, threshold))
    roots = components(links)

    open_ = _open(keyed, roots)
    if open_.isEmpty():
        return roots
    # an intersection with a class of `small` shingles or more, and no less than a link allows, that leaves out the own ones
    fewest = F.greatest("small", F.ceil(F.col("n") * per_cent / 100))
    alive = own_shingles(docs, open_, nodes, key, text).where((F.col("n") - F.col("own")) * (100 + per_cent) >= per_cent * (F.col("n") + fewest))
    alive, n = _gathered(alive.select("id", "n", "small", "own"))
    told = (F.broadcast if 32 * n <= BROADCAST_BYTES else lambda rows: rows)(alive.select("id", "own"))
    open_ = _open(open_.join(told, "id"), roots, "own")
    hubs = open_.groupBy("key").agg(F.min_by(F.struct(F.col("id").alias("hub"), F.col("root").alias("hub_root")), F.struct("own", "id")).alias("x")).select("key", "x.*")
    pairs = open_.join(hubs, "key").where("root <> hub_root").select("id", "hub").distinct().join(best, ["id", "hub"], "left_anti")
    links = links.unionByName(sure(plausible(pairs.select(F.col("id").alias("a"), F.col("hub").alias("b")), nodes, threshold)))
    roots = components(links)

    meet = _open(prefixes(docs, alive, nodes, key, text, per_cent), roots, "place")
    more = state.cut(_across(meet, nodes, per_cent, n).groupBy("a", "b").agg(F.max("estimate").alias("estimate")))
    tried = more.groupBy("a").agg(F.max_by("b", F.struct("estimate", "b")).alias("b"))
    while not more.isEmpty():
        links = links.unionByName(sure(tried))
        roots = components(links)
        at = lambda s: roots.select(F.col("id").alias(s), F.col("root").alias(f"root_{s}"))  # noqa: B023, E731
        more = more.join(tried, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
        tried = more = state.cut(more.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"))
    return roots


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", per_cent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    return _placed(docs, key, text, per_cent).drop("digest")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", per_cent: int = 75) -> DataFrame:
    """One row, with all its columns, of each near-duplicate group: of the rows with its smallest id that with the smallest text digest.

    Rows with a null id go.  Most rows are found by their id alone; ids that several rows share are told apart by digests.
    """
    placed = state.cut(_placed(docs, key, text, per_cent, digests=True))
    docs = docs.where(F.col(key).isNotNull())
    gone = placed.where("not kept").select(key).distinct()
    shared = state.cut(placed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("kept"), F.col("digest"))).alias("digest")).where("n > 1").select(key, "digest"))
    few = lambda ids: F.broadcast(ids) if 64 * ids.count() <= BROADCAST_BYTES else ids
    if shared.isEmpty():
        return docs.join(few(state.cut(gone)), key, "left_anti").select(docs.columns)
    single = docs.join(few(state.cut(gone.unionByName(shared.select(key)).distinct())), key, "left_anti").select(docs.columns)
    own = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    row = F.struct(*[F.col(c) for c in docs.columns])
    several = docs.select(F.col(key).cast("long").alias("_id"), own.alias("_own"), row.alias("_row")).join(few(shared.withColumnRenamed(key, "_id")), "_id").where("_own = digest")
    return single.unionByName(several.groupBy("_id").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*"))


def _placed(docs: DataFrame, key: str, text: str, per_cent: int, digests: bool = False) -> DataFrame:
    docs = corpus.usable(docs.select(key, text), key)
    s = state.cut(sketches(docs, key, text, digests))
    first = s.where("n_shingles > 0").groupBy("mark").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    first, renamed = _named(first)
    nodes = state.cut(s.join(first.select(F.col("rep").alias("id"), "mark", "node"), ["id", "mark"]).dropDuplicates(["id", "mark"]).select(F.col("node").alias("id"), F.col("id").alias("doc"), "mark", "n_shingles", "sketch"))
    roots = _linked(docs, nodes, key, text, per_cent)
    if renamed:  # a component is named by its smallest document
        roots = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
        name = roots.join(nodes.select("id", "doc"), "id").groupBy("root").agg(F.min("doc").alias("name"))
        roots = roots.join(name, "root").select("id", F.col("name").alias("root"))
    # classes of several rows, and those that have no id of their own, look up their root once, single rows their own
    classes = first.where("copies > 1 or node <> rep").select("mark", "rep", "node").join(roots.select(F.col("id").alias("node"), F.col("root").alias("class_root")), "node", "left").drop("node")
    placed = corpus.salted_join(s.select("id", "n_shingles", "mark", "digest"), classes, "mark", "id", "left").join(roots, "id", "left")
    group = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.coalesce("class_root", "rep", "root", "id"))
    return placed.select(F.col("id").alias(key), "n_shingles", group.alias("component_id"), (F.col("id") == group).alias("kept"), "digest")


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
