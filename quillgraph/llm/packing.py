"""Packing documents into training sequences (operator 10): vector best-fit.

``tokenize`` turns each document into subword ids, an end id after it, and cuts what is longer
than a sequence into whole sequences and a rest.  ``pack`` places the pieces: a bin has three
capacities, tokens, documents and attention cost (the sum of squared lengths), and a piece goes to
the open bin that satisfies all three and scores best, by the weighted norm of what would be left
(``rule="norm"``) or by the weighted dot product of the piece and what is left (``rule="dot"``).

Pieces are placed longest first, in groups of about ``GROUP_PIECES`` dealt by hash, whose number
follows a count of the pieces.  What the groups leave in bins under ``FULL`` is dealt anew by
another hash, until one group holds it all or a round no longer saves one bin in ``GAIN``: then
the pieces fill no bin (as when all are longer than half a sequence), and meeting in one task would
not help them.  So the number of groups costs next to no sequences, and no group grows with the
corpus.  Only ids and lengths are shuffled.  Tokenising keeps a bounded table of the tokens of white-space separated chunks: the
vocabulary's own rules never join signs across white space, so chunks can be encoded alone.

Edge cases: null and empty texts are one end id; rows with a null id are left out; rows that share
an id are packed each (their texts tell them apart only by `ids_crc32`); other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus, merges, state
from . import textcore as tc

END, LENGTH = 1, 4096
GROUP_PIECES = 4_000
#: A bin filled to this share stays as it is; the pieces of others are placed again with those of other groups.
FULL = 0.98
#: Bins under FULL are placed again as long as that saves one of so many.
GAIN = 50
#: Chunks whose tokens a Python worker remembers; others are encoded again when they come.
CACHE = 300_000
_loaded: dict[str, Chunks] = {}
_PAUSE, _LETTER = np.isin(np.arange(256), list(b".,!?;:")), np.isin(np.arange(256), range(97, 123))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Chunks:
    """Token ids of white-space separated chunks.  The first `cache` of them are remembered, by 64-bit hash."""

    PROBES = 4

    def __init__(self, path: str, cache: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = merges.merges(path)
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.cache = cache
        self.bits = int(cache * 3).bit_length()
        self.keys = np.zeros((1 << self.bits) + self.PROBES, np.uint64)
        self.values = np.zeros(len(self.keys), np.int32)
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def fresh(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and where each ends: what `merges` does not know, the tokenizer encodes."""
        good, size = np.zeros(len(new), bool), np.zeros(len(new), np.int64)
        joined = np.zeros(0, np.uint32)
        if self.merges and new:
            good, joined, many = self.merges.known(np.frombuffer(b"".join(new), np.uint8), np.cumsum([0, *map(len, new)]))
            size[good] = many
        rest = self._each([w.decode() for w, g in zip(new, good.tolist(), strict=True) if not g]) if not good.all() else []
        size[~good] = [len(x) for x in rest]
        stop = np.cumsum(size)
        ids = np.empty(int(stop[-1]) if len(stop) else 0, np.uint32)
        mine = np.repeat(good, size)
        ids[mine] = joined
        ids[~mine] = [t for x in rest for t in x]
        return ids, stop

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each remembered chunk, -1 for others."""
        slot = self._slot(h)
        got = np.where(self.keys[slot] == h, self.values[slot], -1)
        for p in range(1, self.PROBES):
            miss = np.flatnonzero(got < 0)
            at = slot[miss] + p
            hit = self.keys[at] == h[miss]
            got[miss[hit]] = self.values[at[hit]]
        return got

    def remember(self, h: np.ndarray, first: int) -> None:
        number = np.arange(first, first + len(h), dtype=np.int32)
        for p in range(self.PROBES):
            at = self._slot(h) + p
            _, one = np.unique(at, return_index=True)
            one = one[self.keys[at[one]] == 0]
            self.keys[at[one]], self.values[at[one]] = h[one], number[one]
            rest = np.ones(len(h), bool)
            rest[one] = False
            h, number = h[rest], number[rest]

    def encode(self, buf: np.ndarray, off: np.ndarray, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids, `end` after each text unless None, and each text's offset."""
        low = tc.LOWER[buf]
        cut = np.zeros(len(low), bool)
        # where a letter meets one of these signs the vocabulary's rules always cut, so chunks may be cut there
        cut[1:] = _PAUSE[low[1:]] & _LETTER[low[:-1]]
        s, e, woff = tc.words(low, off, cut)
        h = tc.spans_hash(low, s, e) | np.uint64(1)
        at = self.find(h)
        start, ids = self.start, self.ids
        if len(miss := np.flatnonzero(at < 0)):
            n = len(start) - 1
            new, where, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            raw = low.tobytes()
            where = miss[where]
            more, stop = self.fresh([raw[a:b] for a, b in zip(s[where].tolist(), e[where].tolist(), strict=True)])
            at[miss] = n + inverse
            start, ids = np.concatenate([start, start[-1] + stop]), np.concatenate([ids, more])
            if n + len(new) <= self.cache:
                self.start, self.ids = start, ids
                self.remember(new, n)
        size = start[at + 1] - start[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        source = np.arange(ends[-1]) + np.repeat(start[at] - ends[:-1], size)
        doc = ends[woff]
        if end is None:
            return ids[source], doc
        out = np.full(len(source) + len(doc) - 1, end, np.uint32)
        room = np.ones(len(out), bool)
        room[doc[1:] + np.arange(len(doc) - 1)] = False
        out[room] = ids[source]
        return out, doc + np.arange(len(doc))


def chunks(path: str, cache: int | None = None) -> Chunks:
    """A worker's table for a vocabulary; asked for with another size, it is made anew."""
    cache = cache or CACHE
    if path not in _loaded or _loaded[path].cache != cache:
        _loaded[path] = Chunks(path, cache)
    return _loaded[path]


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 and, if asked for, the ids of every piece."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        made = chunks(path)
        for batch in tc.each(batches):
            who = batch.column(0).to_numpy(zero_copy_only=False)
            buf, off = tc.flat(batch.column(1))
            for a, b in tc.slabs(off):
                ids, at = made.encode(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                n = np.diff(at)
                pieces = -(-n // length)
                doc = np.repeat(np.arange(b - a), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * length
                size = np.minimum(length, n[doc] - start)
                begin = at[doc] + start
                parts = [ids[x : x + y].astype("<u4").tobytes() for x, y in zip(begin.tolist(), size.tolist(), strict=True)]
                cols = [who[a:b][doc].astype(np.int64), number.astype(np.int32), start, size, np.array([zlib.crc32(p) for p in parts], np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *([pa.array(parts, pa.binary())] * with_ids)], [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    shape = f"`{key}` long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return corpus.usable(docs.select(key, text), key).mapInArrow(run, shape)


def best_fit(size: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the given order."""
    cap = np.array(capacity, np.float64)
    w = np.array(weights, np.float64)
    free = np.zeros((3, len(size) + 1))
    name = np.zeros(len(size) + 1, np.int64)
    opened = live = 0
    where, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    least = np.minimum.accumulate(size[::-1])[::-1] if len(size) else size
    for i, s in enumerate(size.tolist()):
        need = np.array([s, 1.0, float(s) * s])
        if (need > cap).any():
            raise ValueError(f"a piece of {s} tokens fits no sequence")
        left = free[:, :live] - need[:, None]
        ok = np.flatnonzero((left >= 0).all(axis=0))
        if len(ok):
            part = left[:, ok] / cap[:, None]
            best = ((w[:, None] * part * part).sum(axis=0)).argmin() if rule == "norm" else (w[:, None] * (need / cap)[:, None] * free[:, ok] / cap[:, None]).sum(axis=0).argmax()
            k = ok[best]
        else:
            k, live = live, live + 1
            free[:, k], name[k] = cap, opened
            opened += 1
        where[i], offset[i] = name[k], cap[0] - free[0, k]
        free[:, k] -= need
        if i + 1 < len(size) and (free[0, k] < least[i + 1] or free[1, k] < 1 or free[2, k] < float(least[i + 1]) ** 2):
            live -= 1  # nothing to come fits
            free[:, k], name[k] = free[:, live], name[live]
    return where, offset


def _placer(first: int, names: list[str], capacity, weights, rule: str):
    """What places one group; its sequences are numbered from its own number, counted from `first`."""

    def run(table: pa.Table) -> pa.Table:
        g = first + table["dealt_to"][0].as_py()
        table = table.select(names).sort_by([("length", "descending"), (names[0], "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        size = table["length"].to_numpy()
        where, offset = best_fit(size, capacity, weights, rule)
        fill = np.bincount(where, size).astype(np.int64)[where]
        return table.append_column("sequence_id", pa.array((np.int64(g) << 32) + where)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    return run


def place(pieces: DataFrame, length: int = LENGTH, most_documents: int | None = None, most_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> DataFrame:
    """The pieces with sequence_id and offset.  The caps on documents and cost bind only where given below what `length` implies."""
    capacity = (float(length), float(most_documents or length), float(most_cost or length * length))
    names = pieces.columns
    key = names[0]
    shape = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long, fill long"
    left, count, first, done, bins, turn = pieces, pieces.count(), 0, None, None, 0
    while True:
        groups = count // GROUP_PIECES + 1
        dealt = left.withColumn("dealt_to", F.pmod(F.xxhash64(key, "piece", "ids_crc32", F.lit(turn)), F.lit(groups)).cast("int"))
        placed = dealt.groupBy("dealt_to").applyInArrow(_placer(first, names, capacity, weights, rule), shape)
        if groups == 1:
            return (placed if done is None else done.unionByName(placed)).drop("fill")
        placed = state.cut(placed)
        loose = F.col("fill") < FULL * length
        count, now = placed.where(loose).agg(F.count(F.lit(1)), F.count(F.when(F.col("offset") == 0, 1))).first()
        if not count or (bins is not None and now > bins - bins // GAIN - 1):
            return (placed if done is None else done.unionByName(placed)).drop("fill")
        full = placed.where(~loose)
        done = full if done is None else done.unionByName(full)
        left, bins, first, turn = placed.where(loose).select(names), now, first + groups, turn + 1


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str | None = None, with_ids: bool = False, **limits) -> DataFrame:
    """Tokenise, write the pieces to the shared folder, and place them."""
    return place(state.cut(tokenize(docs, key, text, length, vocabulary, with_ids)), length, **limits)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
