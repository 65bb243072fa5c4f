"""Documents dealt into groups once, and the exchanges between groups and buckets.

Several operators ask, for each piece of each document, what the rest of the corpus
holds.  They share this shape:

``packed``   one row for each (input batch, group): the batch's documents of that group,
             compressed together.  A document's group follows from its id alone, so a
             group can be made again anywhere, in the same order, by any stage.
phase        ``packed`` by group -> fingerprints, packed by (bucket, group)
answer       fingerprints by bucket -> what each group needs to know, by (group)
next phase   ``packed`` and the answers by group -> ...

All phases of one operator hang on the same ``packed`` subtree, so Spark shuffles the
texts once and reuses that exchange; a lost executor recomputes its share from lineage.
Group and bucket counts follow the bytes measured, so no group grows with the corpus.
"""

from __future__ import annotations

import hashlib
import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import state
from . import textcore as tc

PACKED = "g int, docs binary, text binary"
#: What one side tells the other: `kind` tells notes apart, `data` is theirs alone.
NOTE = "g int, kind int, data binary"


@dataclass(frozen=True)
class Plan:
    """How a corpus is dealt out."""

    groups: int
    buckets: int
    total_bytes: int
    rows: int


def shuffle_width(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def measure(docs: DataFrame, text: str, group_bytes: int = 4 << 20) -> Plan:
    """One narrow job: how many bytes of text there are, hence how many groups and buckets."""
    got = docs.agg(F.sum(F.octet_length(F.col(text))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total, rows = int(got["b"] or 0), int(got["n"])
    width = shuffle_width(docs)
    return Plan(max(width, total // group_bytes + 1), max(width, total // (8 << 20) + 1), total, rows)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    out = io.BytesIO()
    for a in arrays:
        np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unsqueeze(block: bytes, n: int) -> list[np.ndarray]:
    src = io.BytesIO(zstandard.ZstdDecompressor().decompress(block))
    return [np.lib.format.read_array(src, allow_pickle=False) for _ in range(n)]


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (tc.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B)) % np.uint64(groups)).astype(np.int32)


def ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def pack(docs: DataFrame, key: str, text: str, groups: int) -> DataFrame:
    """Rows of PACKED: `docs` has every column but the text, `text` the lengths and bytes, both compressed."""

    def run(batches):
        deflate = zstandard.ZstdCompressor(level=1)
        for batch in tc.each(batches):
            table = pa.Table.from_batches([batch])
            ids = table.column(key).to_numpy()
            g = group_of(ids, groups)
            order = np.lexsort((ids, g))
            table, g = table.take(pa.array(order)), g[order]
            buf, off = tc.flat(table.column(text))
            rest = table.drop_columns([text])
            cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else []
            rows = {"g": [], "docs": [], "text": []}
            for a, b in zip(cut, [*cut[1:], len(g)], strict=True):
                rows["g"].append(int(g[a]))
                rows["docs"].append(deflate.compress(ipc(rest.slice(a, b - a))))
                body = buf[off[a] : off[b]].tobytes()
                rows["text"].append(deflate.compress(np.int64(b - a).tobytes() + np.diff(off[a : b + 1]).astype(np.int64).tobytes() + body))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("g", pa.int32()), ("docs", pa.binary()), ("text", pa.binary())]))

    return docs.mapInArrow(run, PACKED)


@dataclass
class Group:
    """A group's documents, by id; rows that share an id stand in the order of their texts."""

    g: int
    table: pa.Table
    ids: np.ndarray
    buf: np.ndarray
    off: np.ndarray

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def unpack(table: pa.Table, key: str) -> Group | None:
    tc.give_back()  # what the group before took
    if not table.num_rows:
        return None
    inflate = zstandard.ZstdDecompressor()
    parts, texts = [], []
    for d, t in zip(table.column("docs").to_pylist(), table.column("text").to_pylist(), strict=True):
        parts.append(pa.ipc.open_stream(inflate.decompress(d)).read_all())
        raw = inflate.decompress(t)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        end = 8 + 8 * n + np.cumsum(np.frombuffer(raw, np.int64, n, 8))
        texts += [raw[a:b] for a, b in zip([8 + 8 * n, *end[:-1]], end, strict=True)]
    rest = pa.concat_tables(parts)
    ids = rest.column(key).to_numpy()
    order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])), np.int64)
    texts = [texts[i] for i in order]
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return Group(table.column("g")[0].as_py(), rest.take(pa.array(order)), ids[order], np.frombuffer(b"".join(texts), np.uint8), off)


def notes(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    g, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"g": pa.array(g, pa.int32()), "kind": pa.array(kind, pa.int32()), "data": pa.array(data, pa.binary())})


def read_notes(table: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for k, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        out.setdefault(k, []).append(d)
    return out


#: Kind of the notes that name a group's repeated documents.
COPIES = -1


def salted_join(rows: DataFrame, groups: DataFrame, key: str, by: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """Rows joined to one row per key, each key's rows dealt to `salts` places by the column `by`: one key may hold any share of the rows."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def copies(docs: DataFrame, key: str, text: str, groups: int) -> DataFrame:
    """NOTE rows with id and digest of each document whose whole text some smaller id has too.

    Equal texts meet by digest: one pre-aggregated shuffle for the smallest id, one salted join back.
    The notes go to the ids' groups; the digest tells the texts of rows that share an id apart.
    """
    slim = docs.select(F.col(key).alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    first = slim.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
    later = salted_join(slim, first, "digest", "id").where("id > first").select("id", F.unhex("digest").alias("digest"))

    def run(batches):
        for batch in tc.each(batches):
            ids = batch.column(0).to_numpy()
            g = group_of(ids, groups)
            order = np.argsort(g, kind="stable")
            digests = np.frombuffer(b"".join(batch.column(1).to_pylist()), "V32")[order]
            ids, g = ids[order], g[order]
            cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else []
            yield from notes([(int(g[a]), COPIES, squeeze(ids[a:b], digests[a:b])) for a, b in zip(cut, [*cut[1:], len(g)], strict=True)]).to_batches()

    return later.mapInArrow(run, NOTE)


def is_copy(doc: Group, told: dict[int, list[bytes]]) -> np.ndarray:
    """Which of a group's documents repeat a smaller id's whole text."""
    named = set()
    for note in told.get(COPIES, []):
        ids, digests = unsqueeze(note, 2)
        named |= set(zip(ids.tolist(), digests.tolist(), strict=True))
    out = np.zeros(len(doc.ids), np.bool_)
    for i in np.flatnonzero(np.isin(doc.ids, [i for i, _ in named])).tolist():
        out[i] = (int(doc.ids[i]), hashlib.sha256(doc.text(i)).digest()) in named
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in the hash, so a sorted vector falls into runs."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def runs(sorted_buckets: np.ndarray):
    """(bucket, from, to) for each run of a sorted vector."""
    if len(sorted_buckets):
        cut = np.flatnonzero(np.concatenate(([True], sorted_buckets[1:] != sorted_buckets[:-1])))
        for a, b in zip(cut, [*cut[1:], len(sorted_buckets)], strict=True):
            yield int(sorted_buckets[a]), int(a), int(b)


def covered(begins: np.ndarray, length: int) -> np.ndarray:
    """Which places lie in a run of `length` that begins where `begins` says."""
    total = np.concatenate((np.zeros(length, np.int64), np.cumsum(begins)))
    return total[length:] > total[: len(begins)]


def schema_with(docs: DataFrame, without: set[str], extra: list[T.StructField]) -> tuple[T.StructType, list[str]]:
    """The columns an operator hands on: the input's, less `without` and those its own would clash with, then its own."""
    own = {f.name.lower() for f in extra} | {w.lower() for w in without}
    keep = [f for f in docs.schema.fields if f.name.lower() not in own]
    return T.StructType([*keep, *extra]), [f.name for f in keep]


def usable(docs: DataFrame, key: str) -> DataFrame:
    """Rows with a key, as a long; rows without one cannot be named and are left out everywhere."""
    state.tune(docs.sparkSession)
    return docs.where(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("long"))
