"""Language identification (operator 9): hyperdimensional letter profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A trigram is the product
of its letters' vectors, the second permuted once and the third twice; a text is the sum over its
trigrams.  What is not a letter is one boundary sign.  A language's prototype bundles all its
training texts; a text belongs to the prototype of highest cosine.

Training is one scan: each task sums its texts by language, and the partial sums (a vector for each
language and task) are added by coordinate, pre-aggregated.  Only the prototypes reach the driver;
their number is bounded by ``MOST_LANGUAGES``.  Prediction is a scan without shuffle.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is everything if
nothing was there to learn from; a null id is judged like any other; equal cosines go to the first
language by name; only key, text and language columns are read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import state
from . import textcore as tc

DIMENSIONS, SEED = 1024, 9
MOST_LANGUAGES = 4096
#: The cosine of a text that looks like no language learned strays from 0 by 1 / sqrt(DIMENSIONS): four times that.
LEAST = 4 / DIMENSIONS**0.5
#: Texts of fewer signs are not judged by their cosine.
SHORT = 20
#: Bytes of text whose profiles are made at once.
PORTION = 1 << 19
UNKNOWN = "und"
_shift = np.random.Generator(np.random.PCG64(SEED)).permutation(DIMENSIONS)
_letters: dict[int, np.ndarray] = {}
_alpha: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _alpha[0]


def letter(code: int) -> np.ndarray:
    """The letter's vector; 0 is the boundary."""
    if code not in _letters:
        _letters[code] = (np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMENSIONS) * 2 - 1).astype(np.int8)
    return _letters[code]


def profiles(texts: list[str | None], ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each text, and whether it has a letter; without `ends` a text's first and last sign touch no boundary."""
    parts = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    code = np.frombuffer(b"".join(parts), np.uint32)
    size = np.array([len(p) // 4 for p in parts], np.int64)
    code = np.where(is_letter()[code], code, 0)
    alphabet, c = np.unique(code, return_inverse=True) if len(code) < 4096 else _alphabet(code)
    doc = np.repeat(np.arange(len(texts)), size)
    some = np.bincount(doc[code > 0], minlength=len(texts)) > 0
    # a boundary before the first and after the last sign of each text
    zero = np.searchsorted(alphabet, 0) if 0 in alphabet else len(alphabet)
    a = len(alphabet) + (zero == len(alphabet))
    end = np.cumsum(size)
    x, owner = c, doc
    if ends and len(c):
        edges = np.stack((end - size, end), axis=1).ravel()  # in the order of the texts: one's end stands before the next one's start
        x = np.insert(c, edges, zero)
        owner = np.insert(doc, edges, np.repeat(np.arange(len(texts)), 2))
    if len(x) < 3:
        return np.zeros((len(texts), DIMENSIONS), np.float32), some
    gram = (x[:-2].astype(np.int64) * a + x[1:-1]) * a + x[2:]
    owner = owner[:-2][ok := (owner[:-2] == owner[2:]) & (gram != (zero * a + zero) * a + zero)]
    gram = gram[ok]
    if a**3 <= 1 << 20:
        here = np.bincount(gram, minlength=a**3) > 0
        vocab = np.flatnonzero(here)
        rank = np.cumsum(here) - 1
        gram = rank[gram]
    else:
        vocab, gram = np.unique(gram, return_inverse=True)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    codes = [int(v) for v in alphabet] + [0]
    base = np.stack([letter(v) for v in codes[:a]])
    once, twice = base[:, _shift], base[:, _shift][:, _shift]
    for lo in range(0, len(vocab), 4096):
        v = vocab[lo : lo + 4096]
        vectors = (base[v // (a * a)] * once[v // a % a] * twice[v % a]).astype(np.float32)
        mine = (gram >= lo) & (gram < lo + 4096)
        counts = np.bincount(owner[mine] * len(v) + gram[mine] - lo, minlength=len(texts) * len(v)).reshape(len(texts), -1)
        out += counts.astype(np.float32) @ vectors
    return out, some


def _alphabet(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    here = np.zeros(int(code.max()) + 1, bool)
    here[code] = True
    return np.flatnonzero(here), (np.cumsum(here) - 1)[code]


def portions(column: pa.Array, signs: int = PORTION):
    """(from, to, vectors, whether it has a letter) for runs of whole texts of about so many bytes.

    A longer text is summed over pieces that share two signs, so that every trigram is in one of them.
    """
    off = tc.flat(column)[1]
    for a, b in tc.slabs(off, signs):
        for lo in range(a, b, 1024):
            hi = min(lo + 1024, b)
            if off[hi] - off[lo] <= signs:
                yield lo, hi, *profiles(column.slice(lo, hi - lo).to_pylist())
                continue
            t = f"\0{column[lo].as_py().lower()}\0"
            v, some = np.zeros((1, DIMENSIONS), np.float64), np.zeros(1, bool)
            for at in range(0, max(1, len(t) - 2), signs):
                part, known = profiles([t[at : at + signs + 2]], ends=False)
                v += part
                some |= known
            yield lo, hi, v.astype(np.float32), some


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def prototypes(labelled: DataFrame, text: str, lang: str) -> dict[str, np.ndarray]:
    """The unit prototype of each language, from every row."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in tc.each(batches):
            names = np.array(batch.column(1).to_pylist(), object)
            for a, b, v, _ in portions(batch.column(0)):
                for name in set(names[a:b]):
                    sums[name] = sums.get(name, 0) + np.rint(v[names[a:b] == name].sum(axis=0, dtype=np.float64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    state.tune(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)
    parts = rows.mapInArrow(run, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x"))
    whole = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    got = whole.limit(MOST_LANGUAGES + 1).collect()
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for r in sorted(got, key=lambda r: r["lang"]):
        v = np.array([x["x"] for x in r["v"]], np.float64)
        if v.any():
            out[r["lang"]] = (v / np.linalg.norm(v)).astype(np.float32)
    return out


def predict(docs: DataFrame, learned: dict[str, np.ndarray], key: str, text: str) -> DataFrame:
    """key, lang_pred, score (the cosine, 0 at least) for every row."""
    names = list(learned)
    matrix = np.stack(list(learned.values())) if names else np.zeros((1, DIMENSIONS), np.float32)
    state.tune(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches):
        names, matrix = shipped.value
        for batch in tc.each(batches):
            lang, score = [], []
            for a, b, v, some in portions(batch.column(1)):
                cosine = v @ matrix.T / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
                best = cosine.argmax(axis=1)
                known = some if names else np.zeros(b - a, bool)
                lang += [names[k] if y else UNKNOWN for k, y in zip(best, known, strict=True)]
                score.append(np.where(known, np.clip(cosine[np.arange(b - a), best], 0, 1), 0).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], [key, "lang_pred", "score"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text", least: float = LEAST, short: int = SHORT) -> DataFrame:
    """The rows, with all their columns, whose text has a letter and a cosine of at least `least` with some prototype.

    Texts of fewer than `short` signs say too little and stay if they have a letter, as do all if nothing was learned.
    """
    matrix = np.stack(list(learned.values())) if learned else np.zeros((0, DIMENSIONS), np.float32)
    state.tune(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        matrix = shipped.value
        for batch in tc.each(batches):
            keep = [np.zeros(0, bool)]
            brief = pc.less(pc.utf8_length(batch.column(text)), short).fill_null(True).to_numpy(zero_copy_only=False)
            for a, b, v, some in portions(batch.column(text)):
                if len(matrix):
                    some = some & (brief[a:b] | ((v @ matrix.T).max(axis=1) >= least * np.linalg.norm(v, axis=1)))
                keep.append(some)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, then judge all: key, held_out, lang_pred, score."""
    learned = prototypes(docs.where(~held_out(key)), text, lang)
    return predict(docs, learned, key, text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
