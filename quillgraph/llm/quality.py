"""Quality rules (operator 1): a decision list learned by sequential covering.

``statistics`` measures every text in one scan.  ``learn`` grows conjunctions of thresholds on
labelled statistics: each rule starts empty, takes the condition of highest information gain on
two thirds of the remaining rows until it covers no good document (or four conditions), then drops
final conditions as long as that raises its worth on the other third.  Rows that a rule covers
leave, and rules are added while their precision on the pruning rows is LEAST_PRECISION at least.  The list
is emitted as one ordered Spark conditional, so judging is part of the scan.

The labelled sample is bounded: documents are taken by hash of their id so that about
``SAMPLE_ROWS`` labelled ones are expected.  Everything else covers all rows.

Edge cases: null texts have no words and fail the base rules; null labels are ignored; without
labels of both kinds the list is empty and the base rules decide alone; rows with a null id are
judged but never learned from; rows that share an id are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import state
from . import textcore as tc

SAMPLE_ROWS = 20_000
LEAST_PRECISION = 0.8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
#: Features that rules may use; each is a ratio, so that length alone never decides.
FEATURES = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}
_is = lambda signs: np.isin(np.arange(256), list(signs))
_START = ~((np.arange(256) & 0xC0) == 0x80)
_SYMBOL, _UPPER, _DIGIT, _MARK = _is(SYMBOLS), _is(range(65, 91)), _is(range(48, 58)), _is(b"!?{}[]=_~^\\")


def _per(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask)))[off])


def _repeated(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values with their documents: which occur again in the same one, and which are not its first."""
    salted = tc.mix(h ^ tc.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(salted, kind="stable")
    s = salted[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    later, any_ = np.zeros(len(s), bool), np.zeros(len(s), bool)
    later[order] = same
    any_[order] = same | np.append(same[1:], False)[: len(s)]
    return any_, later


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each document."""
    n = len(off) - 1
    s, e, woff = tc.words(buf, off)
    inside = tc.IS_WORD[buf]
    out = {"n_words": np.diff(woff), "word_chars": _per(inside & _START[buf], off), "n_symbols": _per(_SYMBOL[buf], off)}
    # lines: what stands between line feeds, the rest after the last one included
    feed = np.flatnonzero(buf == 10)
    doc = np.searchsorted(off, feed, "right") - 1
    begin = np.concatenate((off[:-1], feed + 1))
    end = np.concatenate((off[1:], feed))
    owner = np.concatenate((np.arange(n), doc))
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.concatenate((begin[1:] - 1, off[-1:]))
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    end[last] = off[1:][owner[last]]
    total = np.concatenate(([0], np.cumsum(inside)))
    real = total[end] > total[begin]
    begin, end, owner = begin[real], end[real], owner[real]
    _, later = _repeated(tc.spans_hash(buf, begin, end), owner)
    out["n_dup_lines"] = np.bincount(owner[later], minlength=n)
    h = tc.spans_hash(buf, s, e)
    at = np.flatnonzero(tc.window_starts(woff, 3))
    word_doc = np.repeat(np.arange(n), np.diff(woff))
    cover = np.zeros(len(h), bool)
    if len(at):
        again, _ = _repeated(tc.rolling(h, 3)[at], word_doc[at])
        for k in range(3):
            cover[at[again] + k] = True
    out["n_repeat_words"] = np.bincount(word_doc[cover], minlength=n)
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_upper"], out["n_digits"], out["n_marks"] = _per(_UPPER[buf], off), _per(_DIGIT[buf], off), _per(_MARK[buf], off)
    return out


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and COUNTS of every row."""
    state.tune(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for batch in tc.each(batches):
            buf, off = tc.flat(batch.column(1))
            parts = [measure(buf[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in tc.slabs(off)]
            cols = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [key, *COUNTS])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        a, b = FEATURES[self.feature]
        value = F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _covers(rule, x, n) -> np.ndarray:
    got = np.ones(n, bool)
    for c in rule:
        got &= c.holds(x)
    return got


def _grow(x, bad, most: int, cuts: int) -> list[Condition]:
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while len(rule) < most and (~bad[live]).any():
        p0, n0 = bad[live].sum(), (~bad[live]).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for f, v in x.items():
            mine = v[live]
            for t in np.unique(np.concatenate((np.quantile(mine, np.linspace(0, 1, cuts + 2)[1:-1]), np.quantile(mine[bad[live]], np.linspace(0, 1, cuts + 2))))):
                high = mine > t
                for above, got in ((True, high), (False, ~high)):
                    p = (got & bad[live]).sum()
                    n = got.sum() - p
                    if p >= 3 and (gain := p * (np.log2(p / (p + n)) - base)) > best[0] + 1e-9:
                        best = (gain, Condition(f, above, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= best[1].holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 24, most_conditions: int = 4, cuts: int = 24, seed: int = 1) -> list[list[Condition]]:
    """Ordered rules, each a conjunction that says "bad"."""
    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(bad))
    prune = np.zeros(len(bad), bool)
    prune[order[: len(bad) // 3]] = True
    left = np.ones(len(bad), bool)
    rules: list[list[Condition]] = []
    while len(rules) < most_rules:
        a, b = left & ~prune, left & prune
        if bad[a].sum() < 3:
            break
        rule = _grow({f: v[a] for f, v in x.items()}, bad[a], most_conditions, cuts)
        part, truth = {f: v[b] for f, v in x.items()}, bad[b]

        def worth(r, part=part, truth=truth) -> float:
            got = _covers(r, part, len(truth))
            p, n = (got & truth).sum(), (got & ~truth).sum()
            return (p - n) / max(p + n, 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule or worth(rule) < 2 * LEAST_PRECISION - 1:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def ratios(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f: np.where(counts[b] > 0, counts[a] / np.maximum(counts[b], 1), 0.0) for f, (a, b) in FEATURES.items()}


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        hit = rule[0].column()
        for c in rule[1:]:
            hit = hit & c.column()
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learn_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """Rules for label 0, from a bounded sample of labelled rows."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("given"))
    every = max(1, -(-known.count() // sample_rows))
    taken = lambda d: d.where(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(every)) == 0)
    rows = statistics(taken(docs.where(F.col(key).isNotNull())), key, text).join(taken(known), key).select("given", *COUNTS).limit(2 * sample_rows).toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values(list(rows.columns), kind="stable")
    bad = rows["given"].to_numpy() == 0
    return learn(ratios({c: rows[c].to_numpy() for c in COUNTS}), bad) if bad.any() and not bad.all() else []


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[list[Condition]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, COUNTS, base_failed, rule (0: none) and kept for every row."""
    return statistics(docs, key, text).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
