"""corpus_pipeline: every stage against brute force on its own input, and the whole run."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillgraph.llm import decontaminate, langid, packing

from .conftest import SHAPE, clashing
from .test_dedup import components_by_hand, repeats_by_hand
from .test_text import profile_by_hand


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """The fixture's documents, some in no language learned, some that hold a benchmark item, exactly or edited."""
    d = tmp_path_factory.mktemp("sf")
    item = " ".join(f"question{j} about" for j in range(20))
    edited = item.replace("question7 about", "something else").replace("question12", "query12")
    greek = " ".join("αβγδε"[k % 5] * 2 + "ζηθικ"[k % 3] for k in range(60))
    body = rows[20][1]
    more = [(400, f"{body} {item}", "en"), (401, f"{edited} {rows[23][1]}", "en"), (402, greek, None), (403, item, "en"), (700, rows[30][1], "en"), (700, "a text of its own under that id", "en"), (310, "x y\x85z w \x1c q", "en")]
    every = [*rows, *[(i, t, lang, "s", len(t)) for i, t, lang in more]]
    spark.createDataFrame(every, SHAPE).repartition(4).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, "nowhere to be found in any of these texts at all")], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def test_language_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    sums = {}
    for r in rows:
        if r["lang"] and r["text"] is not None and not (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1):
            sums[r["lang"]] = sums.get(r["lang"], 0) + profile_by_hand(r["text"])[0]

    def stays(t):
        v, some = profile_by_hand(t or "")
        return some and (len(t) < langid.SHORT or max(v @ s / np.linalg.norm(v) / np.linalg.norm(s) for s in sums.values()) >= langid.LEAST)

    got = cp.language_id(spark, docs, folder).collect()
    assert Counter(map(tuple, got)) == Counter(tuple(r) for r in rows if stays(r["text"]))
    assert {402, 300, 306} & {r["doc_id"] for r in got} == set()


def test_near_dedup_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    groups = defaultdict(set)
    for i, _, component in components_by_hand([(r["doc_id"], r["text"] or "") for r in rows]):
        groups[component].add(i)
    got = cp.near_dedup(spark, docs, folder).collect()
    # one row of each group, with its smallest id
    assert Counter(r["doc_id"] for r in got) == Counter(groups.keys())
    assert set(map(tuple, got)) <= set(map(tuple, rows))
    assert {r["text"] for r in got if r["doc_id"] == 700} == {"a text of its own under that id"}
    single = docs.where("doc_id not in (103, 303, 310, 700)")  # without ids that several rows share
    known = [(r["doc_id"], r["text"] or "") for r in single.collect()]
    assert Counter(r["doc_id"] for r in cp.near_dedup(spark, single, folder).collect()) == Counter({c for _, _, c in components_by_hand(known)})
    extra = clashing(docs)
    assert cp.near_dedup(spark, extra, folder).columns == extra.columns


def test_substring_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null")
    got = cp.substring_dedup(spark, docs, folder)
    want = repeats_by_hand(sorted((r["doc_id"], r["text"] or "") for r in docs.collect()), 20)
    assert got.dtypes == docs.dtypes
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()) == Counter((i, t, len(t)) for i, _, _, t in want)


def test_decontamination_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null and doc_id <> 307")
    item = next(r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["item_id"] == 1)
    clean = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})

    def best(t):
        a, b = item.lower().translate(clean).split(), t.lower().translate(clean).split()
        h = [0] * (len(b) + 1)
        top = 0
        for x in a:
            old = h[:]
            for j, y in enumerate(b, 1):
                h[j] = max(0, old[j - 1] + (2 if x == y else -1), old[j] - 1, h[j - 1] - 1)
                top = max(top, h[j])
        return top / (2 * len(a))

    rows = docs.collect()
    gone = {r["doc_id"] for r in rows if best(r["text"] or "") >= 0.5}
    assert gone == {400, 401, 403}
    got = cp.decontamination(spark, docs, folder)
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r) for r in rows if r["doc_id"] not in gone)
    assert decontaminate.SHORTEST == 3


def test_packing_stage_and_run(spark, folder, nothing, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    got = cp.run(spark, folder).cache()
    # the stages one after another are what run does
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    tokens = {}
    for r in docs.collect():
        tokens.setdefault(r["doc_id"], []).append(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1)
    pieces = Counter((i, k) for i, ns in tokens.items() for n in ns for k in range(math.ceil(n / packing.LENGTH)))
    assert Counter((r["doc_id"], r["piece"]) for r in got.collect()) == pieces
    assert got.agg(F.sum("length")).first()[0] == sum(n for ns in tokens.values() for n in ns)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n > 4096 or n <> end").count() == 0
    got.unpersist()
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]
