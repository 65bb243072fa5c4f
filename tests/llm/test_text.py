import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, langid, licences, quality

from .conftest import clashing

WORD = r"[^\x20\x09-\x0D]+"


def counts_by_hand(t):
    w = re.findall(WORD, t)
    seen, dup = set(), 0
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(lines)


def test_statistics(docs, rows):
    got = Counter(tuple(r) for r in quality.statistics(clashing(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines").collect())
    assert got == Counter((i, *counts_by_hand(t or "")) for i, t, *_ in rows)


def test_rules(spark):
    """Bad documents are loud or full of symbols; the learned list finds new ones and leaves clean ones alone."""
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9)))

    def make(i):
        words = [word() for _ in range(r.randrange(60, 140))]
        kind = i % 6
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [w + "$$%" for w in words]
        return (i, " ".join(words), 0 if kind < 2 else 1)

    rows = [make(i) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows if i < 600] + [(5000, 0, None), (1, None, None)], "doc_id long, quality int, toxic int")
    rules = quality.learn_rules(docs, labels)
    assert rules and all(len(x) <= 4 for x in rules)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, rules).collect()}
    truth = {i: q == 1 for i, _, q in rows if i >= 600}
    assert sum(got[i] == v for i, v in truth.items()) >= 0.98 * len(truth)
    assert quality.learn_rules(docs, labels.where("false")) == []
    assert quality.learn_rules(docs, labels.where("quality = 1")) == []
    assert quality.judge(docs.where("false"), rules).count() == 0


def test_whole_quality_query(spark, tmp_path, docs, rows):
    """The query's columns, and kept from the learned list applied by hand."""
    clean = lambda k: " ".join(f"word{k}x{j} and" for j in range(40))
    more = [(1000 + k, clean(k) if k % 3 else clean(k).upper().replace(" ", " $% "), "en", "s", 0) for k in range(240)]
    every = rows + more
    spark.createDataFrame(every, docs.schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1000 + k, int(k % 3 > 0), 0) for k in range(200)] + [(9999, 0, 0), (1000, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, labels = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    rules = quality.learn_rules(d.select("doc_id", "text"), labels)
    assert rules

    def kept(t):
        counts = {r["doc_id"]: r for r in quality.statistics(spark.createDataFrame([(0, t)], "doc_id long, text string")).collect()}[0]
        n, *_, repeats, _ = counts_by_hand(t)
        if n < 50 or 100 * repeats > 50 * n:
            return True, False
        for rule in rules:
            if all((counts[a] / counts[b] if counts[b] else 0.0) > c.threshold if c.above else (counts[a] / counts[b] if counts[b] else 0.0) <= c.threshold for c in rule for a, b in [quality.FEATURES[c.feature]]):
                return False, False
        return False, True

    judged = {t: kept(t) for t in {t or "" for _, t, *_ in every[::7] + every[-12:]}}
    got = quality.op1_quality_rules(spark, str(tmp_path))
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect() if r["doc_id"] not in (103, 303)}
    for r in got.collect():
        t = texts.get(r["doc_id"])
        if t is not None:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts_by_hand(t)[:5]
            if t in judged:
                assert (r["base_failed"], r["kept"]) == judged[t]
    assert got.count() == len(every) and {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"} <= set(got.columns)
    assert {v for _, v in judged.values()} == {True, False}


def test_rules_are_one_expression():
    rules = [[quality.Condition("upper_per_char", True, 0.5), quality.Condition("marks_per_word", False, 1.0)], [quality.Condition("symbols_per_word", True, 0.1)]]
    assert [str(c) for c in rules[0]] == ["upper_per_char > 0.5", "marks_per_word <= 1"]


def test_language(spark, docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    truth = Counter((i, lang) for i, t, lang, *_ in rows if i is not None and t and len(t.split()) > 30 and i not in (308, 309) and not (i < 100 and i % 9 == 4))
    held = [r for r in got if r["held_out"] and any((r["doc_id"], x) in truth for x in ("en", "fr", "de"))]
    assert held and sum((r["doc_id"], r["lang_pred"]) in truth for r in held) >= 0.95 * len(held)
    none = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert all(none[i] == ("und", 0.0) for i in (300, 301, 302, 306))
    assert all(0 <= r["score"] <= 1 for r in got)


def profile_by_hand(t):
    """The sum of bound trigram vectors, one trigram at a time."""
    signs = [ord(c) if c.isalpha() else 0 for c in f"\0{t.lower()}\0"] if t else []
    out = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(signs, signs[1:], signs[2:], strict=False):
        if a or b or c:
            out += langid.letter(a) * langid.letter(b)[langid._shift].astype(int) * langid.letter(c)[langid._shift][langid._shift]
    return out, any(signs)


def test_language_query_by_hand(spark, tmp_path, docs, rows):
    """Every prediction and score of the query from profiles made trigram by trigram, in whatever batches."""
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    made = {t: profile_by_hand(t) for t in {t or "" for _, t, *_ in rows}}
    sums = {}
    for i, t, lang, *_ in rows:
        if lang and t is not None and not held(i):
            sums[lang] = sums.get(lang, 0) + made[t][0]
    names = sorted(sums)

    def judge(t):
        v, some = made[t or ""]
        if not some:
            return "und", 0.0
        cos = [v @ sums[n] / np.linalg.norm(v) / np.linalg.norm(sums[n]) for n in names]
        return names[int(np.argmax(cos))], max(0.0, max(cos))

    got = langid.op9_language_id(spark, str(tmp_path)).collect()
    want = sorted(((i, held(i), *judge(t)) for i, t, *_ in rows), key=lambda r: (r[0] is None, r))
    got = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in got), key=lambda r: (r[0] is None, r))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4)


def test_language_of_long_texts_and_strangers(spark):
    """A text longer than a portion has the profile it has as a whole; texts in no learned language go, short ones stay."""
    r = random.Random(3)
    long = " ".join("".join(r.choice("aeioudnrst") for _ in range(r.randrange(1, 9))) for _ in range(3000)) + " İΣ."
    column = pa.array(["x", long, None, "", "ab"])
    parts = list(langid.portions(column, 1000))
    for a, b, v, some in parts:
        want, known = langid.profiles(column.slice(a, b - a).to_pylist())
        assert np.array_equal(v, want) and np.array_equal(some, known)
    assert [p[:2] for p in parts] == [(0, 1), (1, 2), (2, 5)]
    words = lambda alphabet, n: " ".join("".join(r.choice(alphabet) for _ in range(r.randrange(2, 8))) for _ in range(n))
    rows = [(1, long[:9000], "en"), (2, long[9000:], "en"), (3, words("абвгдежзиклмн", 80), None), (4, words("αβγδεζηθικλμ", 80), None), (5, "жук", None), (6, long[100:400], None), (7, "12 !", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.prototypes(docs, "text", "lang")
    assert {r["doc_id"] for r in langid.keep_identified(docs, learned).collect()} == {1, 2, 5, 6}


def test_language_never_reads_labels(docs):
    learned = langid.prototypes(docs, "text", "lang")
    a = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, learned, "doc_id", "text").collect()}
    b = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs.withColumn("lang", F.lit("zz")), learned, "doc_id", "text").collect()}
    assert a == b


def test_language_edges(docs, nothing):
    assert langid.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_identified(clashing(docs), langid.prototypes(docs, "text", "lang"))
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {300, 301, 302, 306} and 5 in ids and kept.columns == clashing(docs).columns


def test_profile_of_foreign_scripts():
    v, some = langid.profiles(["日本語のテキスト" * 50 + "".join(chr(c) for c in range(0x4E00, 0x5200)), "", "12"])
    assert some.tolist() == [True, False, False] and v[0].any() and not v[1].any()


@pytest.fixture
def leaks(spark):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    items = [(k, " ".join(word() for _ in range(n)).capitalize() + ".") for k, n in enumerate((15, 30, 40, 60, 25))] + [(9, None), (10, "too short")]
    filler = lambda n: [word() for _ in range(n)]
    docs, truth = [], set()
    for i in range(60):
        words = filler(r.randrange(10, 200))
        if i % 3 == 0:
            k = (i // 3) % 5
            copy = items[k][1].split()
            if i % 2:
                for j in range(3, len(copy), 8):
                    copy[j] = "edited"
                del copy[len(copy) // 2]
            words[4:4] = [w.upper() + "," for w in copy] if i % 4 == 0 else copy
            truth.add((i, k))
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (None, items[1][1]), (102, items[0][1] + " " + items[1][1]), (102, items[0][1])]
    truth |= {(102, 0), (102, 1)}
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [items[0]], "item_id long, text string"), truth


def test_decontamination(leaks):
    docs, items, truth = leaks
    got = decontaminate.contamination(clashing(docs).drop("item_id"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth
    assert len(got) == len(truth)
    exact = [r for r in got if r["doc_id"] % 2 == 0]
    assert all(r["score"] == 1.0 for r in exact) and all(0.5 <= r["score"] <= 1 for r in got)
    place = next(r for r in got if r["doc_id"] == 0)
    assert (place["begin_word"], place["end_word"]) == (4, 19)


def test_decontamination_blocks_and_edges(leaks, nothing, monkeypatch):
    docs, items, truth = leaks
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, items).collect()} == truth
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.contamination(docs, items.where("false")).count() == 0
    # a seed that is common everywhere still counts for an item that has no rarer ones
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, items, rare_df=0).collect()} == truth


@pytest.mark.parametrize("rare_df", [0, 100])
def test_decontamination_finds_dense_edits(spark, rare_df):
    import random

    import numpy as np

    r = random.Random(8)
    items = [[f"w{r.randrange(300)}" for _ in range(n)] for n in (3, 4, 7, 20, 33, 58)]
    edits = [lambda i, w: [w, "in"], lambda i, w: [w, "in"] if i % 2 else [w], lambda i, w: ["in"] if i % 3 == 2 else [w], lambda i, w: [] if i % 3 == 2 else [w], lambda i, w: [w, "in", "in"] if i % 3 == 0 else [w], lambda i, w: [w] if r.random() < 0.75 else [r.choice(["in", w + " in"])]]
    texts = []
    for k in range(240):
        item, edit = items[k % 6], edits[k // 6 % 6]
        copy = " ".join(x for i, w in enumerate(item) for x in edit(i, w)).split()
        if k % 5 == 0:
            half = len(item) // 2
            copy = item[:half] + ["in"] * (len(item) - 1) + item[half:]
        filler = [f"w{r.randrange(300)}" for _ in range(r.randrange(0, 400))]
        texts.append(filler[:50] + copy + filler[50:])
    code = {w: i + 1 for i, w in enumerate(sorted({w for t in [*items, *texts] for w in t}))}
    number = lambda ws: np.array([code[w] for w in ws], np.uint64)
    pairs = [(i, k) for i in range(len(texts)) for k in range(len(items))]
    score, _, _ = decontaminate.align([number(items[k]) for _, k in pairs], [number(texts[i]) for i, _ in pairs])
    truth = {(i, k, s / 2 / len(items[k])) for (i, k), s in zip(pairs, score.tolist(), strict=True) if s >= len(items[k])}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.contamination(docs, table, rare_df=rare_df).collect()} == truth
    assert decontaminate.contamination(spark.createDataFrame([(1, " ".join(items[5][:2]))], "doc_id long, text string"), table, rare_df=rare_df).count() == 0


def align_by_hand(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_smith_waterman():
    import numpy as np

    r = np.random.default_rng(3)
    pairs = [(r.integers(0, 5, r.integers(1, 30)).astype(np.uint64), r.integers(0, 5, r.integers(1, 40)).astype(np.uint64)) for _ in range(40)]
    score, begin, end = decontaminate.align([a for a, _ in pairs], [b for _, b in pairs], batch=7)
    assert score.tolist() == [align_by_hand(a.tolist(), b.tolist()) for a, b in pairs]
    assert all(align_by_hand(a.tolist(), b[x:y].tolist()) == s for (a, b), s, x, y in zip(pairs, score, begin, end, strict=True))


def test_licences(spark, nothing):
    mit = dict(licences.TEMPLATES)["MIT"]
    rows = [
        (1, "words here\nReleased under the MIT License.\nmore"), (2, mit), (3, "intro\n\n" + mit.replace(". ", ".\n") + "\n\nend of it"), (4, "all rights reserved"), (5, "of the and the software"),
        (6, None), (7, ""), (8, "License"), (9, "LICENSED under   CC BY-NC 4.0 !!\nLicensed under CC BY-NC 4.0."), (9, "Licensed under CC BY-NC 4.0."), (None, mit),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["licence"], round(r["dice"], 6), r["unit"], r["line"]) for r in licences.licence_scan(clashing(docs)).collect())
    db = duckdb.connect()
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  read by name
    db.register("documents", documents.astype({"doc_id": "Int64"}))
    assert got == sorted(db.execute(licences.oracle()).fetchall())
    assert {(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "proprietary"), (9, "CC-BY-NC-4.0")} == {g[:2] for g in got}
    assert licences.licence_scan(nothing).count() == 0
    assert licences.licence_scan(docs, templates=[]).count() == 0


def test_licence_notices_across_units(spark):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 200)
    bsd = next(t for n, t in licences.TEMPLATES if n == "BSD-3-Clause" and len(t) > 200)
    code = "\n".join(f"value{k} = compute{k}(thing{k}, other{k})" for k in range(400))
    parts = mit.replace("conditions: The", "conditions:\n#\n# The").replace("Software. THE", "Software.\n#\n# THE")
    rows = [
        (1, "# " + parts + "\n\n" + code), (2, code + "\n\n" + bsd.replace(" 1. ", "\n\n1. ").replace(" 3. ", "\n\n3. ") + "\n\n" + code),
        (3, "Copyright (c) 2020 Foo Inc. All rights reserved."), (4, "first\nThis tool was written by some people. Released under the MIT License. It is kept by others."),
        (5, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0. " + "Further words follow here and go on. " * 9), (6, "We hold all rights to it, and seats are reserved."),
        (7, bsd.replace("are met:", "are met: All rights reserved.") + " " + code),
    ]
    got = {(r["doc_id"], r["licence"], round(r["dice"], 2), r["unit"], r["line"]) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {g[:2] for g in got} == {(1, "MIT"), (2, "BSD-3-Clause"), (3, "proprietary"), (4, "MIT"), (5, "CC-BY-NC-4.0"), (7, "BSD-3-Clause"), (7, "proprietary")}
    assert {(1, "MIT", 1.0, "window", 0), (2, "BSD-3-Clause", 1.0, "window", 401), (3, "proprietary", 1.0, "window", 0), (4, "MIT", 1.0, "window", 1)} <= got
