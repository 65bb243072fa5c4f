import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm import neardup, substring, suffix
from quillgraph.llm import textcore as tc

from .conftest import clashing

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats_by_hand(known, window):
    seen, out = set(), []
    for i, t in known:
        w = re.findall(WORD, t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone[a : a + window] = [True] * window
            seen.add(k)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("window", [20, 5])
def test_substring(docs, known, window):
    got = substring.remove_repeats(docs, window=window).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == Counter(repeats_by_hand(known, window))


def test_substring_keeps_other_columns(docs, rows):
    out = substring.remove_repeats(clashing(docs))
    assert out.columns.count("n_words") == 1 and "lang" in out.columns
    assert {r["doc_id"]: r["g"] for r in out.collect()}[5] == "extra g"
    by_id = {r["doc_id"]: r["lang"] for r in out.collect()}
    assert all(by_id[i] == lang for i, _, lang, *_ in rows if i is not None and i != 303)


def shared_by_hand(known, length):
    first = {}
    data = [(i, t.encode()) for i, t in known]
    for i, t in data:
        for a in range(len(t) - length + 1):
            first.setdefault(t[a : a + length], i)
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if first[t[a : a + length]] < i:
                gone[a : a + length] = b"\1" * length
        spans = sum(1 for a in range(len(t)) if gone[a] and (a == 0 or not gone[a - 1]))
        out.append((i, len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("length", [50, 17])
def test_suffix(docs, known, length):
    got = suffix.remove_shared_bytes(docs, length=length).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == Counter(shared_by_hand(known, length))
    assert all(sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"] for r in got)


def test_multikey_sort():
    r = np.random.default_rng(1)
    rows = r.integers(97, 99, (300, 21)).astype(np.uint8)
    order, lcp = suffix.multikey(rows)
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(x.tobytes() for x in rows)
    want = [0] + [next((k for k in range(21) if a[k] != b[k]), 21) for a, b in zip(got, got[1:], strict=False)]
    assert lcp.tolist() == want


def components_by_hand(known):
    sets = {}
    for i, t in known:
        w = re.findall(WORD, t.translate(LOWER))
        sets.setdefault(i, []).append({tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    nodes = [(i, s) for i, group in sets.items() for s in group]
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            x, y = nodes[a][1], nodes[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    low = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(nodes):
        low[find(k)] = min(low[find(k)], i)
    return Counter((i, len(s), low[find(k)]) for k, (i, s) in enumerate(nodes))


def test_neardup(docs, known):
    got = neardup.near_duplicates(clashing(docs)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_by_hand(known)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chain_and_large_group(spark):
    """Links run along a chain; a group whose members are unlike its smallest id, but alike in two halves, falls in two."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(12):  # neighbours differ by a few words each, the ends by many
        words = list(base)
        for j in range(k):
            words[j * 8 : j * 8 + 1] = [f"c{j}"]
        rows.append((k, " ".join(words)))
    known = sorted(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: c for (i, _, c) in components_by_hand(known)}
    assert got == want


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_edited_group_and_shared_ids(spark, monkeypatch, broadcast):
    """A large group of texts edited up to and beyond the threshold, and near copies of both texts under one id; with sides broadcast and shuffled."""
    monkeypatch.setattr(neardup, "BROADCAST_BYTES", broadcast)
    r = random.Random(4)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for at in r.sample(range(120), r.randrange(9)):
            words[at] = f"e{r.randrange(60)}"
        rows.append((i, " ".join(words)))
    other = [f"v{k}" for k in range(80)]
    rows += [(2, " ".join(other)), (700, " ".join([*other, "more"])), (701, " ".join([*other, "and", "more"])), (700, "a third text"), (1, ""), (0, None), (5, "lone text"), (5, "lone text")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == components_by_hand([(i, t or "") for i, t in rows])


def test_own_shingles_and_prefixes(spark):
    """A link shares one of either's rarest shingles; what one class alone holds is its own, other texts under its id left aside."""
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "x y z u v w"), (3, "a b c d e q"), (4, "x y z u v t s r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    s = neardup.sketches(docs, "doc_id", "text")
    nodes = s.where("id <> 3").selectExpr("id", "id as doc", "mark", "n_shingles", "sketch")
    open_ = spark.createDataFrame([(9, 1, 6, 1, 6), (9, 2, 6, 2, 6), (8, 4, 4, 4, 2)], "key long, id long, n long, root long, small long")
    own = neardup.own_shingles(docs, open_, nodes, "doc_id", "text")
    assert {x["id"]: (x["n"], x["small"], x["own"]) for x in own.collect()} == {1: (6, 6, 1), 2: (6, 6, 1), 4: (4, 2, 4)}
    rare = neardup.prefixes(docs, own, nodes, "doc_id", "text", 50)
    # 6 and 6 shingles at 0.5 take 4 in common, so the prefix has 3, one of them own; the class 4 shares none
    assert Counter((x["id"], x["place"]) for x in rare.collect()) == Counter([(1, 1), (1, 2), (2, 1), (2, 2)])
    meet = neardup._open(rare, spark.createDataFrame([], "id long, root long"), "place")
    assert {(x["a"], x["b"]) for x in neardup._across(meet, nodes, 50, 3).collect()} == {(2, 1)}


def test_components(spark, monkeypatch):
    r = random.Random(8)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    low = {x: x for pair in links for x in pair}
    for _ in range(100):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    for most in (1_000_000, 50):
        monkeypatch.setattr(neardup, "CONTRACTED", most)
        got = neardup.components(df).collect()
        assert len(got) == len({x["id"] for x in got}) and {x["id"]: x["root"] for x in got} == {x: y for x, y in low.items() if x != y}
    assert neardup.components(df.where("false")).count() == 0


def test_sketch_estimates():
    r = np.random.default_rng(5)
    for n, share in ((40, 0.8), (400, 0.6), (5000, 0.75)):
        both = int(2 * n * share / (1 + share))
        a = np.unique(tc.mix(r.integers(1, 2**60, n).astype(np.uint64)))
        b = np.unique(np.concatenate([r.permutation(a)[:both], tc.mix(r.integers(1, 2**60, len(a) - both).astype(np.uint64))]))
        s = neardup.sketch([a, b])
        est, _ = neardup.estimate(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(est[0] - true) < 0.12
        assert neardup.possible(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]), true)[0]


def test_empty_tables(nothing):
    assert substring.remove_repeats(nothing).count() == 0
    assert suffix.remove_shared_bytes(nothing).count() == 0
    assert neardup.near_duplicates(nothing).count() == 0


def test_contract_columns(spark, tmp_path, docs, known):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in substring.op3_substring_dedup(spark, str(tmp_path)).where("doc_id <> 303 AND doc_id <> 103").collect()}
    for i, n, gone, text in repeats_by_hand(known, 20):
        if i not in (303, 103):
            assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(text.encode()).hexdigest())


def test_copies_under_shared_ids(spark):
    """A text that shares its id with a copy, but is none, keeps all of its words and bytes."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (7, None), (9, a), (9, a)], "doc_id long, text string").repartition(3)
    known = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = substring.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == Counter(repeats_by_hand(known, 20))
    assert Counter((r["doc_id"], r["n_removed"]) for r in got)[(5, 0)] == 1
    got = suffix.remove_shared_bytes(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == Counter(shared_by_hand(known, 50))
    assert Counter((r["doc_id"], r["n_removed"]) for r in got)[(5, 0)] == 1


def test_windows_of_equal_hash():
    """Windows whose first 64 bits agree are told apart by the second."""
    full, wide = np.array([7, 7, 7, 9], np.uint64), np.array([1, 1, 2, 2], np.uint64)
    assert substring._first(full, wide).tolist() == [True, False, True, True]


def test_buckets_follow_the_bytes(spark, docs, monkeypatch):
    """Ranges are bounded, buckets are not: common leading tokens and large corpora are split by the whole k-mer; the result stays."""
    x = suffix.corpus.usable(docs, "doc_id")
    plan = suffix.corpus.Plan(3, 64, 10**6, docs.count())
    cuts, begin = suffix.splitters(x, "doc_id", "text", 50, plan)
    assert len(begin) == len(cuts) + 2 and begin[-1] == 64 and (np.diff(begin) >= 1).all()
    monkeypatch.setattr(suffix, "RANGES", 8)
    cuts, begin = suffix.splitters(x, "doc_id", "text", 50, plan)
    assert len(cuts) <= 7 and begin[-1] == 64
    measure = suffix.corpus.measure
    monkeypatch.setattr(suffix.corpus, "measure", lambda *a: suffix.corpus.Plan(measure(*a).groups, 64, 10**6, 100))
    known = sorted((r["doc_id"], r["text"] or "") for r in x.collect())
    got = suffix.remove_shared_bytes(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == Counter(shared_by_hand(known, 50))
