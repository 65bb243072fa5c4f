import gzip
import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import attention, lm, merges, packing, warc

from .conftest import clashing

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    t.encode_special_tokens = True
    return t


def test_chunks_equal_whole_texts(tokenizer, known):
    import pyarrow as pa

    from quillgraph.llm import textcore as tc

    odd = ["don't stop, it's 3rd x", "Éa, ÇA! İstanbul é.́ á,b", "日本語 テスト。abc...def ,,, <|endoftext|> x's", "a.́ z;̈ .a,b", "x\x85y z w\x1cv"]
    texts = odd + [t for _, t in known]
    for cache in (1_000_000, 5):
        made = packing.Chunks(packing.default_vocabulary(), cache)
        for _ in range(2):
            ids, at = made.encode(*tc.flat(pa.array(texts)))
            assert all(ids[a:b].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t, a, b in zip(texts, at[:-1], at[1:], strict=True))


def test_merges_equal_the_tokenizer(tokenizer, known, monkeypatch):
    """Latin-1 letters, digits and signs are merged in numpy alone, and come out as the tokenizer's; the rest is left to it."""
    r = np.random.default_rng(5)
    made = packing.Chunks(packing.default_vocabulary(), 10)
    plain = [c for t, c in zip(r.random(3000) < 0.9, r.integers(1, 14, 3000), strict=True) for c in ["".join(r.choice(list("etaoinshrdluéèüßÀÉÑÞ") if t else list("ab.,!?;:#*$%&|<>()[]{}0123456789_-Éç"), c))]]
    plain += [w for _, t in known for w in re.findall(r"[!-&(-~]+", t) if len(w) < 30] + ["a" * 30, "." * 30, "é" * 15, "<|endoftext|>", "aaaaaaabaaaaaaab"]
    odd = ["don't", "a" * 31, "." * 31, "é" * 16, "×", "a÷b", "œuvre", "e\u0301", "日本", "x\x85y", "a\x1cb", "µ", "ªb", "İ"]
    raw = [w.encode() for w in plain + odd]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    good, ids, size = made.merges.known(data, off)
    assert good.tolist() == [True] * len(plain) + [False] * len(odd) and len(ids) == size.sum()
    ids, stop = made.fresh(raw)
    want = [e.ids for e in tokenizer.encode_batch_fast(plain + odd, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, stop[:-1])] == want
    monkeypatch.setattr(made, "_each", None)
    ids, stop = made.fresh(raw[: len(plain)])
    assert [x.tolist() for x in np.split(ids, stop[:-1])] == want[: len(plain)]


def test_other_vocabularies_are_left_to_their_tokenizer(tmp_path, tokenizer):
    saved = json.loads(Path(packing.default_vocabulary()).read_text(encoding="utf-8"))
    saved["normalizer"]["normalizers"].pop()
    path = tmp_path / "other.json"
    path.write_text(json.dumps(saved), encoding="utf-8")
    assert merges.merges(str(path)) is None and packing.Chunks(str(path), 10).fresh([b"some", b"words"])[0].tolist() == tokenizer.encode("some words", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, attention.ROWS, 2 * attention.ROWS + 3])
def test_products_by_rows(n):
    r = np.random.default_rng(n)
    x, y, w = r.standard_normal((n, 7)), r.standard_normal((n, 5)), r.standard_normal((7, 3))
    assert np.allclose(attention._rows(x, w), x @ w) and np.allclose(attention._sums(x, y), x.T @ y)


@pytest.mark.parametrize(("length", "limits"), [(64, {}), (64, {"rule": "dot"}), (64, {"most_documents": 2}), (64, {"most_cost": 64 * 64.0, "rule": "norm", "weights": (1.0, 1.0, 1.0)})])
def test_packing(docs, known, tokenizer, length, limits, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    got = packing.pack(clashing(docs), length=length, with_ids=True, **limits).collect()
    want = Counter()
    for i, t in known:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), length):
            part = np.array(ids[k : k + length], "<u4").tobytes()
            want[(i, k // length, k, len(part) // 4, zlib.crc32(part), part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length and len(places) <= limits.get("most_documents", length) and sum(s * s for _, s in places) <= limits.get("most_cost", length * length)
    if not limits:
        assert len(bins) <= -(-sum(r["length"] for r in got) // length) + 2


def test_packing_edges(nothing):
    assert packing.pack(nothing).count() == 0
    with pytest.raises(ValueError, match="fits no sequence"):
        packing.best_fit(np.array([5]), (4.0, 4.0, 16.0), (1.0, 1.0, 1.0), "norm")


def test_base_score(docs, known, rows):
    got = lm.lm_scores(clashing(docs)).collect()
    words = [(i, [*re.findall(WORD, t.translate(LOWER)), None]) for i, t in known]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_no_learning_rows(spark, nothing):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.lm_scores(spark.createDataFrame([(one, "a b")], "doc_id long, text string")).first()
    assert (r["held_out"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 0, 0, 0.0) and math.isfinite(r["score"])
    assert lm.lm_scores(nothing).count() == 0


def _pairs(streams):
    pairs = np.zeros((attention.CLASSES + 1, attention.CLASSES))
    for s in streams:
        np.add.at(pairs, (np.concatenate(([attention.START], s[:-1])), s), 1)
    return pairs


@pytest.fixture(scope="module")
def toy():
    """Streams in which a token is the one five places before it, most of the time: neighbours say little, context much."""
    r = np.random.default_rng(2)
    out = []
    for _ in range(120):
        s = r.integers(1, 12, r.integers(5, 90))
        for k in range(5, len(s)):
            if r.random() < 0.9:
                s[k] = s[k - 5]
        out.append(np.append(s, 0))
    return out


def test_gradient(toy):
    flat, off = np.concatenate(toy), np.concatenate(([0], np.cumsum([len(s) for s in toy])))
    x, y, scored, lead = attention.blocks(flat, off)
    model = attention.Model.start(*attention.prior(_pairs(toy)))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rows = np.flatnonzero(scored)[:12]
    w = np.concatenate([x[rows - 1], x[rows]], axis=1).astype(np.int64)
    see = np.where(lead[rows][:, None, None], attention.SEES_FIRST, attention.SEES)
    t = y[rows].astype(np.int64)
    _, g = model.gradient(w, t, see)
    for name, p in model.p.items():
        at = (int(w[2, 20]), 3) if name == "e" else tuple(n // 2 for n in p.shape) if name != "uc" else (2, int(t[t >= 0][0]))
        p[at] += 1e-5
        up = model.gradient(w, t, see)[0]
        p[at] -= 2e-5
        down = model.gradient(w, t, see)[0]
        p[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-7), name


def test_scores_follow_from_the_past_alone_and_each_token_counts_once(toy):
    model = attention.Model.start(*attention.prior(_pairs(toy)))
    full = model.log_probs(*attention.blocks(toy[0], np.array([0, len(toy[0])])))
    assert len(full) == len(toy[0])
    cut = model.log_probs(*attention.blocks(toy[0][:30], np.array([0, min(30, len(toy[0]))])))
    assert np.allclose(full[: len(cut)], cut, atol=1e-5)
    both = model.log_probs(*attention.blocks(np.concatenate(toy[:3]), np.cumsum([0, *map(len, toy[:3])])))
    assert np.allclose(both[: len(full)], full, atol=1e-5)


def test_probabilities_sum_to_one(toy):
    model = attention.Model.start(*attention.prior(_pairs(toy)))
    s = toy[0][:20].copy()
    total = 0.0
    for c in range(attention.CLASSES):
        s[-1] = c
        total += float(np.exp(model.log_probs(*attention.blocks(s, np.array([0, 20])))[-1]))
    assert total == pytest.approx(1, abs=1e-3)
    counts = np.random.default_rng(0).integers(0, 50, 3000)
    cls = attention.classes(counts, np.arange(3000) % 2 == 0)
    after = np.random.default_rng(1).integers(0, 3, (attention.GROUPS + 1, 3000))
    p = np.exp(attention.within(counts, cls, after))
    assert np.allclose([np.bincount(cls, row, attention.CLASSES)[np.unique(cls)] for row in p], 1, atol=1e-3)


def test_training_beats_the_counts(toy):
    flat, off = np.concatenate(toy), np.concatenate(([0], np.cumsum([len(s) for s in toy])))
    parts = attention.blocks(flat, off)
    by = attention.prior(_pairs(toy))
    before, group = np.concatenate([np.concatenate(([attention.START], s[:-1])) for s in toy]), flat // attention.PER
    base = (by[0][before, group] + by[1][before, group, flat % attention.PER]).mean()
    model = attention.train(*parts, *by, steps=300, batch=64)
    assert model.log_probs(*parts).mean() > base + 0.3


def test_warc(spark, tmp_path):
    big, trap = "<p>" + "x" * 120, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" + "y" * 100
    rows = [(5, "http://a/5", big), (2, "http://a/2\r\nX: y", big), (9, None, big), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (7, "ü", trap), (8, "u", trap), (None, "u", big), (2, "http://a/2", big), (10, "u", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "out")
    warc.write_archives(clashing(pages), path)
    got = warc.read_archives(spark, path).collect()
    known = [(i, (h or "").encode()) for i, _, h in rows if i is not None]
    first = {}
    for i, h in sorted(known):
        first.setdefault(h, i)
    want = Counter((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if len(h) >= 100 and first[h] < i else "response", first[h] if len(h) >= 100 and first[h] < i else None, h.decode()) for i, h in known)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in got) == want
    assert {r["url"] for r in got if r["page_id"] == 9} == {"urn:page:9"}
    names = [f for f in (tmp_path / "out").iterdir() if f.name.startswith("part-")]
    data = b"".join(f.read_bytes() for f in names)
    records = [r for f in names for r in warc.parse(f.read_bytes())]
    assert [len(list(warc.parse(m))) for f in names for m in warc._inflated(f.read_bytes()) if m] == [1] * len(known)
    assert all(list(warc.parse(gzip.decompress(f.read_bytes()))) == list(warc.parse(f.read_bytes())) for f in names)
    assert len(records) == len(known) and len(data) > 0 and len({h["warc-record-id"] for h, _ in records}) == len(set((i, h) for i, h in known))
    empty = str(tmp_path / "none")
    warc.write_archives(pages.where("false"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_files_by_bytes(spark, tmp_path, monkeypatch):
    """A file holds whole records; one of 16 MB and more, whose member may end in any byte, is closed by an empty member."""
    rows = [(i, "u", f"{i}" * (40 + i)) for i in range(60)] + [(99, "u", "ab" * (9 << 20))]
    members = list(warc._members([pa.record_batch([pa.array([h for *_, h in rows])], ["v"])]))
    assert len(members) == 1 and len(list(warc._inflated(members[0].column(0)[0].as_py() + b"\0"))) == 62
    monkeypatch.setattr(warc, "FILE_BYTES", 300)
    members = [m.column(0)[0].as_py() + b"\0" for m in warc._members([pa.record_batch([pa.array([h for *_, h in rows])], ["v"])])]
    assert len(members) > 5 and [x.decode() for m in members for x in warc._inflated(m) if x] == [h for *_, h in rows]
    path = str(tmp_path / "out")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    assert sorted((r["page_id"], r["payload"]) for r in warc.read_archives(spark, path).collect()) == [(i, h) for i, _, h in rows]


def test_warc_sql(spark, tmp_path):
    import duckdb

    rows = [(5, "x" * 100), (2, "x" * 100), (9, "y" * 99), (3, "y" * 99), (4, None), (6, ""), (7, "é" * 50), (8, "é" * 50), (2, "x" * 100), (None, "x" * 100)]
    spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op7_warc_revisits(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cur = con.execute(warc.oracle())
    names = [c[0] for c in cur.description]
    assert names == got.columns
    assert Counter(map(tuple, cur.fetchall())) == Counter(map(tuple, got.collect()))


def test_warc_notices_damage(tmp_path):
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab"))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(b"nonsense"))


def test_unused_columns_do_not_matter(docs):
    a = packing.tokenize(docs.select("doc_id", "text")).agg(F.sum("ids_crc32")).first()[0]
    assert packing.tokenize(clashing(docs)).agg(F.sum("ids_crc32")).first()[0] == a


def test_every_learning_document_moves_the_weights(spark, monkeypatch):
    """Also one that is too long to be drawn into the sample; a held-out one does not."""
    monkeypatch.setattr(lm, "SAMPLE_TEXT", 2_000)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(30)]
    learn = [i for i in range(30) if not held[i]]
    texts = {learn[0]: "one two three " * 900, learn[1]: "four five six seven", held.index(True): "held out words"}
    x = lm.corpus.usable(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id")
    plan = lm.corpus.measure(x, "text", lm.GROUP_BYTES)
    path = lm.packing.default_vocabulary()
    packed = lm.corpus.pack(x, "doc_id", "text", plan.groups)
    answers, *_ = lm.counts(packed, plan, "doc_id", path)
    answers = lm.state.cut(answers)
    size = len(lm.packing.chunks(path, lm.CACHE).ends_word) + 1
    tokens = lm.subword_counts(answers, size)
    def fitted(rows):
        groups = lm.counts(lm.corpus.pack(rows, "doc_id", "text", plan.groups), plan, "doc_id", path)[1]
        return lm.fit(x, groups, answers, plan, "doc_id", "text", path, tokens)[0].p

    whole = fitted(x)
    short = x.where(f"doc_id <> {learn[0]}")
    public = x.where(f"doc_id <> {held.index(True)}")
    assert any((whole[k] != w).any() for k, w in fitted(short).items())
    assert all((whole[k] == w).all() for k, w in fitted(public).items())


def test_scores_by_hand(spark, docs, known, tokenizer, monkeypatch):
    """Every document's score from the fitted weights in plain loops: a softmax over groups and one over the group's classes, token by token."""
    kept = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: kept.append(fit(*a)) or kept[-1])
    got = Counter((r["doc_id"], r["n_subwords"], round(r["score"], 2)) for r in lm.lm_scores(docs).collect())
    model, cls, within = kept[0]
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    end = len(cls) - 1

    def one(t):
        ids = [*tokenizer.encode(t.translate(LOWER), add_special_tokens=False).ids, end]
        c = [attention.START, *(int(cls[i]) for i in ids)]
        total = 0.0
        for k, i in enumerate(ids):  # predicts token k from what stands before it
            begin = max(0, (k // attention.STRIDE - 1) * attention.STRIDE)
            first = (k // attention.STRIDE) * attention.STRIDE
            x = {j: p["e"][c[j]] + p["pos"][attention.STRIDE + j - first] for j in range(begin, k + 1)}
            q = x[k] @ p["q"] / math.sqrt(attention.DIM)
            a = np.exp([q @ (x[j] @ p["k"]) for j in x])
            h = sum(w * (x[j] @ p["v"]) for w, j in zip(a / a.sum(), x, strict=True)) + x[k]
            h = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
            target = int(cls[i])
            g, m = divmod(target, attention.PER)
            zg = h @ p["ug"] + model.by_group[c[k]]
            zc = h @ p["uc"][:, g * attention.PER : (g + 1) * attention.PER] + model.by_class[c[k], g]
            total += zg[g] - np.log(np.exp(zg).sum()) + zc[m] - np.log(np.exp(zc).sum()) + within[c[k] // attention.PER, i]
        return len(ids), total / math.log(10)

    want = [(i, *one(t)) for i, t in known if i < 40 or i >= 300]
    for i, n, score in want:
        assert any(a == i and b == n and abs(s - score) <= 0.02 + 1e-4 * abs(score) for a, b, s in got), (i, n, score)


def test_attention_carries_the_result(spark):
    """On the driver's documents the attention layer lowers the loss of held-out texts against its own output set to zero."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = []
    fit = lm.fit

    def spy(*a):
        kept.append(fit(*a))
        return kept[-1]

    def held_out(f):
        lm.fit = f
        try:
            return lm.lm_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
        finally:
            lm.fit = fit

    with_attention = held_out(spy)[0]
    model, cls, within = kept[0]
    without = attention.Model({k: np.zeros_like(v) if k in ("ug", "uc") else v for k, v in model.p.items()}, model.by_group, model.by_class)
    assert with_attention > held_out(lambda *a: (without, cls, within))[0]


def test_unfillable_pieces_do_not_meet_in_one_task(spark, monkeypatch):
    """Pieces of over half a sequence fill no bin; they stay in bounded groups and cost no more sequences than they must."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    sizes = [2500] * 1000 + [1500]
    pieces = spark.createDataFrame([(i, 0, n, i) for i, n in enumerate(sizes)], "doc_id long, piece int, length long, ids_crc32 long").repartition(3)
    got = packing.place(pieces)
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1001)) and len({r["sequence_id"] for r in rows}) == 1000
    groups = Counter(r["sequence_id"] >> 32 for r in rows)
    assert max(groups.values()) <= 200 and len(groups) >= 10


def test_leftovers_meet_where_that_saves_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    r = np.random.default_rng(3)
    sizes = r.integers(1, 1200, 900).tolist()
    pieces = spark.createDataFrame([(i, 0, n, i) for i, n in enumerate(sizes)], "doc_id long, piece int, length long, ids_crc32 long").repartition(3)
    rows = packing.place(pieces).collect()
    fill = Counter()
    for x in rows:
        fill[x["sequence_id"]] += x["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(sizes) // 4096) + 2


def test_every_learning_document_has_one_turn():
    r = np.random.default_rng(4)
    parts, want = [], Counter()
    for g in range(5):
        n = r.integers(0, 9, 40 * g)
        learn = r.random(len(n)) < 0.8
        ids = r.integers(0, 60_000, n.sum()).astype(np.uint16)
        at = np.concatenate(([0], np.cumsum(n)))
        parts.append(lm.corpus.squeeze(ids, at, learn))
        want += Counter(ids[a:b].tobytes() for a, b, now in zip(at[:-1], at[1:], learn, strict=True) if now)
    got = Counter()
    for k in range(len(lm.TURNS) - 1):
        ids, at = lm.turns(parts, k)
        assert len(at) > 1 and at[-1] == len(ids)
        got += Counter(ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True))
    assert got == want


def test_a_pass_takes_every_block_once(toy, monkeypatch):
    """Also the blocks of the last strip, which is shorter than others, and with batches that do not come out even."""
    flat, off = np.concatenate(toy), np.concatenate(([0], np.cumsum([len(s) for s in toy])))
    parts = attention.blocks(flat, off)
    model = attention.Model.start(*attention.prior(_pairs(toy)))
    seen, inner = [], model.gradient
    monkeypatch.setattr(attention.Model, "gradient", lambda _, w, t, see: seen.append(t[t >= 0]) or inner(w, t, see))
    assert attention.go_over(attention.Model(model.p, model.by_group, model.by_class), attention.Adam(model.p), *parts, (0, 1), batch=48) == parts[2].sum()
    assert Counter(np.concatenate(seen).tolist()) == Counter(flat.tolist())


def test_strips_have_the_gradient_of_their_windows(toy):
    flat, off = np.concatenate(toy), np.concatenate(([0], np.cumsum([len(s) for s in toy])))
    x, y, _, lead = attention.blocks(flat, off)
    model = attention.Model.start(*attention.prior(_pairs(toy)))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    r = np.array([[3, 4, 5, 6, 7], [20, 21, 22, 23, 24]])
    own = r[:, 1:].reshape(-1)
    see = np.where(lead[own][:, None, None], attention.SEES_FIRST, attention.SEES)
    t = y[own].astype(np.int64)
    strips = model.gradient(x[r].reshape(2, -1).astype(np.int64), t, see)
    windows = model.gradient(np.concatenate([x[own - 1], x[own]], axis=1).astype(np.int64), t, see)
    assert strips[0] == pytest.approx(windows[0])
    assert all(np.allclose(strips[1][k], windows[1][k], atol=1e-6) for k in model.p)


@pytest.mark.parametrize("group_bytes", [8 << 20, 700_000, 300_000])
def test_all_weights_come_from_all_learning_documents(spark, monkeypatch, group_bytes):
    """In one task, by learners of several groups and by groups: a text of over 1 MB and a short one both move every weight, a held-out one none."""
    monkeypatch.setattr(lm, "GROUP_BYTES", group_bytes)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(60)]
    learn = [i for i in range(60) if not held[i]]
    out = held.index(True)
    texts = {i: f"some words of text {i} and {i * i} more" for i in learn} | {learn[0]: "one two three four five " * 46_000, out: "held out words"}
    x = lm.corpus.usable(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id").repartition(3)
    plan = lm.corpus.measure(x, "text", lm.GROUP_BYTES)
    path = lm.packing.default_vocabulary()
    answers, tokens, _ = lm.counts(lm.corpus.pack(x, "doc_id", "text", plan.groups), plan, "doc_id", path)
    answers = lm.state.cut(answers)
    seen = lm.subword_counts(answers, len(lm.packing.chunks(path, lm.CACHE).ends_word) + 1)

    def fitted(rows):
        groups = lm.counts(lm.corpus.pack(rows, "doc_id", "text", plan.groups), plan, "doc_id", path)[1]
        return lm.fit(rows, groups, answers, plan, "doc_id", "text", path, seen)[0].p

    whole = fitted(x)
    for i in (learn[0], learn[7]):
        assert all((whole[k] != w).any() for k, w in fitted(x.where(F.col("doc_id") != i)).items())
    assert all((whole[k] == w).all() for k, w in fitted(x.where(F.col("doc_id") != out)).items())
