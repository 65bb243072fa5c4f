"""A small causal self-attention model over classes of subword ids, trained and run in numpy.

A token's probability is P(class | context) * P(token | class, group before).  The second factor
comes from counts over the whole training corpus; the most frequent tokens are classes of their
own, the rest share classes by frequency and by whether they end a word.  Classes come in groups,
and P(class | context) = P(group | context) * P(class | group, context).  Both parts are one
softmax each over the log probabilities that counts of neighbouring classes give, plus what one
attention layer and one feed-forward layer over the context window add to them.

A text is cut into blocks of one stride, each scored with the block before it as context, so
windows overlap by half and every token is scored exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DIM, HIDDEN, STRIDE, TIERS = 16, 32, 16, 8
GROUPS, PER = 32, 16
CLASSES = GROUPS * PER
START, PAD = CLASSES, CLASSES + 1
#: Weight of the distribution that counts are smoothed with.
SMOOTH = 5.0
#: Consecutive blocks that training takes together, the rate it starts with, and the steps until that is reached.
STRIP, RATE, WARM = 16, 0.03, 25
#: Blocks scored at once: their scores fit a processor's cache.
BATCH = 128
#: Rows in one product with weights.
ROWS = 1024
_Q = np.arange(STRIDE)[:, None]
_K = np.arange(2 * STRIDE)[None, :]
#: Which keys a query sees: itself and what is before it; in a text's first block nothing of the padding.
SEES = (_K <= _Q + STRIDE).astype(np.float32)
SEES_FIRST = (SEES * (_K >= STRIDE)).astype(np.float32)
_SEES = np.stack([SEES.T, SEES_FIRST.T])


def classes(counts: np.ndarray, ends_word: np.ndarray) -> np.ndarray:
    """Class of every token.  The last token is the text's end, class 0."""
    n = len(counts)
    order = np.lexsort((np.arange(n), -counts))
    order = np.concatenate(([n - 1], order[order != n - 1]))
    cls = np.zeros(n, np.int64)
    single = CLASSES - 2 * TIERS
    cls[order[:single]] = np.arange(min(single, n))
    rest = order[single:]
    share = np.cumsum(counts[rest] + 1.0)
    tier = np.minimum((share / max(share[-1], 1) * TIERS).astype(np.int64), TIERS - 1) if len(rest) else rest
    cls[rest] = single + 2 * tier + ends_word[rest]
    return cls


def within(counts: np.ndarray, cls: np.ndarray, after: np.ndarray) -> np.ndarray:
    """log P(token | class, group before), a row for each group and one for the start; `after` counts tokens by group before."""
    plain = (counts + 1.0) / np.bincount(cls, counts + 1.0, CLASSES)[cls]
    total = np.stack([np.bincount(cls, row, CLASSES) for row in after])
    return np.log((after + SMOOTH * plain) / (total[:, cls] + SMOOTH)).astype(np.float32)


def prior(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From counts (class before or START, class): log P(group | before) and log P(class | group, before)."""
    single = pairs.sum(axis=0) + 1.0
    p = (pairs + SMOOTH * single / single.sum()) / (pairs.sum(axis=1, keepdims=True) + SMOOTH)
    p = np.vstack([p, single / single.sum()]).reshape(CLASSES + 2, GROUPS, PER)
    group = p.sum(axis=2)
    return np.log(group).astype(np.float32), np.log(p / group[:, :, None]).astype(np.float32)


def blocks(cls: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of STRIDE inputs and targets for all texts, which rows are scored (the others are padding), and which come first."""
    n = np.diff(off)
    rows = -(-n // STRIDE) + 1
    begin = (np.cumsum(rows) - rows) * STRIDE
    size = int(rows.sum()) * STRIDE
    at = np.arange(len(cls)) - np.repeat(off[:-1] - off[0] - begin - STRIDE, n)
    x, y = np.full(size, PAD, np.int16), np.full(size, -1, np.int16)
    y[at] = cls
    x[at[:-1] + 1 if len(at) else at] = cls[:-1]  # what spills over a text's end is overwritten or masked
    first = begin[n > 0] + STRIDE
    x[first] = START
    pad = np.zeros(size // STRIDE, bool)
    pad[begin // STRIDE] = True
    x.reshape(-1, STRIDE)[pad] = PAD
    lead = np.zeros(len(pad), bool)
    lead[first // STRIDE] = True
    return x.reshape(-1, STRIDE), y.reshape(-1, STRIDE), ~pad, lead


@dataclass
class Model:
    p: dict[str, np.ndarray]
    by_group: np.ndarray
    by_class: np.ndarray

    @classmethod
    def start(cls, by_group: np.ndarray, by_class: np.ndarray, seed: int = 6) -> Model:
        r = np.random.Generator(np.random.PCG64(seed))
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return cls({"e": g(CLASSES + 2, DIM) * 4, "pos": g(2 * STRIDE, DIM) * 0.5, "q": g(DIM, DIM), "k": g(DIM, DIM), "v": g(DIM, DIM), "w1": g(DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": g(HIDDEN, DIM), "ug": g(DIM, GROUPS) * 0.1, "uc": g(DIM, CLASSES) * 0.1}, by_group, by_class)

    def tables(self) -> tuple[np.ndarray, ...]:
        """Query, key and value of every class and of every place; a last column of ones makes the value product sum the weights as well."""
        p = self.p
        s = np.float32(1 / np.sqrt(DIM))
        e, pos = p["e"], p["pos"]
        tv = np.concatenate([e @ p["v"], np.ones((len(e), 1), np.float32)], axis=1)
        pv = np.concatenate([pos @ p["v"], np.zeros((len(pos), 1), np.float32)], axis=1)
        return e, pos[STRIDE:], e @ p["q"] * s, pos[STRIDE:] @ p["q"] * s, e @ p["k"], pos @ p["k"], tv, pv

    def attended(self, c: np.ndarray, see: np.ndarray, tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """What the attention layer makes of strips (consecutive blocks, the first only context), and what its gradient needs.

        Keys stand by queries, in `see` too: numpy's small products are fast if the second factor is not
        transposed.  A block's keys and values are looked up once for both windows it is in.
        """
        e, pe, tq, pq, tk, pk, tv, pv = tables
        own = c[:, 1:].reshape(-1, STRIDE)

        def windows(table, place):
            rows = np.take(table, c, axis=0)
            shape = (len(c), c.shape[1] - 1, 2 * STRIDE, table.shape[1])
            return (np.lib.stride_tricks.as_strided(rows, shape, rows.strides, writeable=False) + place).reshape(-1, *shape[2:])

        q, k, v = np.take(tq, own, axis=0), windows(tk, pk), windows(tv, pv)
        q += pq
        a = np.matmul(k, np.ascontiguousarray(q.transpose(0, 2, 1)))
        np.clip(a, -60, 60, out=a)  # so that no exponential overflows and no sum of them is zero
        np.exp(a, out=a)
        a *= see
        o = np.matmul(a.transpose(0, 2, 1), v)
        whole = o[:, :, DIM:]
        o = o[:, :, :DIM] / whole
        h = np.take(e, own, axis=0)
        h += pe
        h += o
        return h.reshape(-1, DIM), own.reshape(-1), q, k, v, a, o, whole

    def log_probs(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """log P(class | context) of every target, in order; padded places are left out."""
        p, tables = self.p, self.tables()
        hidden, out, before, target = [], [], [], []
        for i in range(1, len(x), BATCH):
            c = x[None, i - 1 : i + BATCH].astype(np.int64)
            h, b, *_ = self.attended(c, np.take(_SEES, lead[i : i + BATCH].astype(np.int64), axis=0), tables)
            t = y[i : i + BATCH].reshape(-1)
            live = np.flatnonzero(t >= 0)
            h = np.take(h, live, axis=0)
            f = _rows(h, p["w1"])
            f += p["b1"]
            np.maximum(f, np.zeros_like(f), out=f)  # numpy is slow with a single zero
            h += _rows(f, p["w2"])
            hidden.append(h)
            before.append(b[live])
            target.append(t[live])
            if len(hidden) == 4 or i + BATCH >= len(x):
                out.append(self._classes(np.concatenate(hidden), np.concatenate(before), np.concatenate(target).astype(np.int64)))
                hidden, before, target = [], [], []
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def _classes(self, h: np.ndarray, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P of the target classes given what the layers made of their contexts."""
        group = target // PER
        order = np.argsort(group.astype(np.uint8), kind="stable")
        h, before, target, group = np.take(h, order, axis=0), before[order], target[order], group[order]
        z = _rows(h, self.p["ug"])
        z += np.take(self.by_group, before, axis=0)
        out = np.empty(len(h), np.float32)
        out[order] = _log_softmax_at(z, group)
        cut = np.searchsorted(group, np.arange(GROUPS + 1))
        z = np.take(self.by_class.reshape(-1, PER), before * GROUPS + group, axis=0)
        for g in range(GROUPS):
            z[cut[g] : cut[g + 1]] += h[cut[g] : cut[g + 1]] @ self.p["uc"][:, g * PER : (g + 1) * PER]
        out[order] += _log_softmax_at(z, target - group * PER)
        return out

    def upper(self, h: np.ndarray, before: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean loss of what the attention layer made where there is a target, its gradient in the layers above, and that in h."""
        p, size = self.p, len(h)
        order = np.flatnonzero(target >= 0)
        order = order[np.argsort((target[order] // PER).astype(np.uint8), kind="stable")]
        h, before, target = np.take(h, order, axis=0), before[order], target[order]
        n = max(len(h), 1)
        group, hit = target // PER, target % PER
        at, ones = np.arange(len(h)), np.ones(len(h), h.dtype)
        f = _rows(h, p["w1"])
        f += p["b1"]
        np.maximum(f, np.zeros_like(f), out=f)  # numpy is slow with a single zero
        h2 = _rows(f, p["w2"])
        h2 += h
        zg = _rows(h2, p["ug"])
        zg += np.take(self.by_group, before, axis=0)
        zg = _softmax(zg)
        # classes within their groups: each group's rows meet its own columns alone
        cut = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        spans = [(slice(lo, hi), slice(c * PER, (c + 1) * PER)) for c, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if hi > lo]
        zc = np.take(self.by_class.reshape(-1, PER), before * GROUPS + group, axis=0).astype(h2.dtype, copy=False)
        for span, columns in spans:
            zc[span] += h2[span] @ p["uc"][:, columns]
        zc = _softmax(zc)
        loss = 0.0
        for z, k in ((zg, group), (zc, hit)):
            k = at * z.shape[1] + k
            one = np.take(z, k)
            loss -= float(np.log(np.maximum(one, 1e-30)).sum()) / n
            z.reshape(-1)[k] = one - 1
            z *= np.float32(1 / n)
        dh2 = _rows(zg, p["ug"].T.copy())
        g = {"ug": _sums(h2, zg), "uc": np.zeros_like(p["uc"])}
        for span, columns in spans:
            g["uc"][:, columns] = h2[span].T @ zc[span]
            dh2[span] += zc[span] @ p["uc"][:, columns].T
        df = _rows(dh2, p["w2"].T.copy())
        df *= f > 0
        g |= {"w2": _sums(f, dh2), "w1": _sums(h, df), "b1": ones @ df}
        dh2 += _rows(df, p["w1"].T.copy())
        back = np.full(size, len(order))
        back[order] = at
        return loss, g, np.take(np.concatenate([dh2, np.zeros((1, DIM), dh2.dtype)]), back, axis=0)

    def gradient(self, w: np.ndarray, t: np.ndarray, see: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch of strips, and its gradient.

        A strip is any number of consecutive blocks after the one that is only context, so a window is the
        shortest; `see` has a row for each block that is a target.
        """
        p, s = self.p, np.float32(1 / np.sqrt(DIM))
        tables = self.tables()
        e, c = tables[0], w.reshape(len(w), -1, STRIDE)

        h, before, q, k, v, a, o, whole = self.attended(c, see.transpose(0, 2, 1), tables)
        n = len(a)
        loss, g, do = self.upper(h, before, t.reshape(-1))
        do = do.reshape(n, STRIDE, DIM)
        per = do / whole
        back = np.empty((n, DIM + 1, STRIDE), h.dtype)
        back[:, :DIM] = per.transpose(0, 2, 1)
        # against the values' last column, of ones, stands what the softmax takes from every key
        back[:, DIM] = -np.einsum("ijk,ijk->ij", per, o)
        ds = np.matmul(v, back)
        ds *= a
        dq, made = np.matmul(ds.transpose(0, 2, 1), k), np.empty((n, 2 * STRIDE, 2 * DIM), h.dtype)
        np.matmul(ds, q, out=made[:, :, :DIM])
        np.matmul(a, per, out=made[:, :, DIM:])
        places = np.ones(n, h.dtype) @ made.reshape(n, -1)
        # windows back to blocks: each is the second half of its own and the first of the next
        made = made.reshape(len(c), -1, 2, 2 * STRIDE * DIM)
        both = np.empty((*c.shape[:2], 2 * STRIDE * DIM), h.dtype)
        both[:, 0], both[:, -1] = made[:, 0, 0], made[:, -1, 1]
        np.add(made[:, :-1, 1], made[:, 1:, 0], out=both[:, 1:-1])
        both, dq = both.reshape(-1, 2 * DIM), dq.reshape(-1, DIM)
        dkv = _sums(np.take(e, c.reshape(-1), axis=0), both)
        g |= {"q": _sums(np.take(e, before, axis=0), dq) * s, "k": dkv[:, :DIM], "v": dkv[:, DIM:]}
        de = _rows(both, np.concatenate([p["k"].T, p["v"].T])).reshape(*c.shape, DIM)
        own = _rows(dq, p["q"].T * s)
        own += do.reshape(-1, DIM)
        de[:, 1:] += own.reshape(len(c), -1, STRIDE, DIM)
        flat = c.reshape(-1)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        flat = flat[order]
        cut = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        g["e"] = np.zeros_like(e)
        g["e"][flat[cut]] = np.add.reduceat(np.take(de.reshape(-1, DIM), order, axis=0), cut, axis=0)
        pos, late = p["pos"], p["pos"][STRIDE:]
        dpk, dpv = np.split(places.reshape(-1, 2 * DIM), 2, axis=1)
        dpq, dpe = ((np.ones(n, h.dtype) @ m.reshape(n, -1)).reshape(-1, DIM) for m in (dq, do))
        g["q"] += late.T @ dpq * s
        g["k"] += pos.T @ dpk
        g["v"] += pos.T @ dpv
        g["pos"] = dpk @ p["k"].T + dpv @ p["v"].T
        g["pos"][STRIDE:] += dpq @ p["q"].T * s + dpe
        return loss, g


def _rows(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, so many rows at a time that BLAS takes them as they lie and needs no copies."""
    out = np.empty((len(x), w.shape[1]), x.dtype)
    for i in range(0, len(x), ROWS):
        np.matmul(x[i : i + ROWS], w, out=out[i : i + ROWS])
    return out


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y in the same manner."""
    out = x[:ROWS].T @ y[:ROWS]
    for i in range(ROWS, len(x), ROWS):
        out += x[i : i + ROWS].T @ y[i : i + ROWS]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    np.clip(z, -80, 80, out=z)  # within what a float's exponential can hold
    np.exp(z, out=z)
    z /= z @ np.ones((z.shape[1], 1), np.float32)
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    np.clip(z, -80, 80, out=z)  # within what a float's exponential can hold
    hit = z.reshape(-1)[np.arange(len(z)) * z.shape[1] + at]
    np.exp(z, out=z)
    return hit - np.log(z @ np.ones(z.shape[1], np.float32))


def train(x: np.ndarray, y: np.ndarray, scored: np.ndarray, lead: np.ndarray, by_group: np.ndarray, by_class: np.ndarray, steps: int = 800, batch: int = 256, rate: float = RATE, seed: int = 6) -> Model:
    """A model from all blocks, in whole passes of at least so many steps in all."""
    model = Model.start(by_group, by_class, seed)
    n = int(scored.sum())
    if not n:
        return model
    passes = -(-steps // max(1, -(-n // batch)))
    adam = Adam(model.p)
    for k in range(passes):
        go_over(model, adam, x, y, scored, lead, (k / passes, (k + 1) / passes), batch, rate, seed + k)
    return model


def go_over(model: Model, adam: Adam, x: np.ndarray, y: np.ndarray, scored: np.ndarray, lead: np.ndarray, span: tuple[float, float], batch: int = 256, rate: float = RATE, seed: int = 6) -> int:
    """Adam over every block once, strips of them in random order; `span` says which part of all learning this is.  The number of blocks."""
    many = max(1, batch // STRIP)
    first = np.random.Generator(np.random.PCG64(seed)).permutation(np.arange(1, len(x), STRIP))
    for i in range(0, len(first), many):
        r = first[i : i + many, None] + np.arange(-1, STRIP)
        over = r >= len(x)
        r[over] = 0  # the padding before the first text
        own = r[:, 1:].reshape(-1)
        see = np.take(_SEES, lead[own].astype(np.int64), axis=0).transpose(0, 2, 1)
        part = span[0] + (span[1] - span[0]) * i / len(first)
        adam.step(model.gradient(x[r].reshape(len(r), -1).astype(np.int64), y[own].astype(np.int64), see)[1], rate * (1 - 0.95 * part))
    return int(scored.sum())


class Adam:
    """Steps of these weights, as views of one vector that `weights` holds from here on; the first steps are short."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.flat, self.n = np.concatenate([w.reshape(-1) for w in weights.values()]), 0
        at = np.cumsum([0, *(w.size for w in weights.values())])
        weights |= {k: self.flat[a:b].reshape(w.shape) for (k, w), a, b in zip(weights.items(), at[:-1], at[1:], strict=True)}
        self.names = list(weights)
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def step(self, gradient: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        rate *= min(1.0, self.n / WARM)
        d = np.concatenate([gradient[k].reshape(-1) for k in self.names]).astype(np.float32, copy=False)
        self.m += 0.1 * (d - self.m)
        self.v += 0.01 * (d * d - self.v)
        self.flat -= (rate / (1 - 0.9**self.n)) * self.m / (np.sqrt(self.v / (1 - 0.99**self.n)) + 1e-8)
