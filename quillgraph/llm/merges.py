"""Byte-pair merges of many chunks at once, for vocabularies whose rules are those of ``RULES``.

A chunk is cut into runs of letters, single digits and runs of signs, as these rules say, and every
piece begins as its bytes, the last one marked as the word's end.  Then all pieces merge their
best pair, the leftmost of equals, until none has one left: the tokenizer's own order, a step of all
pieces at a time.  Only ASCII and the letters of Latin-1 in UTF-8 are read here, no apostrophes
(the rules cut some words at them) and no piece of over MOST bytes; `known` says which chunks that leaves.
"""

from __future__ import annotations

import json

import numpy as np

MOST, BATCH, BITS = 30, 8192, 19
NONE = np.int32(2**31 - 1)
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
OTHER, LETTER, DIGIT, SIGN = range(4)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[33:127] = SIGN
_KIND[39] = OTHER
_KIND[48:58] = DIGIT
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Second bytes of Latin-1 letters, all after 0xC3; 0x97 and 0xB7 are the signs for times and divided by.
_SECOND = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])
_UPPER = np.isin(np.arange(256), [b for b in range(0x80, 0x9F) if b != 0x97])


class Merges:
    def __init__(self, model: dict):
        ids = model["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = dict(zip(plain, map(chr, plain), strict=True))
        sign |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in sign)}
        self.first = np.array([ids[sign[b]] for b in range(256)], np.int32)
        self.last = np.array([ids[sign[b] + "</w>"] for b in range(256)], np.int32)
        self.empty = max(ids.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, self.made = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int32).reshape(-1, 3).T
        self.keys, self.ranks = np.full((1 << BITS) + 64, -1, np.int64), np.full((1 << BITS) + 64, NONE, np.int32)
        key, rank = _pair(left, right), np.arange(len(left), dtype=np.int32)
        at = _slot(key)
        while len(key):
            _, one = np.unique(at, return_index=True)
            one = one[self.keys[at[one]] < 0]
            self.keys[at[one]], self.ranks[at[one]] = key[one], rank[one]
            key, rank, at = (np.delete(x, one) for x in (key, rank, at + 1))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NONE where there is none."""
        key = _pair(left, right)
        at = _slot(key)
        found = np.take(self.keys, at)
        out = np.where(found == key, np.take(self.ranks, at), NONE)
        rest = np.flatnonzero((found != key) & (found >= 0))
        at, key = at[rest], key[rest]
        while len(rest):
            at += 1
            found = np.take(self.keys, at)
            hit = found == key
            out[rest[hit]] = self.ranks[at[hit]]
            go = ~hit & (found >= 0)
            rest, at, key = rest[go], at[go], key[go]
        return out

    def pieces(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces data[start : start + size], and how many each has."""
        order = np.argsort(size, kind="stable")
        many, parts = np.empty(len(order), np.int64), [np.zeros(0, np.int32)]
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            n = size[some]
            # a row for each piece, with an empty place on both sides
            width = int(n[-1]) + 2
            column = np.arange(width) - 1
            byte = np.take(data, start[some][:, None] + column, mode="clip")
            token = np.where((column >= 0) & (column < n[:, None]), self.first[byte], np.int32(self.empty))
            rows = np.arange(len(some))
            token[rows, n] = self.last[byte[rows, n]]
            rank = np.full(token.shape, NONE, np.int32)
            rank[:, :-1] = self.rank(token[:, :-1].reshape(-1), token[:, 1:].reshape(-1)).reshape(len(some), -1)
            flat, ranks = token.reshape(-1), rank.reshape(-1)
            after, before = np.arange(1, flat.size + 1), np.arange(-1, flat.size - 1)
            while len(rows):
                at = rows * width + np.take(rank, rows, axis=0).argmin(axis=1)
                best = np.take(ranks, at)
                go = np.flatnonzero(best < NONE)
                rows, at, best = rows[go], at[go], best[go]
                new, gone, left = np.take(self.made, best), np.take(after, at), np.take(before, at)
                right = np.take(after, gone)
                flat[at], flat[gone], ranks[gone] = new, self.empty, NONE
                after[at], before[right] = right, at
                ranks[at], ranks[left] = self.rank(new, np.take(flat, right)), self.rank(np.take(flat, left), new)
            kept = token != self.empty
            many[some] = kept.sum(axis=1)
            parts.append(token[kept])
        stop = np.cumsum(many[order])
        begin = np.empty(len(order), np.int64)
        begin[order] = stop - many[order]
        return np.concatenate(parts)[np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)], many

    def known(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which chunks (none empty) can be read here, their ids one after the other, and how many each has."""
        second = np.zeros(len(data), bool)
        second[1:] = (data[:-1] == 0xC3) & _SECOND[data[1:]]
        kind = _KIND[data]
        kind[second] = LETTER
        kind[:-1][(data[:-1] == 0xC3) & ~second[1:]] = OTHER
        low = _LOWER[data]
        low[second & _UPPER[data]] += 32
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        edge[off] = True
        begin = np.flatnonzero(edge)
        size = np.diff(begin)
        first = np.searchsorted(begin, off)
        good = np.add.reduceat((kind[begin[:-1]] == OTHER) | (size > MOST), first[:-1]) == 0
        mine = np.repeat(good, np.diff(first))
        ids, many = self.pieces(low, begin[:-1][mine], size[mine])
        ends = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], np.cumsum(np.diff(first)[good])))]
        return good, ids, np.diff(ends)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) << 20) | right


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).view(np.int64)


def merges(path: str) -> Merges | None:
    """For the vocabulary in this file; None if it has other rules or more tokens than fit a pair's key."""
    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    model = saved["model"]
    if any(saved.get(k) != v for k, v in RULES.items()) or any(model.get(k) != v for k, v in MODEL.items()) or not len(model["vocab"]) < 1 << 20 or len(model["merges"]) > 1 << (BITS - 1):
        return None
    return Merges(model)
