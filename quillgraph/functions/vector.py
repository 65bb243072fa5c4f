"""Vectors as arrays: cosine, and the embedders that can be plugged in."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for empty vectors or different lengths; the denominator is 1e-12 at least.  Norms that are known already need not be computed for each pair."""
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    both = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(fine, dot(a, b) / F.greatest(both, F.lit(1e-12))).otherwise(0.0)


def hashing_vector(text: str, dim: int) -> np.ndarray:
    """Signed counts of words at hashed places, of length 1."""
    v = np.zeros(dim, np.float64)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if h & 0x80000000 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def hashing_embedder(dim: int = 256) -> Callable[[Column], Column]:
    """An embedder that needs no model, for tests and for running offline."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: hashing_vector(t, dim).astype(np.float32).tolist())

    return embed


def guarded(embed_one: Callable[[str], list[float]], attempts: int = 5, first_wait: float = 0.25, sleep: Callable[[float], None] | None = None) -> Callable[[Column], Column]:
    """An embedder from a function that may fail: retried with doubling waits, null when all attempts fail.

    The waits stand between attempts only, so five attempts wait 3.75 s at most.
    """
    import time

    pause = sleep or time.sleep

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            for k in range(attempts):
                try:
                    return [float(x) for x in embed_one(text)]
                except Exception:  # the caller's function; the row tells of it by its null
                    if k + 1 < attempts:
                        pause(first_wait * 2**k)
            return None

        for texts in batches:
            yield texts.map(one)

    return embed


class InjectedFault:
    """Test hook around an embedding function: fails `always`, `once`, or after n calls."""

    def __init__(self, inner: Callable[[str], list[float]], mode: str = "always", after: int = 0):
        self.inner, self.mode, self.after, self.calls = inner, mode, after, 0

    def __call__(self, text: str) -> list[float]:
        self.calls += 1
        if self.mode == "always" or self.mode == "once" and self.calls == 1 or self.mode == "after" and self.calls > self.after:
            raise RuntimeError("injected fault")
        return self.inner(text)
