"""Hashes and fingerprints: FNV-1a in 32 bits as floating-point arithmetic gives it, FNV-1a in 64 bits, and SimHash.

Hashes run over UTF-16 code units, whole Arrow batches at a time, column by column of code units.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIME64, BASIS64 = np.uint64(0x100000001B3), np.uint64(0xCBF29CE484222325)


def _units(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code units, padded to the longest text, and lengths."""
    raw = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    size = np.array([len(r) for r in raw])
    out = np.zeros((len(raw), size.max(initial=0)), np.uint16)
    for k, r in enumerate(raw):
        out[k, : len(r)] = r
    return out, size


def fnv64_array(texts: pd.Series) -> np.ndarray:
    units, size = _units(texts)
    h = np.full(len(size), BASIS64)
    for k in range(units.shape[1]):
        live = size > k
        h[live] = (h[live] ^ units[live, k].astype(np.uint64)) * PRIME64
    return h


@F.pandas_udf(T.LongType())
def fnv64(texts: pd.Series) -> pd.Series:
    """64-bit FNV-1a over UTF-16 code units, as the signed number with the same bits; null for null."""
    out = fnv64_array(texts.fillna("")).view(np.int64)
    return pd.Series(out, dtype="Int64").mask(texts.isna())


@F.pandas_udf(T.StringType())
def fnv32_lossy(texts: pd.Series) -> pd.Series:
    """Eight hexadecimal digits of 32-bit FNV-1a whose product is rounded to a double before it is cut to 32 bits."""
    units, size = _units(texts.fillna(""))
    h = np.full(len(size), 0x811C9DC5, np.uint64)
    for k in range(units.shape[1]):
        live = size > k
        x = ((h[live] ^ units[live, k]) & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        product = x.astype(np.float64) * 16777619.0
        h[live] = np.mod(product, 4294967296.0).astype(np.uint64)
    return pd.Series([f"{v:08x}" for v in h]).mask(texts.isna())


def simhash_arrays(hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of tokens that stand one after the other, each row in order; the running sums are cut to whole numbers after
    every vote. All rows vote together, place by place: first all first tokens, then all second ones."""
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    order = np.argsort(-sizes, kind="stable")  # the rows that still vote are always the first ones
    live = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
    sums = np.zeros((len(sizes), 64), np.float64)
    places = np.arange(64, dtype=np.uint64)
    for k, n in enumerate(live):
        at = start[order[:n]] + k
        sign = ((hashes[at][:, None] >> places) & np.uint64(1)).astype(np.float64) * 2 - 1
        sums[:n] = np.trunc(sums[:n] + sign * weights[at][:, None])
    bits = ((sums > 0).astype(np.uint64) << places).sum(axis=1, dtype=np.uint64)
    out = np.empty(len(sizes), np.uint64)
    out[order] = bits
    return out


def simhash_of(hashes: np.ndarray, weights: np.ndarray) -> int:
    """The fingerprint of one row."""
    return int(simhash_arrays(np.asarray(hashes, np.uint64), np.asarray(weights, float), np.array([len(hashes)]))[0])


@F.pandas_udf(T.LongType())
def simhash(tokens: pd.Series, weights: pd.Series) -> pd.Series:
    """SimHash of ordered tokens and weights, as the signed number with the same bits; 0 for none, null for null. Each distinct token of a batch is hashed once."""
    missing = np.array([t is None or w is None for t, w in zip(tokens, weights, strict=True)], bool)
    sizes = np.array([0 if m else len(t) for t, m in zip(tokens, missing, strict=True)], np.int64)
    flat = [x for t, m in zip(tokens, missing, strict=True) if not m for x in t]
    if flat:
        code, names = pd.factorize(pd.Series(flat, dtype=object))
        hashes = fnv64_array(pd.Series(names, dtype=object))[code]
        votes = np.concatenate([np.asarray(w, float) for w, m in zip(weights, missing, strict=True) if not m])
    else:
        hashes, votes = np.empty(0, np.uint64), np.empty(0)
    out = simhash_arrays(hashes, votes, sizes).view(np.int64)
    return pd.Series(out, dtype="Int64").mask(pd.Series(missing))
