"""Name similarity as vectorised helpers, with the plain rules beside them."""

from __future__ import annotations

import difflib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(100_000)
def plain(name: str | None) -> str:
    """Decomposed, without marks, lower case, letters and digits only, single spaces."""
    text = unicodedata.normalize("NFKD", name or "").lower()
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", re.sub(r"[̀-ͯ]", "", text)).split())


def jaro_winkler(a: str, b: str) -> float:
    """With the prefix bonus at any score."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    got, places = [], []
    for i, c in enumerate(a):
        lo, hi = max(0, i - window), min(len(b), i + window + 1)
        j = next((j for j in range(lo, hi) if free[j] == c), -1)
        if j >= 0:
            free[j] = None
            got.append(c)
            places.append(j)
    if not got:
        return 0.0
    swapped = sum(x != b[j] for x, j in zip(got, sorted(places), strict=True))
    n = len(got)
    jaro = (n / len(a) + n / len(b) + (n - swapped / 2) / n) / 3
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def token_set(a: str, b: str) -> float:
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    common = sorted(ta & tb)
    s1, s2, s3 = " ".join(common), " ".join(common + sorted(ta - tb)), " ".join(common + sorted(tb - ta))
    return max(jaro_winkler(s1, s2), jaro_winkler(s1, s3), jaro_winkler(s2, s3))


def fuzzy(a: str | None, b: str | None) -> float:
    x, y = plain(a), plain(b)
    return round(max(jaro_winkler(x, y), token_set(x, y)) + 1e-12, 3) if x and y else 0.0


def jaro_winkler_many(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """``jaro_winkler`` of pairs of different strings of one-byte letters, none of them empty, a few thousand at a time."""
    out = np.zeros(len(a))
    order = np.argsort([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], kind="stable")
    for at in range(0, len(a), 4096):
        own = order[at : at + 4096]
        x, y = (_padded([z[i] for i in own], pad) for z, pad in ((a, 0), (b, 1)))
        la, lb = (np.array([len(z[i]) for i in own]) for z in (a, b))
        n, window, places = len(own), np.maximum(0, np.maximum(la, lb) // 2 - 1), np.arange(y.shape[1])
        free, got, rows = y.copy(), np.zeros(x.shape, bool), np.arange(n)
        for i in range(x.shape[1]):
            near = (free == x[:, i : i + 1]) & (np.abs(places - i) <= window[:, None])
            hit, at_ = near.any(1), near.argmax(1)
            free[rows[hit], at_[hit]] = 2
            got[hit, i] = True
        m = got.sum(1)
        sizes = np.arange(min(x.shape[1], y.shape[1]))
        # the letters of either side that were found, in order
        left = np.take_along_axis(x, np.argsort(~got, axis=1, kind="stable"), 1)[:, : len(sizes)]
        right = np.take_along_axis(y, np.argsort(free != 2, axis=1, kind="stable"), 1)[:, : len(sizes)]
        swapped = ((left != right) & (sizes < m[:, None])).sum(1)
        some = np.maximum(m, 1)
        jaro = np.where(m > 0, (m / la + m / lb + (m - swapped / 2) / some) / 3, 0.0)
        first = min(4, len(sizes))
        prefix = np.logical_and.accumulate(x[:, :first] == y[:, :first], axis=1).sum(1)
        out[own] = jaro + prefix * 0.1 * (1 - jaro)
    return out


def _padded(texts: list[bytes], pad: int) -> np.ndarray:
    most = max(map(len, texts))
    return np.frombuffer(b"".join(t.ljust(most, bytes([pad])) for t in texts), np.uint8).reshape(len(texts), most)


def fuzzy_many(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """``fuzzy`` of many pairs at once."""
    out, left, right, of = np.zeros(len(a)), [], [], []
    for i, (x, y) in enumerate(zip(map(plain, a), map(plain, b), strict=True)):
        if not x or not y:
            continue
        if x == y:
            out[i] = 1.0
            continue
        ta, tb = sorted(set(x.split())), sorted(set(y.split()))
        common = [t for t in ta if t in tb]
        s1, s2, s3 = " ".join(common), " ".join(common + [t for t in ta if t not in common]), " ".join(common + [t for t in tb if t not in common])
        if s2 == s3 or s1 in (s2, s3):
            out[i] = 1.0
            continue
        for p, q in {(x, y), (s2, s3)} | ({(s1, s2), (s1, s3)} if s1 else set()):
            left.append(p.encode())
            right.append(q.encode())
            of.append(i)
    if of:
        np.maximum.at(out, of, jaro_winkler_many(left, right))
    return np.array([round(x + 1e-12, 3) if x else 0.0 for x in out.tolist()])


def ratio(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(T.DoubleType())
def fuzzy_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(fuzzy_many(list(a), list(b)), dtype="float64")


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def exact_normal_name(a: pd.Series) -> pd.Series:
    return pd.Series([plain(x) for x in a], dtype="object")


def similar_text(a: Column, b: Column, least: float = 0.5) -> Column:
    """Jaccard of words longer than three characters."""

    def tokens(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9]+"), lambda w: F.length(w) > 3))

    both, either = F.size(F.array_intersect(tokens(a), tokens(b))), F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(either > 0, both / either >= least).otherwise(F.lit(False))
