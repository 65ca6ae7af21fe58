"""Runs of repeated words: stretches with a period, found from synchronising positions.

A run is a stretch of consecutive words whose smallest period is q, of at least ``max(LEAST, 3 q)`` words, that no neighbouring word
prolongs with that period.  All runs of a text are found, each once:

* Every run of at least 24 words holds a stretch of 16 words twice.  Texts without such a repeat, most of them, are done.
* Periods below ``SMALL`` are read off directly: these are the highly periodic regions of the smallest scale.
* For periods of 8 t to 16 t, t a power of two, positions are picked whose next t words have the least hash among the positions
  up to t away.  The choice follows from the words around alone, so inside a run the same positions are picked in every period, and
  at least one is.  Stretches of t words that lie in a run of a period up to t / 3, known from smaller scales, are no candidates;
  else those regions would be picked from end to end.
* Positions with equal contexts, each with the next one, propose their distance as a period.  A run has three periods, so a picked
  position and its like one period on have 1.5 periods in common behind, before or around them: contexts of 12 t and 16 t words
  of these three kinds are of at least one period, and so do not recur within one.
* A proposal is prolonged both ways by bisection over hashes; what is long enough is compared word by word.

The number of picked positions halves with every scale, so the work for a text of n words is about n log n, on arrays.

Defined cases: a null text, or one with fewer than 24 words, has no run; its words are all kept.  Repeated rows are looked at each for itself.
Other columns stay, but for those named like the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieledger.llm.batches import in_small_batches
from tieledger.llm.hashing import Rolling, mixed, runs
from tieledger.llm.words import bytes_in, words_of

LEAST, SMALL, REPEATED = 24, 8, 16
#: The signs between words.
BLANKS = bytes_in(0x20, *range(0x09, 0x0E))
_NONE = np.zeros((0, 3), np.int64)


def least_around(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of the values up to ``reach`` places away on either side."""
    n, width = len(values), 2 * reach + 1
    padded = np.full(n + 2 * reach, np.iinfo(values.dtype).max, values.dtype)
    padded[reach : reach + n] = values
    size = 1
    while 2 * size <= width:
        padded = np.minimum(padded[:-size], padded[size:])
        size *= 2
    return np.minimum(padded[:n], padded[width - size : width - size + n])


def _common(roll: Rolling, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words, up to ``most``, are equal from i and j on, or before them."""
    low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
    while (low < high).any():
        m = (low + high + 1) // 2
        same = roll.plain(i - m, i) == roll.plain(j - m, j) if back else roll.plain(i, i + m) == roll.plain(j, j + m)
        low, high = np.where(same, m, low), np.where(same, high, m - 1)
    return low


def _stretches(codes: np.ndarray, q: int) -> np.ndarray:
    """All stretches with period q that are long enough, compared word by word."""
    first, stop = runs(codes[q:] == codes[:-q])
    out = np.stack([first, stop - first + q, np.full(len(first), q)], 1).astype(np.int64)
    return out[out[:, 1] >= max(LEAST, 3 * q)]


def _has_period(codes: np.ndarray, start: int, length: int, q: int) -> bool:
    return bool((codes[start : start + length - q] == codes[start + q : start + length]).all())


def _prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] if n > 1 else out


def _is_run(codes: np.ndarray, start: int, length: int, q: int) -> bool:
    """Whether a stretch has period q, no smaller one, and cannot be prolonged."""
    end = start + length
    if start and codes[start - 1] == codes[start - 1 + q] or end < len(codes) and codes[end] == codes[end - q] or not _has_period(codes, start, length, q):
        return False
    # a smaller period of a stretch of three periods divides q
    return not any(_has_period(codes, start, length, q // f) for f in _prime_factors(q))


def _picked(roll: Rolling, n: int, t: int, known: np.ndarray) -> np.ndarray:
    """The synchronising positions of scale t."""
    at = np.arange(n - t + 1)
    own = roll.spans(at, at + t)
    taken = np.zeros(len(own) + 1, np.int64)
    for start, length, _ in known[(known[:, 2] * 3 <= t) & (known[:, 1] >= t)]:
        taken[start] += 1
        taken[start + length - t + 1] -= 1
    free = np.cumsum(taken[:-1]) == 0
    own[~free] = np.iinfo(np.uint64).max
    return np.flatnonzero(free & (own == least_around(own, t)))


def _proposed(roll: Rolling, n: int, t: int, at: np.ndarray) -> np.ndarray:
    """(position, period) of neighbours in place among picked positions of equal context."""
    out = []
    for size in (12 * t, 16 * t):
        for before in (0, size // 2, size):
            own = at[(at >= before) & (at - before + size <= n)]
            h = roll.spans(own - before, own - before + size)
            order = np.argsort(h, kind="stable")
            a, b = own[order[:-1]], own[order[1:]]
            near = (h[order[:-1]] == h[order[1:]]) & (b - a >= SMALL * t) & (b - a < 2 * SMALL * t)
            out.append(np.stack([a[near], b[near] - a[near]], 1))
    return np.unique(np.concatenate(out), axis=0)


def find_runs(codes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) by start, then period."""
    n = len(codes)
    if n < LEAST:
        return _NONE
    roll = Rolling(mixed(codes.astype(np.uint64)))
    at = np.arange(n - REPEATED + 1)
    seen = np.sort(roll.plain(at, at + REPEATED))
    if not (seen[1:] == seen[:-1]).any():
        return _NONE
    found = np.concatenate([_NONE, *[_stretches(codes, q) for q in range(1, SMALL)]])
    found = found[[_is_run(codes, *map(int, x)) for x in found]] if len(found) else found
    t = 1
    while 3 * SMALL * t <= n:
        pairs = _proposed(roll, n, t, _picked(roll, n, t, found))
        i, p = pairs[:, 0], pairs[:, 1]
        behind = _common(roll, i, i + p, n - i - p, back=False)
        before = _common(roll, i, i + p, i, back=True)
        rows = np.stack([i - before, before + behind + p, p], 1)
        rows = np.unique(rows[rows[:, 1] >= np.maximum(LEAST, 3 * p)], axis=0)
        right = np.array([_is_run(codes, *map(int, x)) for x in rows], bool)
        odd = {int(x[2]) for x in rows[~right] if not _has_period(codes, *map(int, x))}  # hashes that deceived
        for q in odd:
            more = _stretches(codes, q)
            rows, right = np.concatenate([rows, more]), np.concatenate([right, [_is_run(codes, *map(int, x)) for x in more]]).astype(bool)
        found = np.concatenate([found, rows[right]])
        t *= 2
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """False for words that a run holds behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


RESULT = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"


def runs_of(text: Column) -> Column:
    """struct (n_words, runs by start and period, collapsed text: the words that stay, joined by one blank)."""

    @F.pandas_udf(RESULT)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            all_words, _ = words_of(pa.array(texts, pa.large_string(), from_pandas=True), BLANKS)
            cuts = np.searchsorted(all_words.texts, np.arange(len(texts) + 1))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                codes = all_words.codes[a:b]
                found = find_runs(codes)
                kept = codes[kept_words(len(codes), found)] if len(found) else codes
                collapsed = " ".join(all_words.names.take(pa.array(kept)).to_pylist())
                out.append((len(codes), [dict(zip(("start", "length", "period"), map(int, r), strict=True)) for r in found], collapsed))
            yield pd.DataFrame(out, columns=["n_words", "runs", "collapsed"])

    return look.asNondeterministic()(text)


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``df`` with the runs of its text column and the text without their repetitions."""
    out = in_small_batches(df).withColumn("__found", runs_of(F.col(f"`{text}`")))
    return out.withColumn(runs, F.col("__found.runs")).withColumn(collapsed, F.col("__found.collapsed")).drop("__found")


def planted(doc_id: Column, text: Column) -> Column:
    """The text to look at: of every tenth document, by a hash of its id, the words from some place on repeat a stretch of it."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    rest = n - a
    p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int"))), 1, F.greatest(rest, F.lit(0)))
    return F.when((h % 10 == 0) & (n > 0), F.concat_ws(" ", F.concat(F.slice(words, F.lit(1), a), repeated))).otherwise(text)


def report(df: DataFrame) -> DataFrame:
    """Per document the number of runs, the one of greatest exponent, and digests of all runs and of the collapsed text."""
    rows = with_runs(df.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    # runs are in order, so that an equal exponent leaves the earlier one
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
        lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
