"""Rolling hashes of words and character n-grams, whole arrays at a time."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: equal inputs stay equal, near ones part."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _steps(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(steps, dtype=np.uint64)


#: Symbols hashed at a time; powers are kept for so many and no more.
PART = 1 << 16
_POWERS, _INVERSES = _steps(_BASE, PART + 1), _steps(_INVERSE, PART + 1)


class Rolling:
    """Hashes of any spans of one array of symbols; equal spans hash alike in any array."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols) + 1
        powers, self.inverses = (_POWERS, _INVERSES) if n <= len(_POWERS) else (_steps(_BASE, n), _steps(_INVERSE, n))
        self.sums = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            terms = symbols.astype(np.uint64)
            terms += np.uint64(1)
            terms *= powers[: n - 1]
            np.cumsum(terms, dtype=np.uint64, out=self.sums[1:])

    def plain(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomials of spans, of which those of a span's parts make up the whole's."""
        with np.errstate(over="ignore"):
            return (self.sums[ends] - self.sums[starts]) * self.inverses[starts]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(self.plain(starts, ends))


def word_hashes(symbols: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Hashes of the runs of symbols that ``inside`` (a table by symbol) admits, as ``Rolling.spans`` gives them.

    The array is read in parts, so that no more than a part is held besides the hashes; a word over several parts is
    put together from its polynomials.
    """
    out, open_, size = [], None, 0
    for at in range(0, len(symbols), PART):
        part = symbols[at : at + PART]
        starts, ends = runs(inside[part])
        begins = len(starts) > 0 and starts[0] == 0
        if open_ is not None and not begins:
            out.append(mixed(np.array([open_], np.uint64)))
            open_ = None
        if not len(starts):
            continue
        h = Rolling(part).plain(starts, ends)
        if open_ is not None:
            h[0] = (open_ + pow(_BASE, size, 2**64) * int(h[0])) % 2**64
            size += int(ends[0])
        if ends[-1] == len(part) and at + PART < len(symbols):
            size = size if open_ is not None and len(h) == 1 else int(ends[-1] - starts[-1])
            open_, h = int(h[-1]), h[:-1]
        else:
            open_ = None
        out.append(mixed(h))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


class Lookup:
    """Positions of hashes in a table of distinct ones; -1 where absent."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(8, int(len(hashes)).bit_length() + 3)
        self.order = np.argsort(hashes, kind="stable").astype(np.int64)
        self.sorted = hashes[self.order]
        # where the hashes with the same leading bits begin
        self.begins = np.searchsorted(self.sorted, np.arange(2**self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.begins = np.append(self.begins, len(hashes)).astype(np.int32)
        self.deepest = int(np.diff(self.begins).max(initial=0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.sorted):
            return out
        lead = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        first, stop = self.begins[lead], self.begins[lead + 1]
        for k in range(self.deepest):
            at = np.flatnonzero(first + k < stop)
            hit = self.sorted[first[at] + k] == hashes[at]
            out[at[hit]] = self.order[first[at[hit]] + k]
        return out
