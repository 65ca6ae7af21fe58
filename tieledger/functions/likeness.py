"""Fuzzy scores of all pairs of two blocks of names, the same as those of ``names.fuzzy``.

Letters of a text are masks of their places, so a Jaro score takes a few operations on whole columns of pairs for each letter.  Before
that, the number of letters two texts have in common (a product of two matrices) says which pairs may reach the score at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

from tieledger.functions.names import fuzzy_many, jaro_winkler_many

#: Letters of a text that a mask holds; occurrences of a letter that are counted; rows of a block, and pairs, that are worked on at once.
PLACES, OCCURRENCES, STRIPE, PAIRS = 64, 8, 256, 1 << 14
#: Scores are rounded to three places.
ROUNDED = 0.0005 + 1e-9
_CODE = np.zeros(256, np.uint8)
_CODE[list(b" abcdefghijklmnopqrstuvwxyz0123456789")] = np.arange(1, 38)
_LOW = np.array([(1 << n) - 1 for n in range(PLACES + 1)], np.uint64)
#: For a place and a window, the places that are near.
_NEAR = np.array([[_LOW[min(PLACES, i + w + 1)] & ~_LOW[max(0, i - w)] for w in range(PLACES // 2)] for i in range(PLACES)], np.uint64)


class Letters:
    """Texts of a-z, 0-9 and blanks, none of them empty, prepared to be compared many times."""

    def __init__(self, texts: list[str]):
        self.texts = [t.encode() for t in texts]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        n, width = len(texts), int(min(PLACES, self.size.max(initial=1)))
        codes = _CODE[np.frombuffer(b"".join(t[:width].ljust(width, b"\0") for t in self.texts), np.uint8)].reshape(n, width)
        masks = np.zeros((38, n), np.uint64)
        for i in range(width):
            masks[codes[:, i], np.arange(n)] |= np.uint64(1 << i)
        masks[0] = 0
        self.masks, self.at = masks.ravel(), codes.T.astype(np.int64) * n
        head = np.zeros((n, 4), np.uint8)
        head[:, : min(4, width)] = codes[:, :4]
        self.head = np.ascontiguousarray(head).view("<u4")[:, 0]
        counts = np.bitwise_count(masks[1:].reshape(37, n))
        #: texts whose letters are not all counted
        self.loose = (self.size > PLACES) | (counts.max(0, initial=0) > OCCURRENCES)
        self.counts = counts

    @cached_property
    def features(self) -> np.ndarray:
        """A row for each occurrence of a letter that some text has."""
        rows = np.concatenate([self.counts >= k for k in range(1, OCCURRENCES + 1)])
        return rows[rows.any(1)].astype(np.float32)

    def common_start(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many of the first four letters are equal."""
        x = self.head[u] ^ self.head[v]
        same = sum(((x & np.uint32(m)) == 0).astype(np.int64) for m in (0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF))
        return np.minimum(same, np.minimum(self.size[u], self.size[v]))

    def jaro_winkler(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """``names.jaro_winkler`` of texts u and v, given by number."""
        out = np.empty(len(u))
        for at in range(0, len(u), PAIRS):
            x, y = u[at : at + PAIRS], v[at : at + PAIRS]
            out[at : at + PAIRS] = self._jaro_winkler(x, y)
        long = np.flatnonzero((self.size[u] > PLACES) | (self.size[v] > PLACES))
        if len(long):
            out[long] = jaro_winkler_many([self.texts[i] for i in u[long]], [self.texts[i] for i in v[long]])
        return out

    def _jaro_winkler(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        la, lb = (np.minimum(self.size[x], PLACES) for x in (u, v))
        window = np.maximum(0, np.maximum(la, lb) // 2 - 1)
        every = _LOW[lb]
        free, got = every.copy(), np.zeros(len(u), np.uint64)
        places = range(int(la.max(initial=0)))
        for i in places:
            x = self.masks[self.at[i][u] + v]
            x &= _NEAR[i][window]
            x &= free
            x &= np.negative(x)  # the first place
            free ^= x
            got |= (x != 0).astype(np.uint64) << np.uint64(i)
        m = np.bitwise_count(got).astype(np.int64)
        taken, swapped = every ^ free, np.zeros(len(u), np.int64)
        for i in places:
            on = (got >> np.uint64(i)) & np.uint64(1)
            first = (taken & np.negative(taken)) * on
            swapped += (on != 0) & ((self.masks[self.at[i][u] + v] & first) == 0)
            taken ^= first
        some = np.maximum(m, 1)
        jaro = np.where(m > 0, (m / la + m / lb + (m - swapped / 2) / some) / 3, 0.0)
        return jaro + self.common_start(u, v) * 0.1 * (1 - jaro)


def rounded(scores: np.ndarray) -> np.ndarray:
    """To three places, as ``round`` does."""
    scores = scores + 1e-12
    thousand = scores * 1000
    out = np.rint(thousand) / 1000
    for i in np.flatnonzero(np.abs(thousand - np.floor(thousand) - 0.5) < 1e-6):
        out[i] = round(float(scores[i]), 3)
    return out


def _pairs_with_tokens(ta: list[list[str]], tb: list[list[str]], plain: list[str], turned: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score by tokens) of all pairs with a token in common, sorted by i."""
    def owners(tokens: list[list[str]]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i, own in enumerate(tokens):
            for t in own:
                out.setdefault(t, []).append(i)
        return out

    a, b = owners(ta), owners(tb)
    pool, alone, i, j, u, v = [], [], [], [], [], []
    for token in a.keys() & b.keys():
        numbers, start = [], len(pool)
        pool.append(token)
        alone.append(start)
        for tokens, own in ((ta, a[token]), (tb, b[token])):
            numbers.append(np.arange(len(pool), len(pool) + len(own)))
            pool.extend(" ".join([token, *[t for t in tokens[x] if t != token]]) for x in own)
            alone.extend([start] * len(own))
        n, m = map(len, numbers)
        i.append(np.repeat(a[token], m))
        j.append(np.tile(b[token], n))
        u.append(np.repeat(numbers[0], m))
        v.append(np.tile(numbers[1], n))
    if not pool:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, u, v = map(np.concatenate, (i, j, u, v))
    turn = turned[i, j] if turned is not None else np.zeros(len(i), bool)
    code, first, times = np.unique(i * len(tb) + j, return_index=True, return_counts=True)
    i, j, u, v, turn = i[first], j[first], u[first], v[first], turn[first]
    texts = Letters(pool)
    least = texts.jaro_winkler(np.array(alone), np.arange(len(pool)))
    score = np.maximum(np.maximum(least[u], least[v]), texts.jaro_winkler(np.where(turn, v, u), np.where(turn, u, v)))
    several = np.flatnonzero(times > 1)
    if len(several):
        x, y = [plain[k] for k in i[several]], [plain[len(ta) + k] for k in j[several]]
        pairs = [(q, p) if t else (p, q) for p, q, t in zip(x, y, turn[several], strict=True)]
        score[several] = fuzzy_many([p for p, _ in pairs], [q for _, q in pairs])
    return i, j, score


def scores_of_blocks(a: list[str], b: list[str], least: float, names: tuple[list[str], list[str]] | None = None, same: bool = False, also: tuple[np.ndarray, np.ndarray, float] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a, b: names as ``names.plain`` has them -> (i, j, score) of the pairs that score ``least`` or more, in parts.

    With ``names``, the names as given, the lesser of a pair comes first in the score.  ``same``: both blocks are one, and
    only pairs with i <= j count.  ``also``: (i, j, score) of pairs, sorted by i, that count from that score on.
    """
    if not a or not b:
        return
    n, m = len(a), len(b)
    tokens = [sorted(set(x.split(" "))) for x in (*a, *b)]
    in_order = [" ".join(t) for t in tokens]
    forms = (Letters([*a, *b]), Letters(in_order))
    changed = np.array([x != y for x, y in zip((*a, *b), in_order, strict=True)])
    turned = None
    if names is not None:
        place = {x: k for k, x in enumerate(sorted({*names[0], *names[1]}))}
        ranks = [np.array([place[x] for x in side]) for side in names]
        turned = ranks[0][:, None] > ranks[1]
    ti, tj, ts = _pairs_with_tokens(tokens[:n], tokens[n:], [*a, *b], turned)
    low = least - ROUNDED
    need = np.array([3 * (low - 0.1 * p) / (1 - 0.1 * p) - 1 for p in range(5)], np.float32)
    for at in range(0, n, STRIPE):
        end = min(n, at + STRIPE)
        best, shared, asked = np.zeros((end - at, m)), np.zeros((end - at, m), bool), np.zeros((end - at, m), bool)
        own = slice(*np.searchsorted(ti, (at, end)))
        best[ti[own] - at, tj[own]], shared[ti[own] - at, tj[own]] = ts[own], True
        if also:
            own = slice(*np.searchsorted(also[0], (at, end)))
            asked[also[0][own] - at, also[1][own]] = True
        later = np.arange(at, end)[:, None] <= np.arange(m) if same else None
        for form in forms:
            la, lb = (form.size[x].astype(np.float32) for x in (slice(at, end), slice(n, None)))
            both = form.features[:, at:end].T @ form.features[:, n:]
            for loose, of in ((form.loose[at:end], np.s_[:, None]), (form.loose[n:], np.s_[:])):
                if loose.any():
                    both = np.where(loose[of], np.minimum(la[:, None], lb), both)
            mean = la[:, None] * lb / (la[:, None] + lb)
            near = (both >= need[4] * mean - 0.01) | asked
            if later is not None:
                near &= later
            if form is forms[1]:
                near &= (changed[at:end, None] | changed[n:]) & ~shared
            i, j = np.nonzero(near)
            kept = (both[i, j] >= need[form.common_start(i + at, j + n)] * mean[i, j] - 0.01) | asked[i, j]
            i, j = i[kept], j[kept]
            u, v = i + at, j + n
            if turned is not None:
                turn = turned[u, j]
                u, v = np.where(turn, v, u), np.where(turn, u, v)
            best[i, j] = np.maximum(best[i, j], form.jaro_winkler(u, v))
        enough = best >= low
        if also:
            enough |= asked & (best >= also[2] - ROUNDED)
        if later is not None:
            enough &= later
        i, j = np.nonzero(enough)
        score = rounded(best[i, j])
        kept = score >= (np.where(asked[i, j], min(least, also[2]), least) if also else least)
        yield i[kept] + at, j[kept], score[kept]
