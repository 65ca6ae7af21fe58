"""Exact joins of names by likeness: no pair over the threshold is missed, and few others are looked at.

A Jaro score of t needs c letters in common, each as often as both names have it, with ``c / la + c / lb >= 3 t - 1``; a ratio
of t needs ``c >= t (la + lb) / 2``.  So names of given lengths must share so many letters.  Letters are put in the order of their
frequency in the names at hand, the rarest first, every occurrence of a letter being one of its own.  If c of la letters are
in common, the two names share k letters among the first ``la - c + k`` of either: all sets of k of those are keys.  A key also
holds both bands of length, which fix c and k, and for Jaro-Winkler scores the first letters, none to four, whose bonus lowers what c has to be.
Names with a token in common may score by how much of a name the common tokens are, or with those put
first; they meet by token.

Keys with many names on both sides are dealt into blocks, each pair of blocks a key of its own.  Every pair of different names
is scored once, on arrays.

Below ``DENSE`` the answer itself is a good part of all pairs and keys no longer tell names apart; there, all different names are compared in
blocks, as the rule that asks for such scores has it.  Scores of blocks against blocks (``functions/likeness.py``) cost so little a pair that those below
``KEYED`` are got that way too; from there on keys are far fewer than pairs.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieledger.functions.likeness import scores_of_blocks
from tieledger.functions.names import exact_normal_name, fuzzy_score, name_ratio
from tieledger.sources.tables import cut

#: Names of a block; letters of a set; score under which all are compared.
BLOCK, MOST_LETTERS, DENSE = 1024, 5, 0.75
#: Score from which names meet by keys; names of a block that is scored whole, the least number of names worth a block of their own, blocks that a side is dealt into at least, tasks, persons of a name in a block, rows of a batch.
KEYED, NAMES, FEWEST, BLOCKS, TASKS, PERSONS, ROWS = 0.91, 4096, 256, 12, 4096, 256, 1 << 18
#: Texts of equal first letters that are few enough to be compared without further keys; parts that rows of one key are dealt into when they learn what the other side has.
FEW, SALTS = 32, 16
#: Keys for a band, for each number of first letters that a key holds as well.
MOST_SETS = (120, 60, 24, 12, 6)
#: Scores are rounded to three places.
_ROUNDED = 0.0005 + 1e-9
#: Occurrences of a letter that are told apart in the order of rareness.
_OCCURRENCES = 4


def _bands(longest: int) -> list[tuple[int, int]]:
    """Lengths from 1 on: each for itself up to 9, then bands that grow by a fifth."""
    out, low = [], 1
    while low <= longest:
        high = max(low, int(low * 1.2)) if low > 9 else low
        out.append((low, high))
        low = high + 1
    return out


class Rule(NamedTuple):
    """Two strings of equal heads must have ``need`` letters in common, for lengths of at least a and b; a string has up to about ``sets`` keys a band."""

    head: int  # first letters that are part of the key
    need: Callable  # of two numbers, or of two columns
    sets: int


def jaro_winkler_rules(score: float) -> list[Rule]:
    """One rule for each number of first letters in common: the more there are, the less the rest must have."""
    def rule(bonus: int, sets: int) -> Rule:
        jaro = (score - 0.1 * bonus) / (1 - 0.1 * bonus)
        return Rule(bonus, lambda a, b: (3 * jaro - 1) * a * b / (a + b), sets)

    return [rule(bonus, sets) for bonus, sets in enumerate(MOST_SETS)]


def ratio_rules(score: float) -> list[Rule]:
    return [Rule(0, lambda a, b: score * (a + b) / 2, MOST_SETS[0])]


class Signatures:
    """Keys of strings: two strings that satisfy a rule have one in common."""

    def __init__(self, rules: list[Rule], rank: dict[tuple[str, int], int]):
        self.rules, self.rank = rules, rank
        self.plans: dict[tuple[int, int, int, int, int], tuple[int, int] | None] = {}

    def plan(self, rule: int, low: int, high: int, other_low: int, other_high: int) -> tuple[int, int] | None:
        """(letters in common, letters of a set) of names of the two ranges of lengths; None if they can never meet."""
        key = (rule, low, high, other_low, other_high)
        if key not in self.plans:
            need = math.ceil(max(0.0, self.rules[rule].need(low, other_low)) - 1e-9)
            rest = max(high, other_high) - need
            sizes = range(1, min(need, MOST_LETTERS) + 1)
            size = max([k for k in sizes if math.comb(rest + k, k) <= self.rules[rule].sets], default=min(need, 1)) if rest >= 0 else 0
            self.plans[key] = None if need > min(high, other_high) else (need, size)
        return self.plans[key]

    def letters(self, text: str) -> list[int]:
        """Occurrences of letters as numbers, the rarest first."""
        seen: dict[str, int] = {}
        out = []
        for c in text:
            n = seen[c] = seen.get(c, 0) + 1
            out.append((self.rank.get((c, min(n, _OCCURRENCES)), -1), n, ord(c)))
        return [n * 0x110000 + c for _, n, c in sorted(out)]

    def keys(self, text: str, rule: int, own: tuple[int, int, int], others: Iterable[tuple[int, int, int]], side: str) -> list[int]:
        """``own`` and ``others``: (band, least length, greatest length) of the names in hand; ``side``: a or b, or both if names meet their own kind."""
        letters, out = self.letters(text), set()
        start = zlib.crc32(text[: self.rules[rule].head].encode())
        for other in others:
            found = self.plan(rule, *own[1:], *other[1:])
            if found is None or found[0] > len(letters):
                continue
            need, size = found
            bands = sorted((own[0], other[0])) if side == "both" else (own[0], other[0]) if side == "a" else (other[0], own[0])
            tag = (rule, *bands, start)
            out.update(hash((*tag, *some)) for some in itertools.combinations(letters[: len(letters) - need + size], size))
        return list(out)


def _signatures(rules: Callable[[], list[Rule]], rank: dict, side: str) -> Callable[..., Column]:
    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        made = Signatures(rules(), rank)
        for batch in batches:
            rows = zip(*batch, strict=True)
            yield pd.Series([made.keys(t, i, (band, low, high), zip(*map(np.ndarray.tolist, (bands, lows, highs)), strict=True), side) for t, i, band, low, high, bands, lows, highs in rows], dtype="object")

    return keys


def _letter_ranks(texts: DataFrame) -> tuple[dict[tuple[str, int], int], list[tuple[int, int]]]:
    """texts (t): order of letters by frequency and the bands in use; both are bounded by the alphabet and the longest name's bands."""
    low = texts.select(F.filter(F.split("t", ""), lambda c: c != "").alias("c"))
    sizes = low.agg(F.max(F.size("c"))).first()[0] or 0
    every = low.select(F.explode(F.array_distinct("c")).alias("c"), F.col("c").alias("all"))
    counts = every.select("c", F.least(F.size(F.filter("all", lambda d: d == F.col("c"))), F.lit(_OCCURRENCES)).alias("n")).groupBy("c", "n").count()
    # letters beyond the thousand most frequent stay unranked, which puts them first
    found = counts.orderBy(F.desc("count"), "c", "n").limit(1000 * _OCCURRENCES).collect()
    times: dict[tuple[str, int], int] = {}
    for r in found:
        for n in range(1, r["n"] + 1):
            times[r["c"], n] = times.get((r["c"], n), 0) + r["count"]
    ordered = sorted(times, key=lambda x: (times[x], x))
    return {x: i for i, x in enumerate(ordered)}, _bands(sizes)


def met(a: DataFrame, b: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """Rows of a and b with equal ``keys``; keys with more than ``BLOCK`` rows on a side are dealt into blocks.

    Each side must have a column ``__name``, by whose hash its rows are dealt.
    """
    counts = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n)).where(F.col(n) > BLOCK)
    hot = counts(a, "__na").join(counts(b, "__nb"), keys, "full").select(*keys, *[F.ceil(F.coalesce(n, F.lit(1)) / BLOCK).cast("int").alias(n) for n in ("__na", "__nb")])

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(hot, keys, "left").withColumns({own: F.coalesce(own, F.lit(1)), other: F.coalesce(other, F.lit(1))})
        block = F.pmod(F.xxhash64("__name"), F.col(own)).cast("int")
        df = df.withColumn(f"{own}_i", block).withColumn(f"{other}_i", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return df.drop(own, other)

    x, y = dealt(a, "__na", "__nb").withColumnRenamed("__name", "na"), dealt(b, "__nb", "__na").withColumnRenamed("__name", "nb")
    out = x.join(y, [*keys, "__na_i", "__nb_i"])
    return (out.where(keep) if keep is not None else out).select("na", "nb")


def _all_in_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every pair of names, block against block; one row carries the two blocks."""
    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = max(1, math.ceil(df.count() / BLOCK))
        return df.groupBy(F.pmod(F.xxhash64("__name"), F.lit(n)).alias("k")).agg(F.collect_list("__name").alias(name))

    both = blocks(a, "na").drop("k").join(blocks(b, "nb").drop("k"), F.lit(True))
    return both.withColumn("na", F.explode("na")).withColumn("nb", F.explode("nb"))


def _prepared(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("name").alias("__name")).where("name IS NOT NULL").distinct()
    # the form that is scored, to the letter
    rows = cut(rows.withColumn("p", exact_normal_name(F.col("__name"))))
    return rows.where(F.length("p") > 0).withColumn("t", F.array_sort(F.array_distinct(F.split("p", " "))))


def _letters_in_common(a: Column, b: Column) -> Column:
    """How many letters two plain names have in common, each as often as both have it."""
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    return reduce(lambda x, y: x + y, [F.least(count(a, c), count(b, c)) for c in "abcdefghijklmnopqrstuvwxyz0123456789 "])


def _by_token(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Names with a common token that may score enough: those tokens alone are enough of either, or, put first in both, leave enough letters in common."""
    own = lambda df, s: df.select("__name", F.col("t").alias(f"t{s}"), F.explode("t").alias("k"))
    joined = lambda t: F.array_join(t, " ")
    la, lb = F.length(joined(F.col("ta"))), F.length(joined(F.col("tb")))
    common = F.length(joined(F.array_intersect("ta", "tb")))
    jaro = (2 + common / F.least(la, lb)) / 3
    alone = jaro + 0.1 * F.least(F.lit(4), common) * (1 - jaro) >= least - _ROUNDED
    need = 3 * (least - _ROUNDED - 0.4) / 0.6 - 1
    letters = _letters_in_common(joined(F.col("ta")), joined(F.col("tb")))
    near = (1 + F.least(la, lb) / F.greatest(la, lb) >= need - 1e-9) & (letters / la + letters / lb >= need - 1e-9)
    return met(own(a, "a"), own(b, "b"), ["k"], alone | near)


def _ruled(texts: DataFrame, heads: list[str], rules: list[Rule], bands: list[tuple[int, int]]) -> DataFrame:
    """A row for each rule of a text (__name, heads, t), with its first letters, length and band."""
    size = F.length("t")
    each = F.array(*[F.when(size >= r.head, F.struct(F.lit(i).alias("i"), F.substring("t", 1, r.head).alias("head"))) for i, r in enumerate(rules)])
    band = F.size(F.filter(F.array(*[F.lit(low) for low, _ in bands]), lambda low: low <= size))
    rows = texts.where(size > 0).select("__name", *heads, "t", F.explode(F.array_compact(each)).alias("r"), size.alias("n"), band.alias("band"))
    return rows.select("__name", *heads, "t", "r.i", "r.head", "n", "band").withColumn("salt", F.pmod(F.xxhash64("__name"), F.lit(SALTS)).cast("int"))


def _held(ruled: DataFrame, by: list[str], name: str) -> DataFrame:
    """How many texts there are for each rule and its first letters, and the lengths that occur in each band; a row for each salt."""
    per = ruled.groupBy(*by, "band").agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"))
    held = per.groupBy(*by).agg(F.sum("rows").alias(f"{name}_rows"), F.sort_array(F.collect_list(F.struct("band", "low", "high", "rows"))).alias(name))
    return held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _by_letters(a: DataFrame, b: DataFrame, texts: Callable[[DataFrame], Column], rules: Callable[[], list[Rule]], heads: list[str] | None = None) -> DataFrame:
    """Names of which some of the ``texts`` satisfy a rule, among those of equal ``heads``.

    A text has keys only for first letters and lengths that the other side has.  Where either side has no more than ``FEW`` texts of the same first letters,
    those are the whole key.
    """
    heads, one = heads or [], a is b
    of = lambda df: cut(df.select("__name", *heads, F.explode(F.array_distinct(texts(df))).alias("t")))
    x = of(a)
    y = x if one else of(b)
    rank, bands = _letter_ranks(x.select("t").union(y.select("t")))
    by = [*heads, "i", "head"]
    ruled_x = _ruled(x, heads, rules(), bands)
    ruled_y = ruled_x if one else _ruled(y, heads, rules(), bands)
    held_x, held_y = cut(_held(ruled_x, by, "gx")), None if one else cut(_held(ruled_y, by, "gy"))
    both = held_x.withColumns({"gy": F.col("gx"), "gy_rows": F.col("gx_rows")}).where("gx_rows > 1") if one else held_x.join(held_y, [*by, "salt"])

    def keyed(ruled: DataFrame, own: str, other: str, side: str) -> DataFrame:
        rows = ruled.join(both, [*by, "salt"])
        mine = F.get(F.filter(own, lambda g: g["band"] == F.col("band")), F.lit(0))
        # a text that is alone in its band does not meet that band
        met_by = F.filter(other, lambda g: (g["band"] != F.col("band")) | (g["rows"] > 1)) if one else F.col(other)
        rows = rows.select("__name", *heads, "t", "i", "n", "head", "band", mine.alias("mine"), met_by.alias("g"), (F.least("gx_rows", "gy_rows") <= FEW).alias("few"))
        few = rows.where("few").select("__name", *heads, "i", "n", F.xxhash64(F.lit("few"), "i", "head").alias("k"))
        sets = _signatures(rules, rank, side)("t", "i", "band", "mine.low", "mine.high", "g.band", "g.low", "g.high")
        many = rows.where(~F.col("few") & (F.size("g") > 0)).select("__name", *heads, "i", "n", F.explode(sets).alias("k"))
        return cut(few.union(many).distinct())

    left = keyed(ruled_x, "gx", "gy", "both" if one else "a")
    right = left if one else keyed(ruled_y, "gy", "gx", "b")
    # a key knows bands of length; the lengths themselves may rule a pair out
    need = reduce(lambda found, r: found.when(F.col("i") == r[0], r[1].need(F.col("na_n"), F.col("nb_n"))), enumerate(rules()), F)
    return met(left.withColumnRenamed("n", "na_n"), right.withColumnRenamed("n", "nb_n"), [*heads, "i", "k"], need <= F.least("na_n", "nb_n") + 1e-9)


def similar_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """a (name), b (name) -> (na, nb), with every pair of different rows whose fuzzy score is ``least`` or more; others are few."""
    x = _prepared(a)
    y = x if a is b else _prepared(b)
    if least < DENSE:
        return _all_in_blocks(x.select("__name"), y.select("__name"))
    sorted_too = lambda df: F.array(F.col("p"), F.array_join("t", " "))
    score = least - _ROUNDED
    letters = _by_letters(x, y, sorted_too, lambda: jaro_winkler_rules(score))
    return _by_token(x, y, least).union(letters).distinct()


def _in_blocks(entries: DataFrame, side: str) -> DataFrame:
    """entries (name, p, more) -> k, m: blocks of about ``NAMES`` entries, the shorter names first."""
    n = entries.count()
    blocks = max(1, math.ceil(n / NAMES), min(BLOCKS, n // FEWEST))
    rest = [c for c in entries.columns if c not in ("name", "p")]
    rows = entries.groupBy(F.pmod(F.xxhash64(*[c for c in entries.columns if c != "p"]), F.lit(blocks)).alias(f"k{side}"))
    return cut(rows.agg(F.array_sort(F.collect_list(F.struct(F.length("p").alias("n"), "name", "p", *rest))).alias(f"m{side}")).repartition(min(blocks, 64)))


def _block_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every block of a with every one of b, once each if both are one frame; each pair a row (ka, kb, ma, mb), dealt over tasks."""
    x = _in_blocks(a, "a")
    y = x.withColumnsRenamed({"ka": "kb", "ma": "mb"}) if a is b else _in_blocks(b, "b")
    n, m = x.count(), y.count()
    rows = x.join(y, F.col("ka") <= F.col("kb") if a is b else F.lit(True)).select("ka", "kb", "ma", "mb")
    return rows.repartition(max(1, min(TASKS, n * m if a is not b else n * (n + 1) // 2)))


def _field(entries: pa.StructScalar, name: str) -> list:
    return entries.values.field(name).to_pylist()


def _scored(least: float, one: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ka, kb, ma, mb in zip(*batch.columns, strict=True):
                same = one and ka == kb
                names, plain = ([_field(m, c) for m in (ma, mb)] for c in ("name", "p"))
                left, right = map(pa.array, names)
                for i, j, score in scores_of_blocks(*plain, least, names if one else None, same):
                    x, y = left.take(pa.array(i)), right.take(pa.array(j))
                    yield pa.RecordBatch.from_arrays([x, y, pa.array(score)], names=["na", "nb", "score"])

    return scored


def similar_names(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(na, nb, score) of all pairs of names with a fuzzy score of ``least`` or more; pass one frame twice for pairs within it.

    Null names, and names without a letter or digit, pair with nothing; equal names with a letter score 1.  Repeated names count once.
    The score is not symmetric: within one frame the lesser name comes first.
    """
    one = a is b
    if least >= KEYED:
        pairs = similar_pairs(a, b, least)
        if one:
            pairs = pairs.select(F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb")).distinct()
        return pairs.withColumn("score", fuzzy_score(F.col("na"), F.col("nb"))).where(F.col("score") >= least)
    x = _entries(a)
    found = _block_pairs(x, x if one else _entries(b)).mapInArrow(_scored(least, one), "na string, nb string, score double")
    return found.select(F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb"), "score") if one else found


def _entries(df: DataFrame, *more: Column) -> DataFrame:
    """The different names of df that have a letter or digit, with their plain form."""
    rows = df.where("name IS NOT NULL").groupBy("name").agg(*more) if more else df.where("name IS NOT NULL").select("name").distinct()
    return cut(rows.withColumn("p", exact_normal_name(F.col("name"))).where("p <> ''"))


def _best_of_blocks(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, ma, mb in zip(*batch.columns, strict=True):
                names, ids = pa.array(_field(ma, "name")), _field(mb, "id")
                rank = np.empty(len(ids), np.int64)
                rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
                of_rank = pa.array(sorted(ids))
                for i, j, score in scores_of_blocks(_field(ma, "p"), _field(mb, "p"), least):
                    order = np.lexsort((rank[j], score, i))
                    last = order[np.append(np.diff(i[order]) != 0, True)] if len(order) else order
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i[last])), pa.array(score[last]), of_rank.take(pa.array(rank[j[last]]))], names=["name", "score", "id"])

    return best


def best_names(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """a (name), b (id, name) -> (name, score, id): for each name of a the id with the best score, from ``least`` on, of equal ones the greatest.

    Of equal names in b only the greatest id can be the best, and of a block only the best one of each name leaves it.
    """
    found = _block_pairs(_entries(a), _entries(b, F.max("id").alias("id"))).mapInArrow(_best_of_blocks(least), "name string, score double, id string")
    return found.groupBy("name").agg(F.max(F.struct("score", "id")).alias("x")).select("name", "x.score", "x.id")


def _grouped(persons: list[list[dict]]) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """Where the persons of each name start, how many they are, and all of them in a row."""
    size = np.array([len(x) for x in persons], np.int64)
    return np.cumsum(size) - size, size, [x for own in persons for x in own]


def _of_one_thread(a: list[dict], b: list[dict]) -> np.ndarray:
    """Pairs of persons, as number in a times size of b plus number in b, that have a thread in common."""
    members: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
    for side, own in zip((a, b), members, strict=True):
        for i, person in enumerate(side):
            for t in person["threads"] or ():
                own.setdefault(t, []).append(i)
    found = [(np.array(x)[:, None] * len(b) + np.array(members[1][t])).ravel() for t, x in members[0].items() if t in members[1]]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _persons_of_blocks(review: float, auto: float, shared: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of persons of two blocks of names, the lesser id first; a batch has about ``ROWS`` of them."""
    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ka, kb, ma, mb in zip(*batch.columns, strict=True):
                same = ka == kb
                names, plain, persons = ([_field(m, c) for m in (ma, mb)] for c in ("name", "p", "persons"))
                (at, size, left), (bt, sizes, right) = map(_grouped, persons)
                close = _of_one_thread(left, right)
                i, j = np.repeat(np.arange(len(size)), size)[close // len(right)], np.repeat(np.arange(len(sizes)), sizes)[close % len(right)]
                asked = np.unique(i * len(sizes) + j)
                ids, names_ = pa.array([p["id"] for p in left + right]), pa.array(names[0] + names[1])
                place = {x: k for k, x in enumerate(sorted({p["id"] for p in left + right}))}
                rank = np.array([place[p["id"]] for p in left + right], np.int64)
                for i, j, score in scores_of_blocks(*plain, review, names, same, (asked // len(sizes), asked % len(sizes), shared)):
                    times = size[i] * sizes[j]
                    done = np.cumsum(times)
                    for k in range(int(done[-1]) // ROWS + 1 if len(done) else 0):
                        part = slice(*np.searchsorted(done, (k * ROWS, (k + 1) * ROWS)))
                        own = np.repeat(np.arange(part.start, part.stop), times[part])
                        nth = np.arange(len(own)) - np.repeat(np.cumsum(times[part]) - times[part], times[part])
                        x, y, s = at[i[own]] + nth // sizes[j[own]], bt[j[own]] + nth % sizes[j[own]], score[own]
                        some = np.flatnonzero((s >= shared) & (s < auto))
                        merged = s >= auto
                        if len(close):
                            code = x[some] * len(right) + y[some]
                            merged[some] = close[np.minimum(np.searchsorted(close, code), len(close) - 1)] == code
                        kept = (merged | (s >= review)) & (rank[x] != rank[len(left) + y])
                        if same:  # of a name with itself each pair once
                            kept &= (i[own] < j[own]) | (x < y)
                        x, y, s, merged, own = x[kept], len(left) + y[kept], s[kept], merged[kept], own[kept]
                        na, nb, turn = i[own], len(size) + j[own], rank[x] > rank[y]
                        columns = [ids.take(pa.array(np.where(turn, y, x))), ids.take(pa.array(np.where(turn, x, y))), names_.take(pa.array(np.where(turn, nb, na))), names_.take(pa.array(np.where(turn, na, nb)))]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array(merged)], names=["id_a", "id_b", "name_a", "name_b", "score", "auto"])

    return paired


def similar_persons(persons: DataFrame, review: float, auto: float, shared: float) -> DataFrame:
    """persons (id, name, threads: array of strings) -> (id_a, id_b, name_a, name_b, score, auto) of pairs that score ``review`` or more.

    ``auto`` are those from ``auto`` on, and those with a thread in common from ``shared`` on; these are there whatever ``review`` is.  Persons of a name go with it into the
    blocks, so pairs are never joined; a name with many is in several blocks, ``PERSONS`` or so in each.
    """
    times = persons.groupBy("name").agg(F.ceil(F.count("*") / PERSONS).alias("__parts"))
    dealt = persons.join(times, "name").withColumn("part", F.pmod(F.xxhash64("id"), "__parts"))
    rows = dealt.groupBy("name", "part").agg(F.collect_list(F.struct("id", "threads")).alias("persons"))
    rows = cut(rows.withColumn("p", exact_normal_name(F.col("name"))).where("p <> ''"))
    schema = "id_a string, id_b string, name_a string, name_b string, score double, auto boolean"
    return _block_pairs(rows, rows).mapInArrow(_persons_of_blocks(review, auto, shared), schema)


def like_texts(a: DataFrame, b: DataFrame, above: float, heads: list[str] | None = None) -> DataFrame:
    """a, b (name, heads) -> (na, nb) of names of equal heads whose ratio is over ``above``."""
    rows = [df.select(F.col("name").alias("__name"), *(heads or [])).where("name <> ''").distinct() for df in (a, b)]
    x = cut(rows[0])
    y = x if a is b else cut(rows[1])
    pairs = _by_letters(x, y, lambda df: F.array("__name"), lambda: ratio_rules(above), heads)
    if a is b:
        pairs = pairs.where("na < nb")
    return pairs.distinct().where(name_ratio(F.col("na"), F.col("nb")) > above)
