"""Collocations of two and three words, from stripes.

A stripe belongs to a language and a first word.  It is an associative counter over what comes next: the second and the third
word, or the end of the piece in place of either.  Every occurrence of a word is one entry of its stripe, so that one structure holds

* the total of the prefix, which is the word's own count;
* the counts of its extensions by one word (summed over what follows) and by two;
* of each extension, the greatest count among its own extensions, by which it may be subsumed.

A task builds the stripes of about ``WORDS`` words at a time and thereby combines what repeats before anything travels.  Stripes are
dealt out by language, first word and slice, and those that meet are merged elementwise, sorted, so that one merged slice is
held at a time.  Stripes of common words are dealt into slices by a hash of the entry, as many as a table of ``COUNTERS`` counts of
hashed words asks for; it comes from a pass of its own, is of a fixed size, and decides on nothing but the dealing.

Defined cases: a null text is empty; a null language is ``und``; repeated rows count each; an empty table gives no row; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieledger.llm.batches import in_small_batches
from tieledger.llm.hashing import Rolling, mixed
from tieledger.llm.words import bytes_in, column_bytes, words_of
from tieledger.sources.tables import cut

#: The signs between pieces, and those between words of a piece.
PIECE_ENDS = bytes_in(*b".,;:!?", *range(0x0A, 0x0E))
BETWEEN = PIECE_ENDS | bytes_in(0x20, 0x09)
LEAST_COUNT, LEAST_PERCENT, TOP = 10, 50, 2000
#: Words whose stripes a task builds at a time; counters of the table of hashed words; entries of a slice, about.
WORDS, COUNTERS, SLICE = 1 << 20, 1 << 16, 1 << 18
#: Parts of a language that are ranked before the whole.
PARTS = 32

STRIPES = "lang string, first string, slice int, nexts string, counts binary"
GRAMS = "lang string, w1 string, w2 string, w3 string, n long, longest long"


def _language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit("und"))


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts) of one language each, of a few MB."""
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            texts = pc.ascii_lower(batch.column("text").filter(pc.equal(langs, lang)))
            held.setdefault(lang, []).append(texts)
            size[lang] = size.get(lang, 0) + texts.nbytes
            if size[lang] >= 5 * WORDS:
                yield lang, pa.concat_arrays(held.pop(lang))
                del size[lang]
        while sum(size.values()) >= 8 * WORDS:  # many languages: the fullest goes
            lang = max(size, key=size.get)
            yield lang, pa.concat_arrays(held.pop(lang))
            del size[lang]
    for lang in sorted(held):
        yield lang, pa.concat_arrays(held[lang])


def _name_hashes(lang: str, names: pa.Array) -> np.ndarray:
    """Of the words of a language."""
    data, ends = column_bytes(names)
    start = np.uint64(int.from_bytes(lang.encode()[:8].ljust(8), "little"))
    return mixed(Rolling(data).plain(ends[:-1], ends[1:]) + start)


def _pieces(texts: pa.Array):
    """The words of texts, and a number of the piece for each."""
    words, spread = words_of(texts, BETWEEN)
    ends = np.cumsum(PIECE_ENDS[spread], dtype=np.int64)
    return words, ends[words.starts] + words.texts if len(words.starts) else np.zeros(0, np.int64)


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(COUNTERS, np.int64)
    for lang, texts in _loads(batches):
        words, _ = words_of(texts, BETWEEN)
        own = np.bincount(words.codes, minlength=len(words.names))
        np.add.at(table, (_name_hashes(lang, words.names) % np.uint64(COUNTERS)).astype(np.int64), own)
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table[at])], ["at", "n"])


def word_counters(docs: DataFrame) -> np.ndarray:
    """``COUNTERS`` counts of hashed words of all docs (lang, text): a table of a fixed size."""
    rows = docs.mapInArrow(_counters, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(COUNTERS, np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out


def _counted(key: np.ndarray, second: np.ndarray, third: np.ndarray, n: np.ndarray | None, size: int) -> tuple[np.ndarray, ...]:
    """Different (key, second, third) in order, each code under ``size``, with the sums of ``n``, or how often each comes."""
    if size < 1 << 21:
        packed = (key * size + second) * size + third
    else:  # words by the million: the last two as one code
        _, pair = np.unique(second * size + third, return_inverse=True)
        packed = key * (pair.max(initial=0) + 1) + pair
    order = np.argsort(packed, kind="stable")
    packed = packed[order]
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(packed))) if n is None else np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)
    at = order[first]
    return key[at], second[at], third[at], sums


def _entry_slices(second: np.ndarray, third: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """0 for entries of whole stripes, else from 1; ``second``, ``third``: hashes of the words of an entry."""
    with np.errstate(over="ignore"):
        own = (mixed(second * np.uint64(3) + third) % slices.astype(np.uint64)).astype(np.int64)
    return np.where(slices > 1, own + 1, 0)


def _stripe_batches(lang: str, names: pa.Array, key: np.ndarray, slice_: np.ndarray, second: np.ndarray, third: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of STRIPES from entries in order of (key, slice); the last code stands for the end."""
    words = pa.concat_arrays([names.cast(pa.string()), pa.array([""])])
    edge = np.concatenate([[True], (key[1:] != key[:-1]) | (slice_[1:] != slice_[:-1])])
    first = np.flatnonzero(edge)
    begins = np.append(first, len(key))
    step = 4096
    for a in range(0, len(first), step):
        own = begins[a : a + step + 1]
        lo, hi = own[0], own[-1]
        pairs = np.stack([second[lo:hi], third[lo:hi]], 1).ravel()
        lists = pa.ListArray.from_arrays(pa.array(2 * (own - lo), pa.int32()), words.take(pa.array(pairs)))
        counts = pa.Array.from_buffers(pa.large_binary(), len(own) - 1, [None, pa.py_buffer(8 * (own - lo).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(n[lo:hi], "<i8"))])
        columns = [pa.array([lang] * (len(own) - 1)), words.take(pa.array(key[own[:-1]])), pa.array(slice_[own[:-1]], pa.int32()), pc.binary_join(lists, " "), counts.cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "first", "slice", "nexts", "counts"])


def _slice_size(counters: np.ndarray) -> int:
    """With far more words than counters a slice may be larger: rare words would be dealt out for nothing."""
    return max(SLICE, 4 * int(counters.mean()))


def _stripes(counters: np.ndarray, entries: int, at_once: int):
    """Builds stripes of ``at_once`` words in tasks; ``counters``: of ``word_counters``; ``entries``: of a slice, about."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _loads(batches):
            words, piece = _pieces(texts)
            end = len(words.names)
            codes = np.append(words.codes, [end, end])
            piece = np.append(piece, [-1, -2])
            hashes = np.append(_name_hashes(lang, words.names), np.uint64(0))
            slices = 1 + counters[(hashes[:-1] % np.uint64(COUNTERS)).astype(np.int64)] // entries
            for a in range(0, len(words.codes), at_once):  # one text may be longer
                b = min(a + at_once, len(words.codes))
                second = np.where(piece[a:b] == piece[a + 1 : b + 1], codes[a + 1 : b + 1], end)
                third = np.where(piece[a:b] == piece[a + 2 : b + 2], codes[a + 2 : b + 2], end)
                key, second, third, n = _counted(codes[a:b], second, third, None, end + 1)
                slice_ = _entry_slices(hashes[second], hashes[third], slices[key])
                order = np.lexsort((slice_, key)) if slice_.any() else slice(None)
                yield from _stripe_batches(lang, words.names, key[order], slice_[order], second[order], third[order], n[order])

    return build


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Entries of stripes: the row of each, its count, and the two words of each one after the other."""
    column = batch.column("counts").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    n = np.frombuffer(column.buffers()[2], "<i8")[at[0] // 8 : at[-1] // 8]
    words = pc.list_flatten(pc.split_pattern(batch.column("nexts").cast(pa.large_string()), " "))
    return np.repeat(np.arange(len(column)), np.diff(at) // 8), n, words


def _merge(least: int):
    """Merges stripes that come sorted by language, first word and slice, elementwise -> rows of GRAMS.

    A slice's total of its first word; its sums of two words, with the greatest count among extensions that are candidates
    themselves; and the three words that are candidates.  Sums of two words that are whole and too few to matter go.
    """

    def rows(lang, first, sliced, second, third, n, names) -> pa.RecordBatch:
        """Entries of merged stripes, sorted by stripe and words; ``lang``, ``first`` are codes of ``names`` by entry."""
        stripe = np.concatenate([[True], (lang[1:] != lang[:-1]) | (first[1:] != first[:-1]) | (sliced[1:] != sliced[:-1])])
        pair = stripe | np.concatenate([[True], second[1:] != second[:-1]])
        s, p = np.flatnonzero(stripe), np.flatnonzero(pair)
        totals, pairs = np.add.reduceat(n, s), np.add.reduceat(n, p)
        empty = names.index("").as_py()
        candidate = (n >= least) & (third != empty) & (second != empty)
        longest = np.maximum.reduceat(np.where(candidate, n, 0), p)
        keep = (second[p] != empty) & ((pairs >= least) | (sliced[p] != 0))
        p, pairs, longest = p[keep], pairs[keep], longest[keep]
        t = np.flatnonzero(candidate)
        at = np.concatenate([s, p, t])
        none = lambda x, y: pa.array(np.concatenate([np.full(x, -1), y]), mask=np.concatenate([np.ones(x, bool), np.zeros(len(y), bool)]))
        w2, w3 = names.take(none(len(s), np.concatenate([second[p], second[t]]))), names.take(none(len(s) + len(p), third[t]))
        columns = [names.take(pa.array(lang[at])), names.take(pa.array(first[at])), w2, w3]
        counts = [np.concatenate([totals, pairs, n[t]]), np.concatenate([np.zeros(len(s), np.int64), longest, np.zeros(len(t), np.int64)])]
        return pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in columns] + [pa.array(c.astype(np.int64)) for c in counts], ["lang", "w1", "w2", "w3", "n", "longest"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last stripe so far, merged now and then

        def merged(parts: list[pa.RecordBatch]):
            table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            row, n, words = _entries(table)
            every = pa.concat_arrays([table.column(c).cast(pa.large_string()) for c in ("lang", "first")] + [words, pa.array([""], pa.large_string())]).dictionary_encode()
            codes = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            m = table.num_rows
            lang, first, pairs = codes[:m], codes[m : 2 * m], codes[2 * m : -1].reshape(-1, 2)
            sliced = table.column("slice").to_numpy()
            # number of the stripe of each row, as they come sorted
            stripe = np.cumsum(np.concatenate([[0], (lang[1:] != lang[:-1]) | (first[1:] != first[:-1]) | (sliced[1:] != sliced[:-1])]))
            own = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]]))
            key, second, third, sums = _counted(stripe[row], pairs[:, 0], pairs[:, 1], n, max(len(every.dictionary), int(stripe[-1]) + 1))
            return lang[own][key], first[own][key], sliced[own][key], second, third, sums, every.dictionary

        def stripe_key(batch: pa.RecordBatch, i: int) -> tuple:
            return tuple(batch.column(c)[i].as_py() for c in ("lang", "first", "slice"))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, last = stripe_key(batch, batch.num_rows - 1), batch.num_rows
            same = np.ones(batch.num_rows, bool)
            for c, v in zip(("lang", "first", "slice"), key, strict=True):
                same &= pc.equal(batch.column(c), v).to_numpy(zero_copy_only=False)
            begins = last - int(np.argmin(same[::-1])) if not same.all() else 0
            if begins or held and stripe_key(held[0], 0) != key:
                done = held + ([batch.slice(0, begins)] if begins else [])
                yield rows(*merged(done))
                held = [batch.slice(begins)]
                continue
            held.append(batch)
            if len(held) >= 16:  # elementwise sums of one stripe in place of its parts
                lang, first, sliced, second, third, n, names = merged(held)
                held = list(_stripe_batches_of(key, names, second, third, n))
        if held:
            yield rows(*merged(held))

    return merge


def _stripe_batches_of(key: tuple, names: pa.Array, second: np.ndarray, third: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    nexts = " ".join(names.take(pa.array(np.stack([second, third], 1).ravel())).to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([key[2]], pa.int32()), pa.array([nexts]), pa.array([np.ascontiguousarray(n, "<i8").tobytes()], pa.binary())], ["lang", "first", "slice", "nexts", "counts"])


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, entries: int | None = None, at_once: int = WORDS) -> DataFrame:
    """(lang, w1, w2, w3, n, longest): all words with their counts, and what of two and three words comes ``least`` times.

    ``longest``: of two words, the greatest count of the candidates that prolong them by a word.
    """
    rows = in_small_batches(docs).select(_language(F.col(lang)).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    counters = word_counters(rows)
    stripes = rows.mapInArrow(_stripes(counters, entries or _slice_size(counters), at_once), STRIPES)
    dealt = stripes.repartition("lang", "first", "slice").sortWithinPartitions("lang", "first", "slice")
    grams = dealt.mapInArrow(_merge(least), GRAMS)
    return grams.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"), F.max("longest").alias("longest")).where(F.col("w2").isNull() | (F.col("n") >= least))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, percent: int = LEAST_PERCENT, top: int | None = TOP, **dealing: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` of each language; all if it is None; ``dealing``: of ``gram_counts``."""
    grams = cut(gram_counts(docs, text, lang, least, **dealing))
    one = grams.where("w2 IS NULL").select("lang", F.col("w1").alias("w"), F.col("n").alias("f"))
    two = grams.where("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", F.col("n").alias("a"), "longest")
    three = grams.where("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
    first, last = (one.select("lang", F.col("w").alias(w), F.col("f").alias(f)) for w, f in (("w1", "f1"), ("w2", "f2")))
    # a longer candidate may hold two words at its end as well
    behind = three.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("before"))
    short = two.join(behind, ["lang", "w1", "w2"], "left").where(100 * F.greatest("longest", F.coalesce("before", F.lit(0))) < percent * F.col("a"))

    def score(l: str, r: str) -> Column:  # noqa: E741
        a, x, y = (f"cast({c} AS decimal(16,0))" for c in ("a", l, r))
        return F.expr(f"({a} * {a} * 1000000BD) div ({x} * {y})")

    pairs = short.join(first, ["lang", "w1"]).join(last, ["lang", "w2"]).select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.struct(score("f1", "f2").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f2").alias("r")).alias("x"))
    heads = two.select("lang", "w1", "w2", F.col("a").alias("f12"))
    tails = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    third = one.select("lang", F.col("w").alias("w3"), F.col("f").alias("f3"))
    cuts = three.join(heads, ["lang", "w1", "w2"]).join(tails, ["lang", "w2", "w3"]).join(first, ["lang", "w1"]).join(third, ["lang", "w3"])
    both = F.least(*[F.struct(score(l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, l, r in ((1, "f1", "f23"), (2, "f12", "f3"))])
    scored = pairs.unionByName(cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", both.alias("x")))
    def ranked(rows: DataFrame, *within: Column) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *within).orderBy(F.desc("x.score"), F.desc("a"), "phrase")).cast("long"))

    if top:  # of each part of a language no more than it can give, so that the last window holds few rows
        scored = ranked(scored, F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).where(F.col("rank") <= top)
    ranks = ranked(scored)
    ranks = ranks.where(F.col("rank") <= top) if top else ranks
    sizes = one.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranks.join(sizes, "lang").select("lang", "rank", "phrase", "a", "x.l", "x.r", "n", "x.score")
