"""Near-duplicate documents by b-bit MinHash, with links confirmed on the full shingle sets.

1. One pass over the texts gives every document the fingerprint of its shingle set, band keys over its minima, and the
   low bits of the minima packed into a few integers.  Documents with equal sets form a class; its smallest doc_id
   stands for it from here on, so copies are never paired.
2. Classes that share a band key are candidates.  In a bucket they are first compared with one centre (twice, with
   different centres), which joins a group of near copies with as many comparisons as it has members.  Then every class
   that does not share a bucket's main label is compared with all members of other labels, in blocks.  Nothing is capped.
3. A candidate pair goes on only if the similarity estimated from packed low bits, corrected for chance agreements of b
   bits, is no more than 4.5 standard errors below the threshold, and if the set sizes allow the threshold.
4. What is left is confirmed by the exact similarity of the full sets.

With 32 bands of 4 minima a pair at similarity 0.75 shares no band with a chance of 5 in a million.

Defined cases: a null text or one without words has an empty set and is linked with nothing; a text with fewer words
than a shingle is one shingle; rows with a null doc_id are linked with nothing and kept, with a null component; rows
that share a doc_id are one node, so whatever any of them links is linked; an empty table gives an empty one; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieledger.llm.batches import in_small_batches
from tieledger.llm.hashing import mixed, word_hashes
from tieledger.operators.components import connected_components
from tieledger.sources.tables import cut

WORDS, BANDS, ROWS, BITS = 5, 32, 4, 4
HASHES = BANDS * ROWS
#: Members that are compared with one copy of a centre; documents and shingles of a block, of which two are compared at a time.
GROUP, BLOCK_DOCS, BLOCK_SHINGLES = 128, 1024, 2_000_000
_SPACES = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; A-Z count as a-z."""
    h = word_hashes(np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8), ~_SPACES)
    if not len(h):
        return h
    k = min(words, len(h))
    sums = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            sums = sums * _TIMES + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(sums))


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            np.minimum(least, np.multiply.outer(_FACTORS, shingles[i : i + 2048]).min(axis=1), out=least)
    return least


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), ">i8")
    return int(digest[0]), int(digest[1])


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in least.reshape(BANDS, ROWS).T:
            keys = mixed(keys * _TIMES + column)
    return keys.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 16 in an integer."""
    low = (mixed(least) & np.uint64(2**BITS - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, fp, fp2, sig, bands; sig and bands are null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                own = shingle_set(text, words)
                if not len(own):
                    out.append((doc, 0, None, None, None, None))
                    continue
                least = minima(own)
                out.append((doc, len(own), *fingerprint(own), packed(least), band_keys(least)))
            frame = pd.DataFrame(out, columns=["doc_id", "n_shingles", "fp", "fp2", "sig", "bands"])
            yield frame.astype({"doc_id": "Int64", "fp": "Int64", "fp2": "Int64"})

    schema = "doc_id long, n_shingles long, fp long, fp2 long, sig array<long>, bands array<long>"
    return in_small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInPandas(run, schema)


def differing(a: Column, b: Column) -> Column:
    """Of the packed minima, how many differ in their low bits."""
    marks = int("1" * (64 // BITS), 16)

    def one(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        folded = reduce(lambda y, k: y.bitwiseOR(F.shiftrightunsigned(x, k)), range(1, BITS), x)
        return F.bit_count(folded.bitwiseAND(F.lit(marks)))

    return reduce(lambda x, y: x + y, [one(i) for i in range(HASHES * BITS // 64)])


def most_differing(threshold: float, errors: float = 4.5) -> int:
    """Differences up to which a pair at the threshold may go, chance agreement of b bits included."""
    agree = threshold + (1 - threshold) / 2**BITS
    return int(HASHES * (1 - agree + errors * (agree * (1 - agree) / HASHES) ** 0.5))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Pairs (a, fa, b, fb) of doc_ids with the fingerprints of their sets -> those (a, b) similar on full sets.

    The members of a centre b are dealt by a hash into groups of about ``GROUP``; the centre's text goes to each of them.  A
    task holds one centre's set at a time.  Where rows share a doc_id, the fingerprint tells whose set is meant.
    """
    large = pairs.groupBy("b", "fb").agg(F.ceil(F.count("*") / GROUP).alias("groups")).where("groups > 1")
    salted = pairs.join(large, ["b", "fb"], "left")
    salted = salted.withColumn("salt", F.when(F.col("groups").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.col("groups"))))
    members = salted.select(F.col("a").alias("doc_id"), F.col("fa").alias("fp"), "b", "fb", "salt", F.lit(1).alias("role"))
    centres = salted.select("b", "fb", "salt").distinct()
    centres = centres.select(F.col("b").alias("doc_id"), F.col("fb").alias("fp"), "b", "fb", "salt", F.lit(0).alias("role"))
    rows = in_small_batches(members).unionByName(centres).join(texts.select("doc_id", "text"), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, held = None, None
        for part in batches:
            out = []
            for doc, fp, b, fb, role, text in zip(*(part[c] for c in ("doc_id", "fp", "b", "fb", "role", "text")), strict=True):
                own = shingle_set(text, words)
                if fingerprint(own)[0] != fp:
                    continue
                if role == 0:
                    centre, held = (b, fb), own
                elif (b, fb) == centre and _similar(own, held, percent):
                    out.append((doc, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    dealt = rows.repartition("b", "fb", "salt").sortWithinPartitions("b", "fb", "salt", "role")
    return dealt.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = WORDS, centres: int = 2) -> DataFrame:
    """(doc_id, text) -> one row per row: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = cut(signatures(docs, words))
    can = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    of_class = can.groupBy("fp", "fp2").agg(F.min_by(F.struct("doc_id", "n_shingles", "sig", "bands"), "doc_id").alias("x"))
    classes = cut(of_class.select("fp", "fp2", F.col("x.doc_id").alias("doc"), F.col("x.n_shingles").alias("n"), F.col("x.sig").alias("sig"), F.col("x.bands").alias("bands")))

    banded = classes.select("doc", "fp", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    shared = banded.join(shared, "key")
    # the buckets that have company: key, doc, fp, n, sig
    held = cut(shared.join(classes.select("doc", "fp", "n", "sig"), ["doc", "fp"]))
    texts = cut(docs.join(held.select(F.col("doc").alias("doc_id")).distinct(), "doc_id"))

    sure = most_differing(percent / 100)

    def plausible(x: str, y: str) -> Column:
        sizes = F.lit(100) * F.least(f"{x}.n", f"{y}.n") >= F.lit(percent) * F.greatest(f"{x}.n", f"{y}.n")
        return (F.col(f"{x}.comp") != F.col(f"{y}.comp")) & sizes & (differing(F.col(f"{x}.sig"), F.col(f"{y}.sig")) <= sure)

    links = None
    ends = [F.col("x.doc").alias("a"), F.col("x.fp").alias("fa"), F.col("y.doc").alias("b"), F.col("y.fp").alias("fb")]
    members = held.withColumn("comp", F.col("doc"))
    for turn in range(centres):
        order = F.col("doc") if turn == 0 else F.xxhash64("doc", F.lit(turn))
        one = _mixed(members).groupBy("key").agg(F.min_by(F.struct("doc", "fp", "n", "sig", "comp"), order).alias("y"))
        pairs = members.alias("x").join(one, "key").where(plausible("x", "y")).select(*ends).distinct()
        new = cut(confirmed(pairs, texts, percent, words))
        links = new if links is None else links.unionByName(new)
        # a centre's label holds for all that are linked with it, and then the centre's own label for the centre's
        to = links.groupBy("a").agg(F.min("b").alias("b"))
        to = to.alias("p").join(to.alias("q"), F.col("p.b") == F.col("q.a"), "left").select(F.col("p.a").alias("doc"), F.least("p.a", "p.b", "q.b").alias("label"))
        members = cut(held.join(to, "doc", "left").withColumn("comp", F.coalesce("label", "doc")).drop("label"))
    links = links.unionByName(_strays_confirmed(members, texts, percent, words, sure))

    copies = can.select("doc_id", "fp", "fp2").join(classes.select("fp", "fp2", "doc"), ["fp", "fp2"]).where("doc_id <> doc")
    every = links.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("doc").alias("b")))
    comps = connected_components(every).withColumnRenamed("node", "doc_id")
    out = signed.select("doc_id", "n_shingles").join(comps, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _mixed(members: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one label."""
    several = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return members.join(several, "key")


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames that end where a cell ends, from rows sorted by cell."""
    held = None
    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        cell = rows[["key", "i", "j"]].to_numpy()
        last = int(np.flatnonzero((cell != cell[-1]).any(axis=1)).max(initial=-1)) + 1 if len(rows) else 0
        held = rows.iloc[last:]
        if last:
            yield rows.iloc[:last]
    if held is not None and len(held):
        yield held


def _block(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(doc.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _plausible(percent: int, sure: int, blocks: int):
    """Cells of buckets, sorted -> pairs of a stray and a member that may be similar, packed by blocks of documents."""
    marks = np.uint64(int("1" * (64 // BITS), 16))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _cells(batches):
            cell, role, stray = rows[["key", "i", "j"]].to_numpy(), rows["role"].to_numpy(), rows["stray"].to_numpy(bool)
            sig = np.array(rows["sig"].tolist(), np.int64).view(np.uint64)
            doc, comp, n = (rows[c].to_numpy(np.int64) for c in ("doc", "comp", "n"))
            ends = np.append(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1, len(rows))
            found, begin = [], 0
            for end in ends.tolist():
                split = begin + int((role[begin:end] == 0).sum())
                for i in range(begin, split, 32):
                    x, y = slice(i, min(i + 32, split)), slice(split, end)
                    d = sig[x, None, :] ^ sig[None, y, :]
                    folded = d
                    for k in range(1, BITS):
                        folded = folded | (d >> np.uint64(k))
                    near = np.bitwise_count(folded & marks).sum(axis=2) <= sure
                    near &= comp[x, None] != comp[None, y]
                    near &= 100 * np.minimum(n[x, None], n[None, y]) >= percent * np.maximum(n[x, None], n[None, y])
                    near &= ~stray[None, y] | (doc[x, None] < doc[None, y])
                    p, q = np.nonzero(near)
                    if len(p):
                        found.append(np.stack([doc[x][p], doc[y][q]]))
                begin = end
            if found:
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                frame = pd.DataFrame({"x": pairs[0], "y": pairs[1], "bx": _block(pairs[0], blocks), "by": _block(pairs[1], blocks)})
                packed_rows = [(bx, by, g["x"].to_numpy(np.int64).tobytes(), g["y"].to_numpy(np.int64).tobytes()) for (bx, by), g in frame.groupby(["bx", "by"])]
                yield pd.DataFrame(packed_rows, columns=["bx", "by", "xs", "ys"])

    return run


def _once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pairs of two blocks of documents, each once, and the documents on them; rows come sorted by blocks."""
    at, held, more = None, np.zeros((2, 0), np.int64), []

    def merged() -> np.ndarray:
        return np.unique(np.concatenate([held, *more], axis=1), axis=1)

    def row() -> pd.DataFrame:
        pairs = merged()
        return pd.DataFrame({"bx": [at[0]], "by": [at[1]], "xs": [pairs[0].tobytes()], "ys": [pairs[1].tobytes()], "docs": [np.unique(pairs).tolist()]})

    for rows in batches:
        for bx, by, xs, ys in zip(rows["bx"], rows["by"], rows["xs"], rows["ys"], strict=True):
            if at != (bx, by):
                if at is not None:
                    yield row()
                at, held, more = (bx, by), np.zeros((2, 0), np.int64), []
            more.append(np.stack([np.frombuffer(xs, np.int64), np.frombuffer(ys, np.int64)]))
            if sum(x.shape[1] for x in more) > 500_000:  # what repeats does not pile up
                held, more = merged(), []
    if at is not None:
        yield row()


def _exact(percent: int, words: int):
    """The pairs of two blocks, and the texts of their documents -> links that join what is similar."""

    def run(pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs) or not len(texts):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        xs, ys = (np.frombuffer(pairs[c].iloc[0], np.int64) for c in ("xs", "ys"))
        docs = texts["doc_id"].to_numpy(np.int64)
        sets = [shingle_set(t, words) for t in texts["text"]]
        sizes = np.array([len(own) for own in sets])
        keep = sizes > 0
        docs, sets, sizes = docs[keep], [own for own in sets if len(own)], sizes[keep]
        known, ids = np.unique(np.concatenate(sets), return_inverse=True)
        begins = np.cumsum(sizes) - sizes
        row_of: dict[int, list[int]] = {}
        for k, d in enumerate(docs.tolist()):
            row_of.setdefault(d, []).append(k)
        order = np.argsort(xs, kind="stable")
        xs, ys = xs[order], ys[order]
        i, j = [], []
        for part in np.split(np.arange(len(xs)), np.flatnonzero(np.diff(xs)) + 1):
            own = ys[part].tolist()
            for k in row_of.get(int(xs[part[0]]), ()):
                held = np.zeros(len(known), bool)
                held[ids[begins[k] : begins[k] + sizes[k]]] = True
                rows = [m for d in own for m in row_of.get(d, ())]
                if not rows:
                    continue
                theirs = np.concatenate([ids[begins[m] : begins[m] + sizes[m]] for m in rows])
                both = np.add.reduceat(held[theirs].astype(np.int64), np.cumsum(sizes[rows]) - sizes[rows])
                same = 100 * both >= percent * (sizes[rows] + sizes[k] - both)
                i += docs[np.array(rows)[same]].tolist()
                j += [int(xs[part[0]])] * (len(i) - len(j))
        ends = np.unique(np.array(i + j, np.int64))
        if not len(ends):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        at = np.arange(len(ends))
        p, q = np.searchsorted(ends, i), np.searchsorted(ends, j)
        while True:  # the smallest document that links lead to
            new = at.copy()
            least = np.minimum(at[p], at[q])
            np.minimum.at(new, p, least)
            np.minimum.at(new, q, least)
            new = new[new]
            if (new == at).all():
                return pd.DataFrame({"a": ends, "b": ends[at]})
            at = new

    return run


def _strays_confirmed(members: DataFrame, texts: DataFrame, percent: int, words: int, sure: int) -> DataFrame:
    """Links of what is not in a bucket's main label with all others of the bucket, tested exactly.

    Pairs are never rows.  Cells of at most about ``BLOCK_DOCS`` members of a bucket squared make packed lists of plausible
    pairs; these are brought together by blocks of documents, each block's texts once, and tested there.  Documents are dealt
    into blocks by a hash, as many as keep a block's documents and shingles near their bounds.
    """
    block = BLOCK_DOCS
    todo = _mixed(members)
    sizes = todo.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.ceil(F.sum("c") / block).cast("int").alias("parts"))
    marked = todo.join(main, "key").withColumn("stray", F.col("comp") != F.col("main")).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))
    others = F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)
    cols = ["key", "doc", "n", "sig", "comp", "stray"]
    one = marked.where("stray").select(*cols, F.lit(0).alias("role"), F.col("part").alias("i"), F.explode(others).alias("j"))
    two = marked.select(*cols, F.lit(1).alias("role"), F.explode(others).alias("i"), F.col("part").alias("j"))
    n_docs, n_shingles = members.select("doc", "n").distinct().agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-n_docs // block), -(-n_shingles // BLOCK_SHINGLES))
    cells = one.unionByName(two).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")
    packed_pairs = cells.mapInPandas(_plausible(percent, sure, blocks), "bx long, by long, xs binary, ys binary")
    packed_pairs = packed_pairs.repartition("bx", "by").sortWithinPartitions("bx", "by")
    pairs = cut(packed_pairs.mapInPandas(_once, "bx long, by long, xs binary, ys binary, docs array<long>"))
    wanted = pairs.select(F.col("bx").alias("tx"), F.col("by").alias("ty"), F.explode("docs").alias("doc_id"))
    with_text = wanted.join(texts.select("doc_id", "text"), "doc_id")
    return cut(pairs.drop("docs").groupBy("bx", "by").cogroup(with_text.groupBy("tx", "ty")).applyInPandas(_exact(percent, words), "a long, b long"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; rows of a kept doc_id all stay."""
    gone = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
