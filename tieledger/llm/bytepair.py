"""Byte-level BPE of whole texts by overlapping chunks, and back to bytes.

A text longer than ``SIZE`` characters is cut into chunks that reach ``OVERLAP`` characters into the next one.  Chunks are dealt out
to tasks by a shuffle.  Each is pre-tokenised from its first character on, which may stand inside a piece, and encoded; pieces whose
end the chunk's own end could have moved are left off.  Whether a piece begins at a place decides all that comes behind it, so from
the first place at which both a chunk and the one before have a boundary, the later chunk is right.  Chunks are stitched there.
Where the overlap holds no such place (one piece of thousands of letters or blanks), the stretch up to the next one is
pre-tokenised again from the last sure boundary.  Shorter texts are one chunk each and are encoded where they are.

Ids are those that the ``tiktoken`` library gives for ordinary text: no special token is looked for.

Defined cases: a null or empty text has no ids and decodes to no bytes; equal long texts are encoded once and each row gets the
ids; repeated rows stay; other columns stay as they are, but for one named like the new one.  A null among ids is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieledger.llm.batches import in_small_batches
from tieledger.llm.tokencount import SPACE
from tieledger.llm.tokens import encoder

SIZE, OVERLAP = 1 << 15, 512
#: A piece is sure if the text goes on for so many characters behind it: what follows can reach two characters back ('re, 've, 'll).
SURE = 4


def pieces_pattern() -> regex.Pattern:
    """The vocabulary's pre-tokenizer, with white space spelled out."""
    import public_tokenizers

    spelled = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(spelled)


class Chunk(NamedTuple):
    """Pieces of a chunk: where they begin and end in the text, and how many ids come before each end."""

    bounds: np.ndarray  # the first piece's begin, then all ends
    counts: np.ndarray  # of ids before each of the bounds
    ids: np.ndarray


class Codec:
    """Encodes chunks and stitches them."""

    def __init__(self, path: str | None = None, size: int = SIZE, overlap: int = OVERLAP):
        self.encoding, self.pattern, self.size, self.overlap = encoder(path), pieces_pattern(), size, overlap
        self.space = regex.compile(f"[{SPACE}]")

    def ids(self, text: str | None) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text) if text else [], np.int32)

    def bounds(self, text: str, last: bool) -> np.ndarray:
        """Boundaries of pieces from the text's first character; without the unsure ones unless the text ends here."""
        ends = np.fromiter((m.end() for m in self.pattern.finditer(text)), np.int64)
        return np.concatenate([[0], ends if last else ends[ends <= len(text) - SURE]]).astype(np.int64)

    def chunk(self, text: str, start: int, last: bool) -> Chunk:
        """``text``: from ``start`` to the end of the overlap.  Only at a boundary in an overlap a stitch can be, so pieces between are encoded together."""
        bounds = self.bounds(text, last)
        a, b = np.searchsorted(bounds, self.overlap), np.searchsorted(bounds, self.size, side="right")
        b = min(max(b, a + 1), len(bounds))
        own = np.concatenate([bounds[: a + 1], bounds[b - 1 :]]) if b - 1 > a else bounds
        parts = [self.between(text, bounds[a:b]) if i == a and b - 1 > a else self.ids(text[x:y]) for i, (x, y) in enumerate(zip(own[:-1], own[1:], strict=True))]
        counts = np.cumsum([0, *map(len, parts)])
        return Chunk(own + start, counts, np.concatenate([np.zeros(0, np.int32), *parts]))

    def between(self, text: str, bounds: np.ndarray) -> np.ndarray:
        """Ids of the pieces between the first bound and the last, as if what follows stood there.

        Alone at the end of a text, two pieces of white space would be one; then the last is encoded for itself.
        """
        first, last = int(bounds[0]), int(bounds[-1])
        if len(bounds) > 2 and self.space.match(text, last - 1) and self.space.match(text, int(bounds[-2]) - 1):
            return np.concatenate([self.ids(text[first : int(bounds[-2])]), self.ids(text[int(bounds[-2]) : last])])
        return self.ids(text[first:last])

    def stitched(self, texts: list[str], chunks: list[Chunk]) -> np.ndarray:
        """Ids of a whole text; ``texts`` are the chunks with their overlaps."""
        out, k, at = [], 0, 0  # chunk k is right from place ``at`` on, which is a boundary of it
        while True:
            own = chunks[k]
            begin = own.counts[np.searchsorted(own.bounds, at)]
            if k + 1 == len(chunks):
                out.append(own.ids[begin:])
                return np.concatenate(out)
            common = np.intersect1d(own.bounds[own.bounds >= at], chunks[k + 1].bounds, assume_unique=True)
            if len(common):
                out.append(own.ids[begin : own.counts[np.searchsorted(own.bounds, common[0])]])
                k, at = k + 1, int(common[0])
                continue
            out.append(own.ids[begin:])
            k, at, between = self.bridged(texts, chunks, k, int(own.bounds[-1]))
            out.append(between)
            if k == len(chunks):
                return np.concatenate(out)

    def bridged(self, texts: list[str], chunks: list[Chunk], k: int, at: int) -> tuple[int, int, np.ndarray]:
        """From a sure boundary at ``at``, the last of chunk ``k``, to the first one that a later chunk has too: that chunk, the place, and the ids between."""
        begin, held, j = at, texts[k][at - k * self.size :], k
        while j + 1 < len(texts):
            j += 1
            held += texts[j][k * self.size + len(texts[k]) - j * self.size :] if j == k + 1 else texts[j][self.overlap :]
            ends = begin + self.bounds(held, j + 1 == len(texts))
            common = np.intersect1d(ends[ends > begin], chunks[j].bounds, assume_unique=True)
            if len(common):
                return j, int(common[0]), self.between(held, np.append(0, ends[(ends > begin) & (ends <= common[0])] - begin))
        return len(texts), begin + len(held), self.ids(held)

    def cuts(self, text: str) -> list[tuple[int, str]]:
        return [(a, text[a : a + self.size + self.overlap]) for a in range(0, max(1, len(text)), self.size)]

    def whole(self, text: str) -> np.ndarray:
        """All steps in one place."""
        cuts = self.cuts(text)
        return self.stitched([t for _, t in cuts], [self.chunk(t, a, k + 1 == len(cuts)) for k, (a, t) in enumerate(cuts)])


def _encoded_here(text: Column, vocabulary: str | None) -> Column:
    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(vocabulary)
        for texts in batches:
            yield pd.Series([codec.ids(t) for t in texts], dtype="object")

    return ids.asNondeterministic()(text)


_CHUNKS = "print string, k int, n int, text string"
_ENCODED = "print string, k int, text string, bounds array<long>, counts array<int>, ids array<int>"


def _long_ids(texts: DataFrame, vocabulary: str | None, size: int) -> DataFrame:
    """texts (print, text) -> (print, ids), one row for each different text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for print_, text in zip(rows["print"], rows["text"], strict=True):
                starts = range(0, len(text), size)
                for at in range(0, len(starts), 64):  # a few MB at a time
                    part = starts[at : at + 64]
                    yield pd.DataFrame({"print": print_, "k": range(at, at + len(part)), "n": len(starts), "text": [text[a : a + size + OVERLAP] for a in part]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(vocabulary, size)
        for rows in batches:
            done = [codec.chunk(t, k * size, k + 1 == n) for k, n, t in zip(rows["k"], rows["n"], rows["text"], strict=True)]
            yield pd.DataFrame({"print": rows["print"], "k": rows["k"], "text": rows["text"], "bounds": [c.bounds for c in done], "counts": [c.counts for c in done], "ids": [c.ids for c in done]})

    held: list[Codec] = []

    def stitch(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
        held or held.append(Codec(vocabulary, size))
        rows = rows.sort_values("k")
        chunks = [Chunk(np.asarray(b), np.asarray(c), np.asarray(i, np.int32)) for b, c, i in zip(rows["bounds"], rows["counts"], rows["ids"], strict=True)]
        return pd.DataFrame({"print": [key[0]], "ids": [held[0].stitched(list(rows["text"]), chunks)]})

    # the chunks of equal texts are equal; one of each is encoded, wherever it lands
    chunks = texts.mapInPandas(cut, _CHUNKS).dropDuplicates(["print", "k"])
    return chunks.mapInPandas(encode, _ENCODED).groupBy("print").applyInPandas(stitch, "print string, ids array<int>")


def encoded(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None, size: int = SIZE) -> DataFrame:
    """``df`` with the ids of its text column; ``size``: characters of a chunk."""
    df = in_small_batches(df).drop(ids)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    long = F.length(whole) > size
    here = df.where(~long).withColumn(ids, _encoded_here(whole, vocabulary))
    printed = df.where(long).withColumn("__print", F.sha2(whole, 256))
    apart = _long_ids(printed.select(F.col("__print").alias("print"), whole.alias("text")), vocabulary, size)
    there = printed.join(apart.select(F.col("print").alias("__print"), F.col("ids").alias(ids)), "__print")
    return here.unionByName(there.drop("__print"))


def decoded(ids: Column, vocabulary: str | None = None) -> Column:
    """The bytes that ids stand for, one after the other; they need not be UTF-8."""

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = encoder(vocabulary)
        table = [encoding.decode_single_token_bytes(i) for i in range(encoding.n_vocab)]
        for rows in batches:
            yield pd.Series([b"".join(map(table.__getitem__, row)) if row is not None else None for row in rows], dtype="object")

    return raw(ids)


def report(df: DataFrame) -> DataFrame:
    """doc_id with the number of ids, and digests of ids and of the bytes they stand for."""
    rows = encoded(df.select("doc_id", "text"))
    sizes = rows.select("doc_id", "ids", decoded(F.col("ids")).alias("bytes"))
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return sizes.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
