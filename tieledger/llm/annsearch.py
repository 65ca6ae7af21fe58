"""Approximate nearest neighbours by additive quantisation.

A vector of length 1 is approximated by a sum of one codeword from each of several full-dimensional codebooks.  The
codebooks are fitted to residuals on a bounded sample; every row is encoded by beam search, and the length of its
approximation is stored with the codes.  A query adds up table entries, one for each codeword, and divides by the stored
length.  The best of that list are ranked by the exact cosine of the original vectors, in double precision.

Queries and codes meet in blocks of bounded size: a stated set of queries against all rows.

Defined cases: vectors that are null, zero or hold null or non-finite components, or whose length is not the table's usual
one, take no part, as queries or candidates; a null vec_id takes no part; rows that share a vec_id count once, with the
smallest vector; a query never finds its own vec_id; equal scores go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieledger.llm.vectors import sample, unit, usable, usual_length
from tieledger.sources.tables import cut

#: Codebooks, codewords of each, width of the beam; rows of a block of codes and of queries; candidates that are ranked exactly.
BOOKS, WORDS, BEAM, CODES, QUERIES, SHORTLIST = 24, 256, 3, 16_384, 1024, 240


@dataclass
class Codebooks:
    """``words``: books x codewords x dimensions."""

    words: np.ndarray

    def tables(self, queries: np.ndarray) -> np.ndarray:
        return np.einsum("qd,mkd->mqk", queries, self.words, optimize=True).astype(np.float32)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the lengths of the approximations."""
        books, k, d = self.words.shape
        words = self.words.astype(np.float32)
        own = (words * words).sum(axis=2)
        codes_out, lengths = np.empty((len(x), books), np.uint8), np.empty(len(x), np.float32)
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048].astype(np.float32)
            rows = np.arange(len(part))[:, None]
            left, codes = part[:, None, :], np.zeros((len(part), 1, 0), np.uint8)  # what each of the beam has yet to explain
            for m in range(books):
                cost = (left * left).sum(axis=2)[:, :, None] + own[m] - 2 * (left.reshape(-1, d) @ words[m].T).reshape(len(part), -1, k)
                flat = cost.reshape(len(part), -1)
                best = np.argpartition(flat, beam - 1, axis=1)[:, :beam]
                came, word = best // k, best % k
                left = left[rows, came] - words[m][word]
                codes = np.concatenate([codes[rows, came], word[:, :, None].astype(np.uint8)], axis=2)
            first = (left * left).sum(axis=2).argmin(axis=1)
            codes_out[at : at + len(part)] = codes[rows[:, 0], first]
            lengths[at : at + len(part)] = np.sqrt(((part - left[rows[:, 0], first]) ** 2).sum(axis=1))
        return codes_out, lengths


def _means(x: np.ndarray, k: int, draw: np.random.Generator, turns: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[draw.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(turns):
        to = (x @ centres.T * -2 + (centres * centres).sum(axis=1)).argmin(axis=1)
        n = np.bincount(to, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, to, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], x[draw.integers(0, len(x), k)])
    return centres, (x @ centres.T * -2 + (centres * centres).sum(axis=1)).argmin(axis=1)


def fit(df: DataFrame, dims: int, books: int = BOOKS, words: int = WORDS, most: int = 12_000, seed: int = 5) -> Codebooks:
    """Residual codebooks from a sample of about ``most`` vectors; the model is books x words x dims numbers."""
    x = sample(df, dims, most).astype(np.float32)
    draw, made = np.random.default_rng(seed), []
    for _ in range(books):
        if not len(x):
            made.append(np.zeros((words, dims), np.float32))
            continue
        centres, to = _means(x, words, draw)
        made.append(centres.astype(np.float32))
        x = x - centres[to]
    return Codebooks(np.stack(made))


def _top(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``most`` best of each row; equal ones from the left."""
    if scores.shape[1] > most:
        least = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
    else:
        least = scores.min(axis=1)
    row, col = np.nonzero(scores >= least[:, None])
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < most], col[rank < most]


def _shortlisted(model: Codebooks, most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["side"].nunique() < 2:  # a block number without rows
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
        codes_row, query_row = rows[rows["side"] == 0].iloc[0], rows[rows["side"] == 1].iloc[0]
        ids, qids = np.frombuffer(codes_row["ids"], np.int64), np.frombuffer(query_row["ids"], np.int64)
        books, dims = model.words.shape[0], model.words.shape[2]
        codes = np.frombuffer(codes_row["payload"], np.uint8).reshape(-1, books)
        lengths = np.frombuffer(codes_row["lengths"], np.float32)
        queries = np.frombuffer(query_row["payload"], np.float64).reshape(-1, dims)
        out = []
        for at in range(0, len(qids), 64):
            tables = model.tables(queries[at : at + 64])
            scores = np.zeros((tables.shape[1], len(ids)), np.float32)
            for m in range(books):
                scores += tables[m][:, codes[:, m]]
            scores /= lengths
            scores[qids[at : at + 64][:, None] == ids[None, :]] = -np.inf
            row, col = _top(scores, most)
            begin = np.searchsorted(row, np.arange(len(scores) + 1))
            for r in range(len(scores)):
                own = col[begin[r] : begin[r + 1]]
                own = own[scores[r, own] > -np.inf]
                out.append((int(qids[at + r]), ids[own].tolist(), scores[r, own].astype(float).tolist()))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    return run


def _packed(model: Codebooks | None):
    """A block of vectors as one row: ids, and codes with lengths or the vectors themselves."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", ignore_index=True)
        x = unit(np.array([np.asarray(e, float) for e in rows["embedding"]]))
        payload, lengths = model.encode(x) if model else (x, np.zeros(0, np.float32))
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "payload": [payload.tobytes()], "lengths": [np.maximum(lengths, 1e-9).tobytes()]})

    return run


def _merged(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, scores = np.concatenate(rows["ids"].tolist()), np.concatenate(rows["scores"].tolist())
        best = np.lexsort((ids, -scores))[:most]
        return pd.DataFrame({"query_id": [rows["query_id"].iloc[0]], "ids": [ids[best].tolist()]})

    return run


_BLOCK = "block long, ids binary, payload binary, lengths binary"


def index(rows: DataFrame, model: Codebooks, blocks: int) -> DataFrame:
    """Every row encoded: blocks of ids, codes and lengths."""
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block").applyInPandas(_packed(model), _BLOCK)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(df: DataFrame, is_query: Column, k: int = 5, shortlist: int = SHORTLIST) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: the k nearest found of each row that ``is_query`` marks."""
    good = df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "embedding")
    dims = usual_length(good)
    rows = cut(good.where(F.size("embedding") == dims).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    n = rows.count()
    model = fit(rows, dims)
    blocks = max(min(8, -(-n // 512)), -(-n // CODES))
    codes = cut(index(rows, model, blocks))
    asked = rows.where(is_query)
    query_blocks = max(1, -(-asked.count() // QUERIES))
    asked_blocks = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(query_blocks))).groupBy("block").applyInPandas(_packed(None), _BLOCK)
    asked_blocks = cut(asked_blocks)
    # every block of codes meets every block of queries
    left = codes.withColumn("side", F.lit(0)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked_blocks.withColumn("side", F.lit(1)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = left.select(F.col("block").alias("c"), F.col("other").cast("long").alias("q"), "side", "ids", "payload", "lengths")
    right = right.select(F.col("other").cast("long").alias("c"), F.col("block").alias("q"), "side", "ids", "payload", "lengths")
    found = left.unionByName(right).groupBy("c", "q").applyInPandas(_shortlisted(model, shortlist), "query_id long, ids array<long>, scores array<double>")
    short = found.groupBy("query_id").applyInPandas(_merged(shortlist), "query_id long, ids array<long>")
    short = short.select("query_id", F.explode("ids").alias("vec_id"))
    exact = short.join(rows, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")), "query_id")
    score = _dot("embedding", "asked") / (F.sqrt(_dot("embedding", "embedding")) * F.sqrt(_dot("asked", "asked")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = exact.select("query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
