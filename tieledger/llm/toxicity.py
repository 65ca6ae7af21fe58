"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs with one word left out.  Each shard of the
labelled rows runs FTRL-proximal (McMahan et al., 2013) with its own per-coordinate rates; shards start every pass from
the averaged weights of the one before.  L1 leaves few weights; these are broadcast.

Defined cases: null or empty texts have the score of the bias alone; only labels 0 and 1 are learnt from, other rows are
skipped; with no labelled row every score is 0; repeated rows are scored alike; input columns with the new names are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieledger.llm.batches import in_small_batches
from tieledger.llm.hashing import mixed, word_hashes
from tieledger.sources.tables import cut

BITS = 20
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class ToxModel:
    bias: float
    ids: np.ndarray
    weights: np.ndarray
    #: Sums of squared gradients, which set the rates of a next round; of the bias, and by id.
    bias_n: float = 0.0
    ns: np.ndarray | None = None


#: Bytes that are part of words: ASCII letters and digits, and all bytes of other characters.
_INSIDE = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])


def features(text: str | None) -> np.ndarray:
    """All hashed features of a whole text, repeats included: words, pairs, pairs over one word."""
    h = word_hashes(np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8), _INSIDE)
    with np.errstate(over="ignore"):
        every = np.concatenate([h, mixed(h[:-1] * _PAIR + h[1:]), mixed(h[:-2] * _SKIP + h[2:])])
    return (every >> np.uint64(64 - BITS)).astype(np.int64)


def _train(alpha: float, beta: float, l1: float, l2: float, passes: int, start: ToxModel | None):
    schema_cols = ["id", "w", "n"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        size = (1 << BITS) + 1
        z, n, bias = np.zeros(size), np.zeros(size), size - 1
        if start is not None:  # z for which the present weights come out
            n[start.ids], n[bias] = start.ns, start.bias_n
            z[start.ids] = -(start.weights * ((beta + np.sqrt(start.ns)) / alpha + l2) + np.sign(start.weights) * l1)
            z[bias] = -start.bias * ((beta + np.sqrt(start.bias_n)) / alpha + l2)
        rows = rows.sort_values(["order", "text"], ignore_index=True)
        feats = [np.append(np.unique(features(t)), bias) for t in rows["text"]]
        labels = rows["y"].to_numpy(dtype=float)

        def weights(at: np.ndarray) -> np.ndarray:
            zi = z[at]
            w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
            w[(np.abs(zi) <= l1) & (at != bias)] = 0
            if at[-1] == bias:
                w[-1] = -z[bias] / ((beta + np.sqrt(n[bias])) / alpha + l2)
            return w

        for _ in range(passes):
            for at, y in zip(feats, labels, strict=True):
                w = weights(at)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                more = np.sqrt(n[at] + g * g)
                z[at] += g - (more - np.sqrt(n[at])) / alpha * w
                n[at] += g * g
        every = np.append(np.flatnonzero(np.abs(z[:bias]) > l1), bias)
        return pd.DataFrame({"id": every, "w": weights(every), "n": n[every]}, columns=schema_cols)

    return run


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, per_shard: int = 6_000, rounds: int = 2, passes: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0) -> ToxModel:
    """Fit on docs (doc_id, text) and their labels (doc_id, y).

    At most about ``max_docs`` labels, chosen by a hash of doc_id, are learnt from.  Being so few they are broadcast, so
    that no text is shuffled to find its label, and the texts found are written once.  A shard holds about ``per_shard``
    of them; the driver gets the weights that L1 left, 2**20 at most.
    """
    labels = labels.select("doc_id", "y").where("y IN (0, 1) AND doc_id IS NOT NULL")
    n = labels.count()
    if not n:
        return ToxModel(-100.0, np.zeros(0, np.int64), np.zeros(0))
    shards = -(-min(n, max_docs) // per_shard)
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2**31)) < int(2**31 * min(1.0, max_docs / n)))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    order, shard = F.xxhash64("text", "y"), F.pmod(F.xxhash64("text", F.lit(7)), F.lit(shards)).cast("int")
    sample = cut(sample.select("text", "y", order.alias("order"), shard.alias("shard")))
    used = sample.select("shard").distinct().count()
    if not used:
        return ToxModel(-100.0, np.zeros(0, np.int64), np.zeros(0))
    model = None
    for _ in range(rounds):
        parts = sample.groupBy("shard").applyInPandas(_train(alpha, beta, l1, l2, passes, model), "id long, w double, n double")
        rows = parts.groupBy("id").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
        rows = sorted((r["id"], r["w"] / used, r["n"] / used) for r in rows)
        bias, bias_n = next(((w, n) for i, w, n in rows if i == 1 << BITS), (0.0, 0.0))
        rows = [r for r in rows if r[0] != 1 << BITS and r[1]]
        ids, weights, ns = (np.array([r[k] for r in rows], kind) for k, kind in enumerate((np.int64, float, float)))
        model = ToxModel(bias, ids, weights, bias_n, ns)
    return model


def score(df: DataFrame, model: ToxModel, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the chance, from 0 to 1, that a whole text is toxic."""
    model_of = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = model_of.value
        w = np.zeros(1 << BITS)
        w[held.ids] = held.weights
        for texts in batches:
            sums = []
            for t in texts:
                at = features(t)
                sums.append(w[np.unique(at[w[at] != 0])].sum())
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, float) + held.bias, -100, 100))))

    # held to be random, so that a filter on the result does not score all texts once more
    return in_small_batches(df).withColumn(out, scored.asNondeterministic()(F.col(f"`{text}`")))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
