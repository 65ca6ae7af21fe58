"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size.  Its whole part is taken
outright; what is left is a fractional probability in [0, 1).  Pivotal rounding settles these fractions two documents
at a time: words are moved at random from one to the other, so that their expected sum stays as it is, until one of
them holds a whole number of copies.  Leaves of a few thousand documents are settled in parallel; each leaves at most
one fractional document, and these residuals meet in a reduction tree.  A source's taken words hence differ from its
target by less than one document.

Defined cases: a null text has no words (size 0) and is never taken with any words; a null source is a source, last in
the order; rows that share doc_id, source and size form one unit that is taken together; an empty table gives an empty
mix; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieledger.sources.tables import cut

#: Documents of a leaf and residuals of a node of the tree.
LEAF, FAN_IN = 4096, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) rows -> one row per source: source, rank, source_size, target.

    Weights repeat over the sources in code point order, null last.  ``share`` of all sizes is dealt by weight; no
    target exceeds ``most`` times its source's size.  Dealing the excess again until no target is above is the water
    level of ``sum(min(most * size, level * weight))``; it is found with prefix sums over the sources in the order in
    which they fill.  Only the table of distinct sources goes through these ordered windows.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("n_rows") if "n_rows" in sized.columns else F.lit(1)).alias("n_docs"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("rank", F.row_number().over(everything))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fills = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, after = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(fills.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # along the order the level rises while sources are full, and falls again once one counts as full that is not
    s = s.withColumn("at", F.max("level").over(Window.partitionBy(F.lit(1))))
    target = F.least(F.col("cap"), F.col("at") * F.col("w"))
    return s.select("source", "rank", "source_size", "n_docs", target.alias("target"))


def _uniform(seed: int, *parts: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([seed, *(int(x) & 0xFFFFFFFF for x in parts)]))


def pivot(p: np.ndarray, w: np.ndarray, draw: np.random.Generator) -> int:
    """Rounds ``p`` in place, in the given order; the index left fractional, or -1.

    ``w`` > 0 are the words that a copy holds.  A step keeps p[i] * w[i] + p[j] * w[j], and the expectation of both.
    """
    eps, i = 1e-12, -1
    for j in range(len(p)):
        if not eps < p[j] < 1 - eps:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        up = min(1 - p[i], p[j] * w[j] / w[i]) * w[i]  # words that can go from j to i
        down = min(p[i], (1 - p[j]) * w[j] / w[i]) * w[i]  # and from i to j
        moved = up if draw.random() * (up + down) < down else -down
        p[i] += moved / w[i]
        p[j] -= moved / w[j]
        done_i, done_j = not eps < p[i] < 1 - eps, not eps < p[j] < 1 - eps
        if done_i:
            p[i] = round(p[i])
        if done_j:
            p[j] = round(p[j])
        i = j if done_i and not done_j else -1 if done_i else i
    return i


def _settle(seed: int, level: int, last: bool):
    """A group (one source's leaf or node) -> the same rows, at most one of them still fractional."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what stays fractional is handed down to small ones
        rows = rows.sort_values(["words", "doc_id", "size"], ascending=[False, True, True], na_position="last", ignore_index=True)
        p, w = rows["p"].to_numpy(dtype=float).copy(), rows["words"].to_numpy(dtype=float)
        draw = _uniform(seed, level, int(rows["rank"].iloc[0]), int(rows["node"].iloc[0]))
        left = pivot(p, w, draw)
        if last and left >= 0:
            p[left] = float(draw.random() < p[left])
            left = -1
        rows["p"], rows["open"] = p, np.arange(len(rows)) == left
        rows["node"] = rows["node"] // FAN_IN
        return rows

    return run


def rounded_copies(sized: DataFrame, seed: int = 20240101, **targets) -> DataFrame:
    """(doc_id, source, size) rows -> units (doc_id, source, size, n_rows, source_size, target, copies).

    A unit stands for its ``n_rows`` equal rows.  The same rows give the same copies however they are partitioned:
    leaves are hashes of the unit, and the order within them and the seeds depend on values only.
    """
    units = cut(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows")))  # texts are read once
    sized = units.select("source", (F.col("size") * F.col("n_rows")).alias("size"), "n_rows")
    sources = source_targets(sized, **targets)
    deepest = sources.agg(F.max("n_docs")).first()[0] or 0
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    leaves = F.ceil(F.col("n_docs") / LEAF)
    rows = (
        units.join(sources.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
        .withColumn("words", F.col("size") * F.col("n_rows"))
        .withColumn("whole", F.floor(rate).cast("long"))
        .withColumn("p", F.when(F.col("words") > 0, rate - F.floor(rate)).otherwise(0.0))
        .withColumn("node", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), leaves).cast("long"))
        .select("doc_id", "source", "size", "n_rows", "source_size", "target", "rank", "words", "whole", "p", "node", F.lit(False).alias("open"))
    )
    rows = cut(rows)
    levels = 1 + math.ceil(math.log(max(1, math.ceil(deepest / LEAF)), FAN_IN) + (1e-9 if deepest > LEAF else 0))
    settled, todo = [rows.where("p <= 0")], rows.where("p > 0")
    for level in range(levels):
        last = level == levels - 1
        todo = cut(todo.groupBy("rank", "node").applyInPandas(_settle(seed, level, last), rows.schema))
        settled.append(todo.where("NOT open"))
        todo = todo.where("open")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "n_rows", "source_size", "target", (F.col("whole") + F.round("p")).cast("long").alias("copies"))


def sized_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mixed_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and its copies."""
    units = rounded_copies(sized_rows(docs), **options)
    one_each = units.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return one_each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: documents that got no copy are gone, the others stand as often as they were taken."""
    units = rounded_copies(sized_rows(docs), **options).where("copies > 0")
    units = units.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "size", "copies")])
    # the document travels as one column, so that no name of its can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    on = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size"))
    taken = rows.join(units, on).select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return taken.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
