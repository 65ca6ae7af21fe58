"""Connected components by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieledger.sources.tables import cut


#: Neighbours of a node that one task holds, about; the least number of parts of a node.
PART, PARTS = 1 << 16, 16


def _with_least(edges: DataFrame, others: Column, parts: int) -> DataFrame:
    """Each edge (a, b) with ``m``, the least of a and of the neighbours of a that ``others`` admits.

    The neighbours of a node are dealt into ``parts``; a part's minimum is brought to the node's and that back to each of its
    parts, so that no key of a shuffle holds more than a part of a node with very many neighbours.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)))
    own = dealt.groupBy("a", "part").agg(F.min(F.when(others, F.col("b"))).alias("m0"))
    least = own.groupBy("a").agg(F.min("m0").alias("m0"), F.collect_list("part").alias("held"))  # no more than ``parts``
    least = least.select("a", F.explode("held").alias("part"), F.least("a", "m0").alias("m"))
    return dealt.join(least, ["a", "part"]).drop("part")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    stars = _with_least(_both_ways(edges), F.lit(True), parts).where("b > a")
    return stars.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = _with_least(down, F.lit(True), parts)
    # the star's centre hangs on its least neighbour, and so do all its smaller neighbours
    own = stars.select("a", F.col("m").alias("b"))
    rest = stars.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.union(rest).where("a <> b").distinct()


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a batch give way to one from each node to the least one that the batch's edges lead to."""
    for rows in batches:
        codes, nodes = pd.factorize(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), sort=True)
        i, j = codes[: len(rows)], codes[len(rows) :]
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[i], label[j])
            new = label.copy()
            for ends in (i, j, label[i], label[j]):
                np.minimum.at(new, ends, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        away = np.flatnonzero(label != np.arange(len(nodes)))
        yield pd.DataFrame({"a": nodes[away], "b": nodes[label[away]]})


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: edges (a, b) -> one row (node, component) per node on an edge.

    ``component`` is the smallest node of the component.  Rows with a null end and loops are ignored for
    linking; a node that has only loops is its own component; repeated edges count once.  An empty table
    gives an empty one.  Edges are contracted in batches where they are before anything is shuffled.  Every round is two pairs of hash aggregation and equi-join and is written to the
    shared folder, so that neither the plan nor a lost executor makes a later round recompute a former one.
    """
    whole = cut(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"))  # read twice
    now = cut(whole.where("a <> b").mapInPandas(_contracted, whole.schema).distinct())
    nodes = cut(_both_ways(whole).select(F.col("a").alias("node")).distinct())
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    before = print_of(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        parts = max(PARTS, -(-before[0] // PART))
        now = cut(_small_star(_large_star(now, parts), parts))
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    to = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(to, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def extend_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, component) as ``connected_components`` gives them, and further edges (a, b) -> the labels of both together.

    Edges are drawn between the labels of their ends, so that the graph to settle is as large as what is new.  Labels whose
    component hangs on no new edge are copied.  Edges cannot be taken away: then components are worked out from the start.
    """
    new = cut(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    ends = new.select(F.col("a").alias("node")).union(new.select("b")).distinct()
    known = cut(ends.join(labels, "node", "left"))
    of = lambda s: known.select(F.col("node").alias(s), F.coalesce("component", "node").alias(f"c{s}"))
    drawn = new.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    moved = cut(connected_components(drawn).select(F.col("node").alias("component"), F.col("component").alias("new")))
    kept = labels.join(moved, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    added = known.where("component IS NULL").select("node", F.col("node").alias("component")).join(moved, "component").select("node", F.col("new").alias("component"))
    return kept.unionByName(added)
