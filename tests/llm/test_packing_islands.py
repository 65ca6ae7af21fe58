"""The genetic part of packing against best fit decreasing, on lengths where that is not at the bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieledger.llm import packing

CAPACITY = 2048


def triplets(draw):
    """Lengths of which each three fill a sequence without a gap."""
    a, b = draw.integers(500, 800, 1365), draw.integers(500, 900, 1365)
    return np.concatenate([a, b, CAPACITY - a - b])


def plain(lengths):
    return int(packing._first(lengths, CAPACITY, np.random.default_rng(0), True).max()) + 1


def bins_of(spark, lengths):
    pools = spark.createDataFrame([(7, lengths.tolist())], "pool long, lengths array<long>")
    (row,) = packing.pack_pools(pools, CAPACITY, 11).collect()
    labels = np.array(row["labels"])
    assert len(labels) == len(lengths) and np.bincount(labels, lengths).max() <= CAPACITY
    return int(labels.max()) + 1


def test_islands_beat_best_fit(spark):
    lengths = np.random.default_rng(3).integers(300, 900, 4096)
    assert bins_of(spark, lengths) <= 0.99 * plain(lengths)


def test_islands_close_the_gap_of_triplets(spark):
    lengths = triplets(np.random.default_rng(4))
    best = plain(lengths)
    assert best > 1440
    assert bins_of(spark, lengths) - 1365 <= (best - 1365) / 2


def test_replacement_fills_and_loses_nothing():
    lengths = np.array([1000, 900, 1100, 948, 148, 60, 700])
    groups, loose = packing.replace(lengths, CAPACITY, [[0, 1], [2]], [3, 4, 5, 6])
    assert sorted([i for g in groups for i in g] + loose) == list(range(7))
    assert sorted(int(lengths[g].sum()) for g in groups) == [2048, 2048]
    assert packing.replace(lengths, CAPACITY, [[0]], []) == ([[0]], [])


@pytest.mark.parametrize("lengths", [[1100] * 300, [300 + 7 * (i % 80) for i in range(300)], [2047] * 150 + [1] * 150])
def test_rounds_end(spark, monkeypatch, lengths):
    """Lengths that no bin holds well, and lengths that need several rounds, with small pools."""
    monkeypatch.setattr(packing, "POOL", 50)
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    got = packing.assign(items).join(items, "item").toPandas()
    assert sorted(got["item"]) == list(range(300))
    bins = 0
    for _, rows in got.sort_values("offset").groupby(["round", "pool", "bin"]):
        assert rows["length"].sum() <= CAPACITY and (rows["offset"] == rows["length"].cumsum() - rows["length"]).all()
        bins += 1
    assert bins <= -(-sum(lengths) // CAPACITY) + 1 or bins == 300 == len([n for n in lengths if 2 * n > CAPACITY])


def test_packing_is_repeated_alike(spark):
    items = spark.range(400).select(F.col("id").alias("item"), (F.col("id") % 97 * 11 + 300).alias("length"))
    assert sorted(packing.assign(items).collect()) == sorted(packing.assign(items).collect())
