"""Introduction paths: which side goes how far, and what is carried along."""

import itertools
import random

import pytest

from tieledger.operators import graph


def brute(edges, source, target, most):
    best = {}
    for a, b, kind, weight in edges:
        for pair in ((a, b), (b, a)):
            best[pair] = max(best.get(pair, (0.0, "")), (weight, kind))
    nodes = sorted({x for pair in best for x in pair} | {source, target})
    for hops in range(most + 1):
        for inner in itertools.product(nodes, repeat=max(0, hops - 1)):
            path = [source, *inner, target][: hops + 1] if hops else [source]
            if path[-1] == target and all(pair in best for pair in itertools.pairwise(path)):
                return path, [best[pair][1] for pair in itertools.pairwise(path)]
    return None, None


@pytest.mark.parametrize("one_side", [None, "source", "target"])
def test_paths_whatever_side_goes(spark, monkeypatch, one_side):
    """All hops from the only source, from the only target, or half from each: the same paths as by trying all."""
    draw, gone = random.Random(5), []
    nodes = [f"n{i}" for i in range(9)]
    edges = [("t", *draw.sample(nodes, 2), draw.choice(["DM", "EMAILED"]), float(draw.randint(1, 3))) for _ in range(10)]
    monkeypatch.setattr(graph, "FEWER", 4, raising=False)
    made = graph._frontier
    monkeypatch.setattr(graph, "_frontier", lambda starts, step, hubs, hops, back: gone.append(hops) or made(starts, step, hubs, hops, back))
    pairs = [("t", a, b) for a in nodes for b in nodes if a == (one_side == "source" and "n0" or a) and b == (one_side == "target" and "n1" or b)]
    got = graph.intro_paths(spark.createDataFrame(edges, "user_id string, a string, b string, type string, weight double"), spark.createDataFrame(pairs, "user_id string, source string, target string")).collect()
    assert gone == {None: [2, 2], "source": [4, 0], "target": [0, 4]}[one_side]
    assert {(r["source"], r["target"]): (r["path"], r["types"]) for r in got} == {(a, b): brute([e[1:] for e in edges], a, b, 4) for _, a, b in pairs}


def test_levels_carry_only_what_lies_between(spark):
    step = spark.createDataFrame([("t", a, b, 1.0, "DM", 0) for a, b in (("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"))], "user_id string, at string, next string, w double, t string, part int")
    hubs = spark.createDataFrame([], "user_id string, at string, parts int")
    for back in (False, True):
        levels = graph._frontier(spark.createDataFrame([("t", "a")], "user_id string, end string"), step, hubs, 2, back)
        assert [[tuple(r) for r in level.collect()] for level in levels] == [[("t", "a", "a", [], [], 0.0)], [("t", "a", "b", [], ["DM"], 1.0)], [("t", "a", "c", ["b"], ["DM", "DM"], 2.0)]]


@pytest.mark.parametrize("one_side, first", [("source", "target"), ("target", "source")])
def test_pairs_meet_their_own_ends_first(spark, monkeypatch, one_side, first):
    """Where one side goes all hops, pairs are joined to the other's ends before the nodes that were reached: one row for a pair, not one for each node."""
    met, cut = [], graph.cut
    monkeypatch.setattr(graph, "FEWER", 4)
    monkeypatch.setattr(graph, "cut", lambda df: (met.append(df) if {"path", "source"} <= set(df.columns) else None) or cut(df))
    edges = [("t", "n0", f"n{i}", "DM", 1.0) for i in range(1, 9)]
    pairs = [("t", "n0", f"n{i}") if one_side == "source" else ("t", f"n{i}", "n0") for i in range(1, 9)]
    got = graph.intro_paths(spark.createDataFrame(edges, "user_id string, a string, b string, type string, weight double"), spark.createDataFrame(pairs, "user_id string, source string, target string")).collect()
    assert [r["hops"] for r in got] == [1] * 8
    (settled,) = [df._jdf.queryExecution().analyzed().toString() for df in met]
    inner = [line for line in settled.splitlines() if "Join Inner" in line][1]
    assert f"{first}#" in inner and "at#" not in inner
