"""Edges of shared groups: all threads of two persons meet at one of them, and lists are made only where they are asked for."""

from pyspark.sql import functions as F

from tieledger.operators import graph

MEMBERS = [("t", "g1", p) for p in ("S2", "S5", "S9")] + [("t", "g2", p) for p in ("S5", "S9")] + [("t", None, p) for p in ("S2", "S9")] + [("u", "g1", p) for p in ("S2", "S5")]


def edges(spark):
    members = spark.createDataFrame(MEMBERS, "user_id string, thread_id string, person_id string").withColumn("last_at", F.lit("2024-01-01").cast("timestamp"))
    me = spark.createDataFrame([("t", "S4")], "user_id string, self_id string")
    return graph.shared_group_edges(members, me, "2024-01-01")


def test_self_between_others_in_the_order(spark):
    got = {(r["user_id"], r["a"], r["b"]): (r["group_count"], r["group_ids"]) for r in edges(spark).collect()}
    assert got == {
        ("t", "S2", "S4"): (1, ["g1"]), ("t", "S4", "S5"): (2, ["g1", "g2"]), ("t", "S4", "S9"): (2, ["g1", "g2"]), ("t", "S2", "S5"): (1, ["g1"]),
        ("t", "S2", "S9"): (1, ["g1"]), ("t", "S5", "S9"): (2, ["g1", "g2"]), ("u", "S2", "S5"): (1, ["g1"]),
    }


def test_a_count_makes_no_lists_of_threads(spark):
    plan = edges(spark).select("user_id", "a", "b", "group_count", "last_at")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(thread_id" not in plan
