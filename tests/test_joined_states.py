"""Stored states and a day's states give by one join what aggregating both gives."""

from pyspark.sql import functions as F

from tieledger.operators import cards


def test_join_of_states_is_their_merge(spark):
    rows = [("p1", "a1", 1, "person", '{"name":"Ann","phones":["1"],"emails":["a@x"]}'), ("p1", "a2", 2, "correction", '{"field":"phones","new_value":["2"]}'), ("p1", "a3", 3, "interaction", '{"channel":"email"}'),
            ("p2", "b1", 1, "person", '{"name":"Bob","company":null,"phones":["3"]}'), ("p3", "c2", 2, "person", '{"name":"Cy","emails":["c@x"]}')]
    obs = spark.createDataFrame(rows, "person_id string, id string, t int, kind string, payload string").withColumn("observed_at", F.timestamp_seconds("t"))
    obs = obs.withColumns({"user_id": F.lit("t"), "ingested_at": F.col("observed_at")})
    old, new = cards.fold_states(obs.where("t = 1")), cards.fold_states(obs.where("t > 1"))
    got = cards._joined_states(old, new)
    assert got.columns == old.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, cards.merge_states(old, new).select(*old.columns).collect()))
    assert "ggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
