"""Streams under failure and repetition, and versions of tables."""

import shutil

import pytest
from pyspark.sql import functions as F

from tieledger.sources.versions import Versions
from tieledger.streaming import streams

RAW = "user_id string, source string, source_event_id string, seq long, body string, score decimal(4,3), occurred_at timestamp"


def raw_stream(spark, folder, rows):
    spark.createDataFrame([(*r, None, None) for r in rows], RAW).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(folder))


def bodies(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(str(path)).select("user_id", "source_event_id", "body").collect())


def test_known_keys_are_not_read_from_the_table(spark, tmp_path):
    big = 2**53 + 1
    read = raw_stream(spark, tmp_path / "in", [("t", "mail", "a", big, "late"), ("t", "mail", "a", big - 1, "first"), ("u", "mail", "a", None, "other tenant")])
    streams.stream_raw_events(read, str(tmp_path / "raw"), str(tmp_path / "state")).awaitTermination()
    assert bodies(spark, tmp_path / "raw") == [("t", "a", "first"), ("u", "a", "other tenant")]
    assert {r["seq"] for r in spark.read.parquet(str(tmp_path / "raw")).collect()} == {big - 1, None}
    shutil.move(tmp_path / "raw", tmp_path / "away")  # the state alone knows
    raw_stream(spark, tmp_path / "in", [("t", "mail", "a", 0, "again"), ("t", "mail", "b", 1, "new")])
    streams.stream_raw_events(read, str(tmp_path / "raw"), str(tmp_path / "state")).awaitTermination()
    assert bodies(spark, tmp_path / "raw") == [("t", "b", "new")]
    # a new checkpoint begins with the keys of the table
    shutil.copytree(tmp_path / "away", tmp_path / "raw", dirs_exist_ok=True)
    streams.stream_raw_events(read, str(tmp_path / "raw"), str(tmp_path / "state2")).awaitTermination()
    assert bodies(spark, tmp_path / "raw") == [("t", "a", "first"), ("t", "b", "new"), ("u", "a", "other tenant")]


def test_a_batch_that_failed_is_run_again(spark, tmp_path, monkeypatch):
    """The batch dies between its two tables; the next run replaces what it left."""
    schema = "user_id string, id string, kind string, evidence_pointer string, payload string, seq long, observed_at timestamp, ingested_at timestamp"
    rows = [("t", f"n{k}", "note", f"p{k % 3}", '{"target_person_id": "P", "content": "c"}', k, None, None) for k in range(5)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / x) for x in ("obs", "links", "state")]

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(streams, "link_events", dies)
        with pytest.raises(Exception, match="lost"):
            streams.stream_observations(read, *paths).awaitTermination()
    assert spark.read.parquet(paths[0]).count() == 3
    for _ in range(2):
        streams.stream_observations(read, *paths).awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(paths[0]).collect()) == ["n0", "n1", "n2"]
        assert sorted(r["observation_id"] for r in spark.read.parquet(paths[1]).collect()) == ["n0", "n1", "n2"]


def test_ticks(spark, tmp_path):
    schema = "user_id string, ingested_at timestamp"
    folder, path, state = (str(tmp_path / x) for x in ("in", "marks", "state"))

    def run(rows, as_of, known=None):
        if rows:
            spark.createDataFrame(rows, "user_id string, at string").select("user_id", F.col("at").cast("timestamp").alias("ingested_at")).coalesce(1).write.mode("append").parquet(folder)
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return sorted((r["user_id"], str(r["since"])[:10]) for r in streams.stream_ticks(read, path, state, as_of, known).collect())

    known = spark.createDataFrame([("a", "2024-01-05"), ("b", "2024-01-01")], "user_id string, at string").select("user_id", F.col("at").cast("timestamp").alias("last_tick_at"))
    rows = [("a", "2024-01-02"), ("b", "2024-01-02"), ("c", "2024-01-02"), ("c", "2024-01-03")]
    assert run(rows, "2024-01-10", known) == [("b", "2024-01-01"), ("c", "1970-01-01")]
    assert run([], "2024-01-10") == [("b", "2024-01-01"), ("c", "1970-01-01")]  # the same run again
    assert run([], "2024-01-11") == []
    assert run([("a", "2024-01-12"), ("b", "2024-01-09")], "2024-01-13") == [("a", "2024-01-05")]
    assert {(r["user_id"], str(r["last_tick_at"])[:10]) for r in streams.watermarks(spark, path).collect()} == {("a", "2024-01-13"), ("b", "2024-01-10"), ("c", "2024-01-10")}


def test_versions(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    rows = lambda n: spark.range(n)
    assert versions.latest() is None and versions.read("a") is None
    versions.commit({"a": rows(1), "b": rows(2)}, "one")
    first = versions.latest()
    assert versions.commit({"a": rows(9)}, "one") == first and versions.read("a").count() == 1

    class Lost(Exception):
        pass

    def dies(df):
        raise Lost

    with pytest.raises(Lost):  # the second table is never written
        broken = rows(5)
        broken_b = type("B", (), {"write": property(dies)})()
        versions.commit({"a": broken, "b": broken_b}, "two")
    assert versions.latest() == first and versions.read("b").count() == 2
    versions.commit({"a": versions.read("a").union(rows(3)), "b": rows(0)}, "two")
    assert (versions.read("a").count(), versions.read("b").count(), versions.read("a", first).count()) == (4, 0, 1)
    with pytest.raises(RuntimeError, match="another writer"):
        versions._publish(1, "elsewhere", None)
    assert versions.latest().token == "two"
