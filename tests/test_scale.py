"""What kept queries from larger tables."""

import pytest

from tieledger.operators import identity
from tieledger.plans import catalog
from tieledger.sources import readers
from tieledger.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["evidence_contacts", "evidence_direct_threads", "evidence_groups", "evidence_address_book"])
def test_evidence_of_one_channel_does_not_make_that_of_mail(spark, monkeypatch, name):
    def dies(*_):
        raise AssertionError("mail")

    monkeypatch.setattr(identity, "evidence_mail", dies)
    assert catalog.queries()[name](spark, SF).count() > 0


def test_streams_keep_keys_without_python_for_each_key(spark, tmp_path):
    """The first row of a key stays whichever batch repeats it; the plan has no step in Python."""
    schema = "user_id string, source string, source_event_id string, seq long, body string"
    for k, rows in enumerate([[("t", "s", "a", 2, "second"), ("t", "s", "a", 1, "first"), ("t", "s", "b", None, "no order")], [("t", "s", "a", 0, "late"), ("t", "s", "b", 1, "late"), ("t", "s", "c", 3, "new")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        query = streams.stream_raw_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "raw"), str(tmp_path / "state"))
        query.awaitTermination()
        operators = [o["operatorName"] for o in query.lastProgress["stateOperators"]]
        assert operators == ["stateStoreSave"]  # transformWithState calls Python for each key
    assert sorted(r["body"] for r in spark.read.parquet(str(tmp_path / "raw")).collect()) == ["first", "new", "no order"]


def test_lines_are_parsed_once(spark, tmp_path):
    """What is made of the lines is read from the rows as parsed: it stays when the files are gone."""
    good = '{"user_id":"t","observed_at":"2024-01-01T00:00:00Z","observer":"i","kind":"note","evidence_pointer":"p","confidence":0.5,"reasoning":"r","payload":{"target_person_id":"P","content":"c"}}'
    (tmp_path / "lines.txt").write_text("\n".join([good, "{half", good.replace("note", "rumour"), ""]))
    valid, rejects, summary = readers.read_observations(spark, str(tmp_path))
    (tmp_path / "lines.txt").unlink()
    assert [r["line_no"] for r in valid.collect()] == [1]
    assert sorted(tuple(r) for r in rejects.collect()) == [(2, "json"), (3, "kind")]
    assert tuple(summary.first()) == (3, 1, 2)
