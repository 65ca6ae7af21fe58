"""What repeats in the input is worked out once."""

from pyspark.sql import functions as F

from tieledger.functions import normalize
from tieledger.operators import identity
from tieledger.operators.components import connected_components
from tieledger.plans import catalog, identity_queries

SF = "/root/testdata/sf0.001"


def counted(spark):
    """An accumulator and a function of strings that adds to it with each row."""
    rows = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(x):
        rows.add(1)
        return x

    return rows, same.asNondeterministic()


def test_equal_headers_are_parsed_once(spark, monkeypatch):
    parse = normalize.parse_addresses
    rows, same = counted(spark)
    monkeypatch.setattr(normalize, "parse_addresses", lambda c: parse(same(c)))
    heads = [{"from": "Ann Poe <ann@acme.test>", "to": "bob@acme.test, me@acme.test", "cc": "bob@acme.test, me@acme.test"}, {"from": "no-reply@acme.test", "to": "bob@acme.test"}, {"to": "Eve <eve@acme.test>"}, {"from": "", "cc": "nobody"}, {"from": "Cy <cy@acme.test>", "list-id": "l"}]
    mail = spark.createDataFrame([(f"t{i}", i, heads[i % 5]) for i in range(100)], "thread_id string, s long, headers map<string,string>").withColumn("sent_at", F.timestamp_seconds("s"))
    got = identity.evidence_mail(mail, ["me@acme.test"]).groupBy("nodes", "name", "source").count().collect()
    assert sorted((r["nodes"][0], r["name"] or "", r["source"], r["count"]) for r in got) == [("email:ann@acme.test", "Ann Poe", "gmail_from", 20), ("email:bob@acme.test", "", "gmail_to_cc", 40), ("email:eve@acme.test", "Eve", "gmail_to_cc", 20)]
    assert rows.value <= 10


def test_buckets_read_their_evidence_once(spark, monkeypatch):
    rows, same = counted(spark)
    made = identity_queries.EVIDENCE[0]
    monkeypatch.setattr(identity_queries, "EVIDENCE", (lambda v: made(v).withColumn("name", same("name")),))
    for name in ("bucket_summary", "bucket_profile"):
        before = rows.value
        assert catalog.queries()[name](spark, SF).count() > 0
        assert 0 < rows.value - before <= spark.read.parquet(f"{SF}/customer.parquet").count()


def test_edges_of_components_are_made_once(spark):
    rows, same = counted(spark)
    edges = spark.createDataFrame([(f"n{i}", f"n{i % 7}") for i in range(50)], "a string, b string").withColumn("a", same("a"))
    assert connected_components(edges).select("component").distinct().count() == 7
    assert rows.value == 50
