"""Personal data in forms and words that no generator makes, and figures that are none."""

import pytest
from pyspark.sql import functions as F

from tieledger.llm import pii

NONE = [
    "lot size 200 300 4000 units", "score 100 200 3000 points", "years 1990 2000 2010 1234", "coords 1234 5678 9012 3456", "see 12-345-6789 for part", "build 10 . 2 . 33 . 4 of list", "john at home dot com is",
    "table 12 345 6789 rows", "budget 250-300-4000 dollars", "ratios 120 . 14 . 3 . 2 and more", "stay at hotel dot and", "seats 300 400 5000", "grid 210-220-2300 north", "between 1890 1900 1910 or so",
]
SOME = [
    ("Tel: 555 010 2030 now", "phone:5:17"), ("call 555-010-2030 today", "phone:5:17"), ("(212) 555-0100 reception", "phone:0:14"), ("write to jo at acme dot com please", "email:9:27"), ("mail jo (at) acme (dot) com", "email:5:27"),
    ("jo [at] acme.org is mine", "email:0:16"), ("server 10 . 2 . 33 . 4 is down", "ip:7:22"), ("ip 10[.]2[.]33[.]4", "ip:3:18"), ("phone 030 123 4567 ok", "phone:6:18"), ("card 4111.1111.1111.1111 ok", "card:5:24"), ("0049 30 123 4567 home", "phone:0:16"), ("fax 212 555 0199", "phone:4:16"),
]


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_foreign_forms(spark, model):
    texts = NONE + [t for t, _ in SOME]
    found = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    got = {r["text"]: r["s"] for r in found.select("text", pii._listed(F.col("spans")).alias("s")).collect()}
    taken = [t for t in NONE if got[t]]
    right = sum(got[t] == s for t, s in SOME)
    assert not taken and right >= 0.8 * len(SOME)
    assert min(p for p, _ in model.measured.values()) >= 0.95 and min(r for _, r in model.measured.values()) >= 0.8
