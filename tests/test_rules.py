"""Rule functions on example tables with invented persons."""

import pytest
from pyspark.sql import functions as F

from tieledger.functions import normalize as N
from tieledger.functions import scoring as S
from tieledger.functions.names import fuzzy, jaro_winkler, plain, similar_text
from tieledger.functions.register import register_functions


def apply(spark, make, values, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r["out"] for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_phones(spark):
    values = ["911111111111@s.whatsapp.net", "+91 11111 11111", "11111 11111", "123", None, "", "abc", "12345678901234567"]
    assert apply(spark, N.normalize_phone, values) == ["+911111111111", "+911111111111", "+911111111111", None, None, None, None, None]
    values = ["(555) 010-2030", "1 555 010 2030", "+44 20 0000 0000", "12345", None]
    assert apply(spark, N.canon_phone_nanp, values) == ["+15550102030", "+15550102030", "+442000000000", None, None]


def test_emails(spark):
    values = [" First.Last+tag@GMail.com ", "jo+x@acme.test", "x@y", "+only@acme.test", None, "a b@acme.test"]
    got = apply(spark, N.canonicalize_email, values)
    assert [g["canonical"] for g in got] == ["firstlast@gmail.com", "jo@acme.test", None, None, None, None]
    assert [g["valid"] for g in got] == [True, True, False, False, False, False]


@pytest.mark.parametrize(
    ("name", "reason"),
    [("", "empty_name"), (None, "empty_name"), ("+911111111111", "phone_as_name"), ("+91 ••• ••11", "unicode_masked_phone"), ("a@acme.test", "email_as_name"),
     ("'Nick'", "quoted_literal"), ("KITE", "bot_name"), ("x example.org", "test_data_leak"), ("Ann Example", None)],
)
def test_safety(spark, name, reason):
    assert apply(spark, N.safety_drop_reason, [name]) == [reason]


def test_names(spark):
    assert apply(spark, N.normalize_name, ["  José  NÚÑEZ-Ö ", None, "a.b"]) == ["jose nunez o", None, "a b"]
    assert plain("  José  NÚÑEZ-Ö ") == "jose nunez o"
    assert apply(spark, N.is_generic_name, ["Al", "John", "Stripe", "Amazon Pay", "Mary Ann", "", None]) == [True, True, True, True, False, True, True]


def test_fuzzy():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1
    assert fuzzy("Mary Lee", "Lee Mary") == 1.0
    assert fuzzy("Mary", "Mary Lee") == 1.0  # a lone token that the other holds
    assert fuzzy("", "Mary") == 0.0
    assert fuzzy("Qqq", "Xyz") == 0.0


def test_similar_text(spark):
    rows = spark.createDataFrame([("works with alice", "alice works here"), ("other", "thing"), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(similar_text(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_addresses(spark):
    got = apply(spark, N.parse_addresses, ['"Doe, Jane" <jane@acme.test>, bare@acme.test, nothing', None, ""])
    assert [(x["name"], x["email"]) for x in got[0]] == [("Doe, Jane", "jane@acme.test"), (None, "bare@acme.test")]
    assert got[1] == [] and got[2] == []


def test_domains(spark):
    got = apply(spark, N.domain_class, ["gmail.com", "mail.acme.test", "stripe.com", "ft.com", "local.news", "acme.test", "nodot", None])
    assert [g["class"] for g in got] == ["personal", "bot", "saas", "press", "press", "work", "other", "other"]


def test_weights(spark):
    rows = spark.createDataFrame([(10, 0), (10, 180), (10, -5), (0, 0), (10, None)], "n long, days int")
    last = F.when(F.col("days").isNotNull(), F.timestamp_seconds(F.lit(1_700_000_000) - F.col("days") * 86400))
    got = [r[0] for r in rows.select(S.edge_weight(F.col("n"), last, F.timestamp_seconds(F.lit(1_700_000_000)))).collect()]
    ln11, e = 2.3978952728, 2.718281828459045
    assert got == pytest.approx([ln11, ln11 / e, ln11, 0, ln11])


def test_registered(spark):
    register_functions(spark)
    row = spark.sql("SELECT edge_weight(0, 1D) AS a, decay(0.9D, 100D) AS b, normalize_score(20D) AS c, bare_lid('12:3@lid') AS d, fuzzy_score('Ann Lee', 'Lee Ann') AS e").first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == (0.0, 0.9, 10.0, "12", 1.0)
