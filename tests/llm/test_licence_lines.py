"""Long lines are judged in work that grows with their length, by the same n-grams."""

import time

from pyspark.sql import functions as F

from tieledger.llm import licences


def test_grams_of_a_long_line_grow_with_its_length(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(120_000)), lambda i: F.concat(F.lit("w"), i.cast("string")))
    began = time.monotonic()
    sizes = spark.range(1).select(words.alias("w")).select(*[F.size(licences._grams(F.col("w"), n)) for n in (1, 2, 3)]).first()
    assert tuple(sizes) == (120_000, 119_999, 119_998)
    assert time.monotonic() - began < 15


def test_grams_at_places_are_all_that_templates_have(spark):
    texts = ["mit license mit license", "the mit", "mit", "nothing here", "released under the mit license of old", "gpl v3 and gpl"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.split("t", " ").alias("w"))
    listed = set().union(*[licences.grams_of(licences.words_of(t)) for f in licences.FAMILIES for t in licences.TEMPLATES[f]])
    for n in (1, 2, 3):
        rows = docs.select("t", licences._grams(F.col("w"), n).alias("all"), licences._grams_at(F.col("w"), licences._places(F.col("w")), n).alias("few")).collect()
        for r in rows:
            words = r["t"].split(" ")
            assert set(r["all"]) == {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
            assert set(r["few"]) & listed == set(r["all"]) & listed
