"""What the licence scan costs before and beside its judgements: few candidates, a quick gate, constants as single values."""

import random
import time

from pyspark.sql import functions as F

from tieledger.llm import licences


def test_gate_is_found_quickly():
    began = time.process_time()
    assert licences.gate_words() == licences.GATE
    assert time.process_time() - began < 3


def test_any_half_of_a_template_has_a_gate_word_and_a_gate_pair():
    draw = random.Random(5)
    for f in licences.FAMILIES:
        for t in licences.TEMPLATES[f]:
            pairs = sorted(licences.bigrams_of(t))
            for _ in range(20):
                half = draw.sample(pairs, -(-len(pairs) // 2))
                assert set(half) & set(licences.PAIRS), (f, t, half)
                assert {w for g in half for w in g.split()} & set(licences.GATE), (f, t, half)


def test_windows_that_no_template_confirms_are_not_judged(spark):
    plain = "\n".join(["the source of that file was far from clear"] * 20)
    wrapped = "some prose\n" + "Licensed under the Apache\nLicense, Version 2.0."
    docs = spark.createDataFrame([(1, plain), (2, wrapped)], "doc_id long, text string")
    none = F.array().cast(licences._LISTED)
    sizes = docs.select("doc_id", F.size(licences._units(F.col("text"), lambda x, i: licences._window_units(x, i, none))).alias("n"))
    assert {r["doc_id"]: r["n"] > 0 for r in sizes.collect()} == {1: False, 2: True}
