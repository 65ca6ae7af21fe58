"""Near relatives of licence families, joined identifiers, and scores against plain loops."""

from pyspark.sql import functions as F

from tieledger.llm import licences

CASES = {
    "GNU Affero General Public License, version 3": "AGPL",
    "Licensed under CC BY-ND 4.0": "CC-BY-ND",
    "CC BY-NC-SA 4.0": "CC-BY-NC-SA",
    "Apache License, Version 1.1": "Apache-1.1",
    "BSD-2-Clause OR Apache-2.0": "Apache-2.0,BSD",
    "SPDX-License-Identifier: (MIT OR GPL-2.0) AND Apache-2.0 WITH LLVM-exception": "Apache-2.0,GPL,MIT",
    "Licensed under the EUPL v1.2": "EUPL",
    "Released under the ISC license": "ISC",
    "Eclipse Public License 2.0": "EPL",
    "Licensed under the MIT license": "MIT",
    "CC BY 4.0": "CC-BY",
    "Licensed under the WTFPL": "",
    "Licensed under the Boost Software License 1.0": "",
    "Released under the Zlib license": "",
    "Licensed under the Artistic License 2.0": "",
    "Licensed under the Microsoft Public License": "",
    "THE AUTHORS OR COPYRIGHT HOLDERS of the inn": "",
    "the license office was closed": "",
}


def test_relatives_and_scores(spark):
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = licences.fit(plain)
    rows = spark.createDataFrame(list(enumerate(CASES)), "doc_id int, text string")
    got = {r["doc_id"]: r["families"] for r in licences.report(rows, model).collect()}
    assert {t: got[i] for i, t in enumerate(CASES)} == CASES
    units = rows.select(licences._words(F.col("text")).alias("w")).select("w", licences._judged(F.col("w"), model).alias("j")).collect()
    for r in units:
        scores = model.scores(licences.grams_of(r["w"]))
        k = -r["j"]["first"]
        assert abs(scores[k] - r["j"]["score"]) < 1e-9
        pairs = {" ".join(p) for p in zip(r["w"], r["w"][1:])}
        shares = [len(pairs & licences.bigrams_of(t)) / len(licences.bigrams_of(t)) for t in licences.TEMPLATES[licences.FAMILIES[k]]]
        assert r["j"]["similarity"] <= max(shares) + 1e-9
        if r["j"]["sure"]:
            assert scores[k] >= model.threshold
