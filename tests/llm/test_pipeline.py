"""The pipeline over a small table, stage by stage against what each must do."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tieledger.llm import minhash


def corpus(spark):
    draw = random.Random(1)
    vocabulary = {"en": "the of and to in is that with for was".split(), "de": "der die und das ist nicht mit von auf ein".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        text = " ".join(draw.choice(vocabulary[lang]) + str(draw.randrange(50)) * (draw.random() < 0.5) for _ in range(80))
        rows.append((i, text, lang, f"src{i % 4}", len(text)))
    rows += [(200, rows[0][1], "de", "src1", 1), (201, "123 456 !!", None, "src0", 10), (202, None, None, "src0", 0), (203, rows[1][1] + " mail jo@acme.test now", "en", None, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs, seen = corpus(spark), {}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert now.columns == docs.columns
    ids = {k: [r["doc_id"] for r in v.select("doc_id").collect()] for k, v in seen.items()}
    assert set(ids["language_id"]) == {r["doc_id"] for r in docs.collect()} - {201, 202}
    kept = minhash.near_duplicates(seen["language_id"]).where("kept").collect()
    assert sorted(ids["minhash_dedup"]) == sorted(r["doc_id"] for r in kept) and 200 not in ids["minhash_dedup"]
    assert not seen["personal_data"].where(F.col("text").contains("jo@acme.test")).count()
    assert set(ids["mixing"]) <= set(ids["personal_data"])
    assert sorted({r["doc_id"] for r in seen["packing"].collect()}) == sorted(set(ids["mixing"]))
    assert seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_run(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
