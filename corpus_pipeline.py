"""A corpus from raw documents to packed sequences: the stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieledger.llm import langid, minhash, mixing, packing, pii
from tieledger.sources.tables import cut, table

#: No SQL can express the classifiers and random roundings; tests compare with a brute-force version.
ORACLE_SQL = None
#: A text whose best language holds less of the votes counts as of no language.
LEAST_SCORE = 0.34


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is in a known language and sets ``lang`` to it; texts without letters go."""
    model = langid.fit(docs)
    found = langid.identify(docs, model, lang_pred="__lang", score="__score")
    found = found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("__lang")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return minhash.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets; ``n_chars`` follows the new text."""
    new = pii.redacted(docs, pii.fit(docs))
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a document stands as often as it was taken."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
