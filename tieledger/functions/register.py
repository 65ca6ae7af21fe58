"""The rule functions by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tieledger.functions import names


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions for the scores, and the vectorised name helpers."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION edge_weight(n BIGINT, days DOUBLE) RETURNS DOUBLE RETURN CASE WHEN coalesce(n, 0) <= 0 THEN 0D ELSE ln(1 + n) * exp(-greatest(0D, coalesce(days, 0D)) / 180) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION decay(score DOUBLE, days DOUBLE) RETURNS DOUBLE RETURN CASE WHEN score <= 1 OR days <= 7 THEN score ELSE round(greatest(score * power(0.98D, days - 7), 0.5D), 2) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalize_score(raw DOUBLE) RETURNS DOUBLE RETURN CASE WHEN raw <= 0 THEN 0D ELSE round(least(ln(1 + raw) / ln(21D) * 10, 10D), 2) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bare_lid(x STRING) RETURNS STRING RETURN nullif(regexp_replace(regexp_replace(trim(x), '(?i)@lid$', ''), ':[0-9]+$', ''), '')")
    spark.udf.register("fuzzy_score", names.fuzzy_score)
    spark.udf.register("name_ratio", names.name_ratio)
    spark.udf.register("normalize_name", names.exact_normal_name)
