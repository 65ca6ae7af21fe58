"""Bounds on what travels to Python workers at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of an Arrow batch, but for a single longer text.
MOST_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session's batches are bounded by bytes from here on, so that workers hold a few MB each, whatever the texts.

    The setting is lowered, never raised.
    """
    conf = df.sparkSession.conf
    now = int(conf.get(_SETTING).removesuffix("b"))
    if now <= 0 or now > MOST_BYTES:
        conf.set(_SETTING, str(MOST_BYTES))
    return df
