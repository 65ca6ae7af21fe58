"""Reading and writing the tables that jobs share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path is left to Spark, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    Only where the session names none and its master is local (tests) a temporary folder is made and kept for the session.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = _own.setdefault(id(spark.sparkContext), tempfile.mkdtemp(prefix="spark-tieledger-", dir="/tmp"))
    return where.rstrip("/")


_own: dict[int, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage and survives lost executors; the schema is handed over, so an empty table works.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tieledger-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
