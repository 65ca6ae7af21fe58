"""Row numbers and running sums within a key that may hold most of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieledger.sources.tables import cut


def numbered(df: DataFrame, by: list[str], order: list[Column], value: str | None = None, place: str = "place", before: str = "before", parts: int | None = None) -> DataFrame:
    """``df`` with ``place``, from 1, within ``by`` in ``order``, and with ``value`` the sum of it ``before`` the row.

    Rows are dealt into ranges of (by, order) and written; what a key has in earlier ranges is added up from one row for each range and
    key; within a range a window numbers the rows.  So no task holds more than a range, however many rows a key has.
    ``order`` should leave no ties: of rows that are equal in it any may come first.
    """
    spark = df.sparkSession
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn("__part", F.spark_partition_id()))
    sums = {"__rows": F.count("*"), **({"__sum": F.sum(value)} if value else {})}
    held = ranged.groupBy("__part", *by).agg(*[c.alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over no more rows than ranges
    offsets = held.select("__part", *by, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])
    within = Window.partitionBy("__part", *by).orderBy(*order)
    own = ranged.withColumn(place, F.row_number().over(within).cast("long"))
    if value:
        own = own.withColumn(before, F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keys = ["__part", *by]
    offsets = offsets.select(*[F.col(k).alias(f"__o_{k}") for k in keys], *sums)
    joined = own.join(offsets, [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys])
    out = joined.withColumn(place, F.col(place) + F.col("__rows"))
    if value:
        out = out.withColumn(before, F.col(before) + F.col("__sum"))
    return out.select(*df.columns, place, *([before] if value else []))
