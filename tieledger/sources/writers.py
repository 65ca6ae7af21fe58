"""Writing ledger tables, graph projections and the manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieledger.sources.versions import Versions


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """Rows of a partition are brought together first, so that a partition is few files."""
    out = df.repartition(*partition_by) if partition_by else df
    out.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


#: Versions that a graph's tenants may be spread over before all are written anew.
MOST_VERSIONS = 16


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, token: str | None = None) -> None:
    """Nodes and edges replace those of the tenants that either has; other tenants keep theirs.

    Both tables and the list of which tenant is read from which version become visible in one step, so a reader never sees
    nodes of one run and edges of another; a run that fails leaves the graph as it was.
    """
    versions = Versions(nodes.sparkSession, path)
    before = versions.latest()
    tenants = nodes.select("user_id").union(edges.select("user_id")).distinct()
    made = {"nodes": nodes, "edges": edges}
    number = before.number + 1 if before else 0
    placed = tenants.withColumn("version", F.lit(number))
    if before:
        others = versions.read("tenants", before).join(tenants, "user_id", "left_anti")
        if others.select("version").distinct().count() >= MOST_VERSIONS:
            made = {name: df.unionByName(_graph_table(versions, name, others)) for name, df in made.items()}
            others = others.withColumn("version", F.lit(number))
        placed = placed.unionByName(others)
    versions.commit(made | {"tenants": placed}, token)


def _graph_table(versions: Versions, name: str, tenants: DataFrame) -> DataFrame:
    """Rows of tenants (user_id, version), each from its version."""
    numbers = sorted(r["version"] for r in tenants.select("version").distinct().collect())  # no more than MOST_VERSIONS
    parts = [versions.read(name, versions.get(n)).join(tenants.where(F.col("version") == n).select("user_id"), "user_id", "left_semi") for n in numbers]
    return reduce(DataFrame.unionByName, parts) if parts else versions.read(name).limit(0)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one version."""
    versions = Versions(spark, path)
    tenants = versions.read("tenants", versions.latest())
    return _graph_table(versions, "nodes", tenants), _graph_table(versions, "edges", tenants)


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines in the order of the smallest identity node; two runs give the same bytes."""
    df.orderBy(F.col("min_node")).drop("min_node").write.mode("overwrite").json(path)
